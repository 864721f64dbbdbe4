"""Tables fed by micro-batches.

A batch never edits a table. It writes its own contribution to ``table/batch_id=N``, replacing whatever an earlier
attempt of the same batch left there, so a restart cannot count anything twice. Contributions are additive (sums,
minima, sets, first and last events), so readers merge them in one aggregation, in any order, however late they come.
``compact`` folds old contributions into a base; a base is complete before readers see it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


@dataclasses.dataclass(frozen=True)
class BatchStore:
    """A folder that all executors share."""

    path: str

    def put(self, frame: DataFrame, table: str, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def written(self, frame: DataFrame, table: str, batch_id: int) -> DataFrame:
        """The rows of ``frame`` as ``put`` stored them: readers take the columns they need instead of making all rows again."""
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def _base(self, spark: SparkSession, table: str) -> int:
        """Number of the last batch folded into a finished base, -1 if there is none."""
        names = _names(spark, f"{self.path}/{table}_base")
        done = [int(n.split("=")[1]) for n in names
                if n.startswith("upto=") and "_SUCCESS" in _names(spark, f"{self.path}/{table}_base/{n}")]
        return max(done, default=-1)

    def parts(self, spark: SparkSession, table: str) -> DataFrame:
        """All contributions that count, not merged."""
        base = self._base(spark, table)
        rows = spark.read.parquet(f"{self.path}/{table}").filter(F.col("batch_id") > base).drop("batch_id")
        if base < 0:
            return rows
        return rows.unionByName(spark.read.parquet(f"{self.path}/{table}_base/upto={base}"))

    def get(self, spark: SparkSession, table: str, merge: Merge) -> DataFrame:
        return merge(self.parts(spark, table))

    def compact(self, spark: SparkSession, table: str, merge: Merge, upto: int) -> None:
        """Fold batches up to ``upto`` into a new base. Batches after it are not touched."""
        base = self._base(spark, table)
        if upto <= base:
            return
        rows = spark.read.parquet(f"{self.path}/{table}").filter(
            (F.col("batch_id") > base) & (F.col("batch_id") <= upto)).drop("batch_id")
        if base >= 0:
            rows = rows.unionByName(spark.read.parquet(f"{self.path}/{table}_base/upto={base}"))
        merge(rows).write.mode("overwrite").parquet(f"{self.path}/{table}_base/upto={upto}")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder: a handful of versions or flags, never data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
