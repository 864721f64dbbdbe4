"""Stored sessions, kept up batch by batch without reading page views again.

Sessions lie in cells: the day they end and a hash of the visitor. A batch of page views is folded to sessions of its own. Old sessions it
can reach end no earlier than one gap before its first view and belong to its visitors, so only cells of those days and hashes are read, and
only cells in which something changed are written again, under a new name. A manifest names the live folder of every cell and the batches
that are in; a batch that comes again changes nothing, whatever became of its first attempt.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitmill.operators import sessions as ss
from visitmill.schema import SESSION_GAP, VISITOR, scope
from visitmill.streaming.manifest import Manifest

CELL = ["day", "bucket"]


class SessionTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, gap: int = SESSION_GAP) -> None:
        """``buckets`` is fixed by the first batch; for very many visitors a few thousand keep cells small."""
        self.spark, self.path, self.buckets, self.gap = spark, path, buckets, gap
        self.manifest = Manifest(spark, path)

    def _celled(self, blocks: DataFrame, buckets: int) -> DataFrame:
        return blocks.withColumns({"day": F.expr("CAST(floor(last_ts / 86400) AS INT)"),
                                   "bucket": F.pmod(F.xxhash64(*scope(blocks, *VISITOR)), F.lit(buckets)).cast("int")})

    def _read(self, state: dict, cells: dict[str, str]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{version}/{cell}" for cell, version in cells.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def blocks(self) -> DataFrame:
        _, state = self.manifest.read()
        if not state:
            raise ValueError(f"no batch has been written to {self.path}")
        return self._read(state, state["cells"])

    def sessions(self) -> DataFrame:
        """One row per session, as ``sessionize`` gives them for all page views so far."""
        return ss.sessions_of_blocks(self.blocks())

    def reachable(self, state: dict, first_ts: int, buckets: list[int]) -> dict[str, str]:
        """Cells that may hold a session some view from ``first_ts`` on belongs to."""
        low, mine = (first_ts - self.gap) // 86400, set(buckets)
        return {cell: v for cell, v in state["cells"].items() if _day(cell) >= low and int(cell.split("bucket=")[1]) in mine}

    def update(self, views: DataFrame, batch_id: int) -> bool:
        """Merge a batch of log rows; False if the batch is in already. Raises ``Conflict`` if another writer was faster: try again."""
        number, state = self.manifest.read()
        if batch_id in state.get("batches", []) or batch_id <= state.get("upto", -1):
            return False
        buckets, stage = state.get("buckets", self.buckets), uuid.uuid4().hex
        blocks = ss.session_blocks(views, self.gap)
        self._celled(blocks, buckets).write.parquet(f"{self.path}/staging/{stage}/fresh")
        fresh = self.spark.read.parquet(f"{self.path}/staging/{stage}/fresh")
        first_ts, seen = fresh.agg(F.min("first_ts"), F.collect_set("bucket")).first()  # at most one value per bucket
        schema = T.StructType([f for f in fresh.schema.fields if f.name not in CELL])
        state = {"cells": {}, "batches": [], "upto": -1, "buckets": buckets, "staging": [], "schema": json.loads(schema.json())} | state
        cells, version = dict(state["cells"]), uuid.uuid4().hex
        if seen:
            old = self._celled(self._read(state, self.reachable(state, first_ts, seen)), buckets)
            again, kept = ss.reopened(old, fresh, self.gap)
            joined = ss.chained(again.unionByName(fresh).drop(*CELL), self.gap)
            self._celled(joined, buckets).write.parquet(f"{self.path}/staging/{stage}/joined")
            joined = self.spark.read.parquet(f"{self.path}/staging/{stage}/joined")
            # As many rows as there are cells, which the manifest lists anyway.
            written = {f"day={r.day}/bucket={r.bucket}" for r in joined.select(*CELL).distinct().collect()}
            emptied = {f"day={r.day}/bucket={r.bucket}" for r in again.select(*CELL).distinct().collect()}
            changed = F.concat(F.lit("day="), "day", F.lit("/bucket="), "bucket")
            touched = self.spark.createDataFrame([(c,) for c in sorted(written | emptied)], "_cell string")
            stay = kept.join(F.broadcast(touched), changed == F.col("_cell"), "left_semi")
            rows = stay.unionByName(joined)
            rows.repartition(*CELL).write.partitionBy(*CELL).parquet(f"{self.path}/data/{version}")
            held = written | {f"day={r.day}/bucket={r.bucket}" for r in stay.select(*CELL).distinct().collect()}
            cells = {c: v for c, v in cells.items() if c not in emptied} | dict.fromkeys(held, version)
        batches = sorted([*state["batches"], batch_id])
        upto = state["upto"]
        while batches and batches[0] == upto + 1:
            upto = batches.pop(0)
        self.manifest.commit(number, state | {"cells": cells, "batches": batches, "upto": upto, "staging": [*state["staging"], stage]})
        return True

    def expire(self, before_ts: int) -> None:
        """Leave out sessions that ended on a day before ``before_ts``."""
        number, state = self.manifest.read()
        if state:
            cells = {c: v for c, v in state["cells"].items() if _day(c) >= before_ts // 86400}
            self.manifest.commit(number, state | {"cells": cells})

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that only lists before the last ``keep`` name; returns how many. Readers of the last ``keep`` states are not disturbed."""
        gone = self.manifest.forget(keep)
        live = {f"data/{v}/{c}" for n in self.manifest.numbers() for c, v in self.manifest.load(n)["cells"].items()}
        dead = {f"data/{v}/{c}" for state in gone for c, v in state["cells"].items()} - live
        dead |= {f"staging/{s}" for state in gone for s in state["staging"]}
        for folder in sorted(dead):
            self.manifest.drop(folder)
        return len(dead)


def _day(cell: str) -> int:
    return int(cell.split("/")[0].removeprefix("day="))
