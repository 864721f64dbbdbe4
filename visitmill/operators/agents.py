"""The table of user agents: each text is classified once, when it is first seen, and looked up ever after.

Agents repeat: millions of lines carry a few thousand texts. The rules (some eighty substring tests) are run over the new texts of a
batch alone, found by an anti-join; lines get their labels by a join. A table of bounded size is broadcast, a larger one is joined by
shuffle, with frequent texts apart. Lines whose agent is not in the table yet are classified in place, so nothing depends on the order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitmill.functions.agents import classify_ua
from visitmill.operators.shared import lookup
from visitmill.streaming.manifest import Manifest

SCHEMA = "agent string, browser string, os string, device string"
#: Bytes of text up to which a table is broadcast.
BROADCAST = 32 << 20


class AgentTable:
    def __init__(self, spark: SparkSession, path: str, broadcast: int = BROADCAST) -> None:
        self.spark, self.path, self.broadcast = spark, path, broadcast
        self.manifest = Manifest(spark, path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifest.read()
        return number, {"parts": [], "bytes": 0} | state

    def table(self) -> DataFrame:
        """(agent, browser, os, device), one row per text."""
        paths = [f"{self.path}/data/{p}" for p in self._state()[1]["parts"]]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def learn(self, agents: DataFrame) -> int:
        """Classify the texts of column ``agent`` that are not in the table; returns how many. A repeated batch adds nothing."""
        number, state = self._state()
        part = uuid.uuid4().hex
        new = agents.filter(F.col("agent").isNotNull()).select("agent").distinct().join(self.table().select("agent"), "agent", "left_anti")
        # The texts are fixed before the rules run, so that no filter on a label repeats them.
        labels = new.select("agent", F.inline(F.array(classify_ua("agent"))))
        labels.write.parquet(f"{self.path}/data/{part}")
        size = F.octet_length("agent") + F.octet_length("browser") + F.octet_length("os") + F.octet_length("device")
        count, held = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{part}").agg(F.count("*"), F.sum(size)).first()
        if count:
            self.manifest.commit(number, {"parts": [*state["parts"], part], "bytes": state["bytes"] + held})
        else:
            self.manifest.drop(f"data/{part}")
        return count

    def compact(self) -> None:
        """One part instead of one per batch; ``vacuum`` deletes the old ones later."""
        number, state = self._state()
        if len(state["parts"]) > 1:
            part = uuid.uuid4().hex
            self.table().repartition("agent").write.parquet(f"{self.path}/data/{part}")
            self.manifest.commit(number, state | {"parts": [part]})

    def vacuum(self, keep: int = 2) -> int:
        """Delete parts that only lists before the last ``keep`` name."""
        gone = {p for state in self.manifest.forget(keep) for p in state["parts"]}
        dead = gone - {p for n in self.manifest.numbers() for p in self.manifest.load(n)["parts"]}
        for part in dead:
            self.manifest.drop(f"data/{part}")
        return len(dead)

    def label(self, rows: DataFrame, agent: Column, spread: str) -> DataFrame:
        """Adds ``_agent``, a struct of the three labels. ``spread`` is a column that tells rows apart."""
        known = self.table().select(F.col("agent").alias("_text"), F.struct("browser", "os", "device").alias("_known"))
        keyed = rows.withColumn("_text", agent)
        if self._state()[1]["bytes"] <= self.broadcast:
            joined = keyed.join(F.broadcast(known), "_text", "left")
        else:
            joined = lookup(keyed, known, "_text", spread=spread)
        return joined.select(*rows.columns, F.coalesce("_known", classify_ua("_text")).alias("_agent"))
