"""Dropping lines that many documents repeat.

Method: the distinct hashes of repeated lines get a minimal perfect hash per shard. It maps each hash to a place in compact arrays
(fingerprint, document count, document that keeps the line). Lines are never joined: 16-byte probes of each document go to the
shard of their hash and look the arrays up.

Defined cases: null or empty text is one empty line; it stays null or empty. A line that one document repeats counts once for it
and loses all its occurrences. Each row counts as a document, rows with equal doc_id keep the line together. A null doc_id comes
before all others. All other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitmill.llm.shared import mix, pieces, saved, scratch

#: White space at the ends of a line, as bytes and as text.
BLANKS = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 4096
PROBES_PER_GROUP = 50_000


class MinimalHash:
    """Perfect hash of distinct pairs of 64-bit numbers to 0..n-1: on each level, pairs alone in their slot set a bit, the others go on.

    A slot depends on both numbers, so pairs that share one part at last as well. ``bits`` are the slots of all levels; a key's number is the count of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, keys: np.ndarray, others: np.ndarray) -> MinimalHash:
        sizes, levels, left, right = [], [], keys, others
        while len(left):
            size = 2 * len(left) + 1
            slot = cls._slot(left, right, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left, right = left[~alone[slot]], right[~alone[slot]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    @staticmethod
    def _slot(keys: np.ndarray, others: np.ndarray, level: int, size: int) -> np.ndarray:
        own = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        return (mix(own + others * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The number of each pair; a pair that was not built in gets any number or -1."""
        out, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slot = base + self._slot(keys[left], others[left], level, int(size))
            hit = self.bits[slot]
            out[left[hit]] = self.rank[slot[hit]]
            left, base = left[~hit], base + int(size)
        return out


def line_hashes(text: str | None, min_chars: int) -> list[tuple[int, int] | None]:
    """Two 64-bit hashes of each line's key, None for keys that are too short."""
    out: list[tuple[int, int] | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        if len(key) < min_chars:
            out.append(None)
        else:
            raw = key.encode().lower()  # bytes: A-Z only
            out.append((xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)))
    return out


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _lines(min_chars: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            docs, first, second = [], [], []
            for at, text in enumerate(batch.column("text")):
                for a, b in {x for x in line_hashes(text.as_py(), min_chars) if x}:
                    docs.append(at)
                    first.append(a)
                    second.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(_signed(first)), pa.array(_signed(second))],
                ["doc_id", "h1", "h2"])
    return task


def _build(table: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    perfect = MinimalHash.build(h1, h2)
    place = perfect.find(h1, h2)
    order = np.empty(len(h1), dtype=np.int64)
    order[place] = np.arange(len(h1))
    keep = table["keep"].combine_chunks().take(pa.array(order))
    return pa.table({
        "shard": table["shard"][:1],
        "sizes": pa.array([perfect.sizes.tolist()], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(perfect.bits).tobytes()], pa.binary()),
        "fingerprints": pa.array([table["h2"].to_numpy()[order].tobytes()], pa.binary()),
        "counts": pa.array([table["n"].to_numpy()[order].tobytes()], pa.binary()),
        "keepers": pa.array([keep.fill_null(0).to_numpy().tobytes()], pa.binary()),
        "no_keeper": pa.array([np.packbits(keep.is_null().to_numpy(zero_copy_only=False)).tobytes()], pa.binary()),
    })


INDEX = ("shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, keepers binary, no_keeper binary")


def _probe(min_docs: int):
    """Lines of the probing documents that the arrays say must go."""
    def task(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not len(index) or not len(probes):
            return pa.table({"doc_id": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        row = {name: index[name][0].as_py() for name in index.column_names}
        sizes = np.array(row["sizes"], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        prints, counts, keepers = (np.frombuffer(row[k], np.int64) for k in ("fingerprints", "counts", "keepers"))
        nobody = np.unpackbits(np.frombuffer(row["no_keeper"], np.uint8), count=len(prints)).astype(bool)
        h2 = probes["h2"].to_numpy()
        place = MinimalHash(sizes, bits).find(probes["h1"].to_numpy().view(np.uint64), h2.view(np.uint64))
        known = (place >= 0) & (prints[place] == h2) & (counts[place] >= min_docs)
        docs = probes["doc_id"].combine_chunks()
        null = docs.is_null().to_numpy(zero_copy_only=False)
        own = np.where(null, nobody[place], ~nobody[place] & (docs.fill_null(0).to_numpy() == keepers[place]))
        gone = pa.array(known & ~own)
        return pa.table({"doc_id": docs.filter(gone), "h2": probes["h2"].combine_chunks().filter(gone)})
    return task


def repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, gone): for each document that loses lines, the second hash of each such line."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    lines = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                  .mapInArrow(_lines(min_chars), "doc_id long, h1 long, h2 long"), "lines", folder)
    counts = saved(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
                   .filter(F.col("n") >= min_docs), "counts", folder)
    shards = max(1, -(-counts.count() // KEYS_PER_SHARD))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    index = saved(counts.select(shard, "h1", "h2", "n", "keep").groupBy("shard").applyInArrow(_build, INDEX), "index", folder)
    # One line may stand in a third of all documents, so a shard's probes go to as many groups as their number asks for.
    groups = lines.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / PROBES_PER_GROUP).alias("groups"))
    probes = (lines.select("doc_id", "h1", "h2", shard).join(groups, "shard")
              .select("shard", F.pmod(F.xxhash64("doc_id", "h1"), "groups").alias("part"), "doc_id", "h1", "h2"))
    arrays = index.join(groups, "shard").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")).drop("groups")
    hits = (probes.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part"))
            .applyInArrow(_probe(min_docs), "doc_id long, h2 long"))
    return hits.groupBy("doc_id").agg(F.collect_set("h2").alias("gone"))


def _rewrite(min_chars: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, totals, dropped = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("__gone")):
                text, drop = text.as_py(), set(gone.as_py() or ())
                all_lines = (text or "").split("\n")
                totals.append(len(all_lines))
                if drop:
                    drop = {x % (1 << 64) for x in drop}
                    kept = [line for line, h in zip(all_lines, line_hashes(text, min_chars)) if not h or h[1] not in drop]
                    text = "\n".join(kept)
                    dropped.append(len(all_lines) - len(kept))
                else:
                    dropped.append(0)
                texts.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__gone"}
            columns |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()),
                        "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return task


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """The documents with repeated lines taken out of text, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code points in at
    least ``min_docs`` documents stay only in the document with the largest doc_id. Input columns named n_lines or n_dropped
    are replaced.
    """
    own = docs.drop("n_lines", "n_dropped")
    gone = repeated_lines(docs, min_docs, min_chars).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    joined = own.withColumn("text", F.col("text").cast("string")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    fields = [f for f in joined.schema.fields if f.name != "__gone"]
    return joined.mapInArrow(_rewrite(min_chars), T.StructType([
        *fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
