"""Similarity join of documents by the Jaccard measure of their word n-gram sets.

Method: MinHash signatures are cut into bands; documents that agree in a band share a bucket, and only they are compared. Buckets
that overlap are verified together, so that each text is sent once and not once per band; where overlapping buckets add up to more
than ``16 * BLOCK`` texts, each bucket is verified on its own. Either way the texts of one unit are split into blocks, every pair
of blocks is one task, a pair counts if it shares a band, once, and its full n-gram sets decide. No pairs are written: a task
returns for each text its number of links and one link of a spanning forest.

Texts with equal n-gram sets are folded first (class of copies); a group of copies costs one text.

Defined cases: a word is a run without white space, taken unchanged. A text with fewer words than n has one n-gram of all its
words; null and empty texts have none, are in no bucket and stand alone. Rows that repeat a doc_id count as documents of their own;
a null doc_id takes part, class_id is the smallest non-null doc_id of the group. The output has only the columns named below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.components import components
from visitmill.llm.shared import attach, Words, arrow, mix, pieces, saved, scratch, words

BLOCK = 512
#: Hash values that one signature may have at most.
SIGNATURE = 180


def choose_bands(similarity: float, recall: float, most: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the longest rows with which ``bands * rows <= most`` values still find a pair of that similarity with that
    probability. Longer rows bring fewer false candidates."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(found: Words, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    first, value = found.windows(n)
    doc = found.doc[first]
    bounds = found.bounds()
    cuts = np.searchsorted(doc, np.arange(found.docs + 1))
    out = []
    for i in range(found.docs):
        own = np.unique(value[cuts[i]: cuts[i + 1]])
        size = bounds[i + 1] - bounds[i]
        if not len(own) and size:
            own = np.array([xxhash.xxh64_intdigest(found.hash[bounds[i]: bounds[i + 1]].tobytes())], dtype=np.uint64)
        out.append(own)
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each (non-empty) set."""
    rng = np.random.default_rng(5)
    times = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    start = np.cumsum([0] + [len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), bands * rows), dtype=np.uint32)
    at = 0
    while at < len(sets):  # about 64k values at a time stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(start, start[at] + 65536, side="right")) - 1)
        part, cuts = flat[start[at]: start[to]], start[at:to] - start[at]
        work = np.empty_like(part)
        for k in range(bands * rows):
            np.multiply(part, times[k], out=work)
            work += plus[k]
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            least[at:to, k] = np.minimum.reduceat(work, cuts)
        at = to
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out + least[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(r + 1))
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(n: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingles(words(batch.column("text")), n)
            some = [s for s in sets if len(s)]
            signed = iter(signatures(some, bands, rows).view(np.int64).tolist()) if some else iter(())
            yield arrow({"doc_id": batch.column("doc_id"),
                         "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                         "bands": [next(signed) if len(s) else None for s in sets]}, SIGNED)
    return task


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
            [squeeze((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "packed"])


def _verify(n: int, similarity: float):
    """The links between the texts of one pair of blocks."""
    def task(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        nodes, kept, seen = [], [], set()
        sets = shingles(words(pa.array([open_(x.as_py()).decode() for x in table["packed"]], pa.string())), n)
        for at, (node, own) in enumerate(zip(table["node"].to_pylist(), sets)):
            if node not in seen and xxhash.xxh3_128_digest(own.tobytes()) == node:
                seen.add(node)
                nodes.append(node)
                kept.append(at)
        empty = pa.table({"node": pa.array([], pa.binary()), "peer": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
        if len(kept) < 2:
            return empty
        sets = [sets[k] for k in kept]
        take = pa.array(kept)
        bands = np.array(table["bands"].take(take).to_pylist(), dtype=np.int64)
        weight = table["size"].take(take).to_numpy()
        block, only = table["block"].take(take).to_numpy(), table["band"].take(take).to_numpy()
        size = np.array([len(s) for s in sets])
        # A pair counts in a unit of its own bucket only in the first band it shares.
        shared = np.zeros((len(sets), len(sets)), dtype=bool)
        for k in range(bands.shape[1] if only[0] < 0 else int(only[0]) + 1):
            same = bands[:, k][:, None] == bands[:, k][None, :]
            shared = same & ~shared if k == only[0] else shared | same
        able = np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :])
        # Within a block of its own pair (i, i) all pairs count, between two blocks those across.
        across = np.ones_like(shared) if i == j else block[:, None] != block[None, :]
        pairs = np.triu(shared & able & across, 1)
        busy = np.flatnonzero(pairs.any(0) | pairs.any(1))
        if not len(busy):
            return empty
        both = _common([sets[k] for k in busy])
        own = size[busy]
        found = pairs[np.ix_(busy, busy)] & (both >= similarity * (own[:, None] + own[None, :] - both) - 1e-9)
        linked = (found | found.T).astype(np.int64) @ weight[busy]
        root = np.arange(len(busy))
        for a, b in zip(*np.nonzero(found)):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        out = []
        for k in np.flatnonzero(linked):
            r = k
            while root[r] != r:
                r = root[r]
            out.append((nodes[busy[k]], nodes[busy[r]], int(linked[k])))
        return pa.table({"node": pa.array([x[0] for x in out], pa.binary()), "peer": pa.array([x[1] for x in out], pa.binary()),
                         "links": pa.array([x[2] for x in out], pa.int64())})
    return task


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every pair of sets: products of the incidence matrix, some columns at a time."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[column] > 1
    row, column = row[often], column[often]
    number = np.cumsum(times > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    wide = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [first, first + wide])
        there = np.zeros((len(sets), wide), dtype=np.float32)
        there[row[a:b], column[a:b] - first] = 1
        out += there @ there.T
    return out


def ngram_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group of linked documents), copy_id (smallest doc_id with the
    same n-gram set), n_links (number of other documents whose similarity to it is at least ``similarity``)."""
    folder = scratch(docs.sparkSession)
    bands, rows = choose_bands(similarity, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = saved(texts.mapInArrow(_sign(n, bands, rows), "doc_id long, node binary, bands array<long>"), "signed", folder)
    classes = saved(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("size"), F.any_value("bands").alias("bands")), "classes", folder)
    spread = classes.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"),
                                              F.bit_xor(F.xxhash64("node")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("d2"))
    # Buckets with the same members are one bucket, that of the lowest band.
    buckets = saved(buckets.filter("n > 1").groupBy("n", "d1", "d2", "first").agg(F.min(F.struct("band", "h")).alias("b"))
                    .select("b.band", "b.h", "n", "first"), "buckets", folder)
    members = saved(spread.join(buckets, ["band", "h"]).select("band", "h", "n", "first", "node"), "members", folder)
    roots = saved(components(members.select(F.col("node").alias("u"), F.col("first").alias("v"))), "roots", folder)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("total"))
    whole = F.col("total") <= 16 * BLOCK
    unit = attach(roots, sizes.withColumn("n", F.col("total")), "root", roots.count())
    units = unit.filter(whole).select(
        "node", F.col("root").alias("unit"), F.lit(-1).alias("band"), F.col("total").alias("n")).unionByName(
        members.join(unit.filter(~whole).select("node"), "node").select(
            "node", F.md5(F.concat_ws(",", "band", "h")).cast("binary").alias("unit"), "band", "n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("node"), blocks)
    targets = (units.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
               .groupBy("node").agg(F.collect_list(F.struct("unit", "band", "block", F.least("block", "other").alias("i"),
                                                            F.greatest("block", "other").alias("j"))).alias("targets")))
    wanted = targets.join(classes, "node")
    sent = (texts.mapInArrow(_pack, "doc_id long, packed binary").join(wanted, F.col("doc_id").eqNullSafe(F.col("copy_id")))
            .select("node", "bands", "size", "packed", F.explode("targets").alias("t"))
            .select("node", "bands", "size", "packed", "t.*"))
    links = saved(sent.groupBy("unit", "i", "j").applyInArrow(_verify(n, similarity), "node binary, peer binary, links long"), "links", folder)
    group = saved(components(links.select(F.col("node").alias("u"), F.col("peer").alias("v"))), "groups", folder)
    first = group.join(classes.select("node", "copy_id"), "node").groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    grouped = attach(group, first, "root", group.count()).select("node", "class_id")
    result = (classes.select("node", "copy_id", "size").join(grouped, "node", "left")
              .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
              .select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
                      (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    return (signed.select("doc_id", "node").join(saved(result, "result", folder), "node", "left")
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
