"""Near copies by SimHash, found with an index in Gray order.

A fingerprint has a bit set where more than half of the hashes of a text's word shingles have it. Documents whose fingerprints differ in
few bits are linked; what is linked, also over several links, is one component. A text of fewer words than a shingle has one shingle, all
of it; a text without words (or null) has fingerprint zero, and is linked like any other.

Two fingerprints that differ in k bits or less agree on one of k + 1 blocks of their bits. So the index holds each different fingerprint
k + 1 times, each time with another block in front, and only fingerprints with equal front blocks can meet. Within that, all are
sorted by their rank in the Gray code, where neighbours differ in few bits. Rows are dealt by ranges of the rank: as ranks are
different, no block value is too frequent for that. Runs of LEAF fingerprints are compared at once. A block value that fills more than one
leaf is searched from above: leaves with a common start of the rank form a node, nodes form nodes, and each holds the bits that all below it
share (a mask and a pattern). Two nodes are followed only while their shared bits differ in at most k places; as a node's children share its
bits and more, the differences add up on the way down and cut off whole groups. A pair that could meet under several blocks counts under the first.

Repeated doc_ids are rows of their own; null ones get a component but never name it unless it has no other. Texts may be of any length. No
documents give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.llm.components import components
from visitmill.llm.shared import attach, pieces, saved, scratch, tiles

#: Fingerprints compared at once, and fewer where block values are rare.
LEAF, PACK = 1024, 256
#: Bits of the rank that one level of nodes adds, and the number of leaves of a block value that need no nodes above them.
STEP, FEW = 6, 64
#: Bytes of a long text that are split into words at once.
PART = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = (1 << 64) - 1


# --------------------------------------------------------------------------------------------------------------------
# Fingerprints

def _shingles(text: bytes, n: int) -> Iterator[list[bytes]]:
    """Shingles of a text, some at a time."""
    carry, found, at = [], False, 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        words = carry + text[at:end].split()
        now = [b" ".join(w) for w in zip(*(words[k:] for k in range(n)))]
        if now:
            found = True
            yield now
        carry, at = words[max(0, len(words) - n + 1):], end
    if carry and not found:
        yield [b" ".join(carry)]


def _fingerprints(n: int, seed: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in pieces(batches):
            ones = np.zeros((batch.num_rows, 64), dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            hashes, owners = [], []

            def count() -> None:
                if hashes:
                    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    owner = np.array(owners)
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    ones[owner[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                    total[owner[starts]] += np.diff(starts, append=len(owner))
                hashes.clear()
                owners.clear()
            for k, text in enumerate(batch.column("text")):
                # Lower case of bytes changes A-Z alone, and splits at the white space meant here.
                for some in _shingles((text.as_py() or "").encode().lower(), n):
                    hashes += [digest(s, seed) for s in some]
                    owners += [k] * len(some)
                    if len(hashes) > PART // 16:
                        count()
            count()
            prints = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "code": pa.array(prints.view(np.int64))})
    return task


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, code): 64 bits as a long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_fingerprints(n, seed), "doc_id long, code long")


# --------------------------------------------------------------------------------------------------------------------
# The index

def _edges(bits: int) -> list[int]:
    """Bounds of the bits + 1 blocks, from the highest bit down."""
    return [64 * t // (bits + 1) for t in range(bits + 2)]


def _turned(code: Column, by: int) -> Column:
    return code if not by else F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def _gray_rank(code: Column) -> Column:
    """Place of a code in the Gray order: each bit is the parity of the bits above it and its own."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


def _dealt(codes: DataFrame, bits: int) -> DataFrame:
    """(grp, rank): every code once per block, with that block in front; grp tells the block and its bits in the rank."""
    edges = _edges(bits)
    turns = [F.struct(F.lit(t).alias("turn"), _gray_rank(_turned(F.col("code"), edges[t])).alias("rank")) for t in range(bits + 1)]
    rows = codes.select(F.inline(F.array(*turns)))
    front = F.lit(None).cast("long")
    for t in range(bits + 1):
        front = F.when(F.col("turn") == t, F.shiftrightunsigned("rank", 64 - (edges[t + 1] - edges[t]))).otherwise(front)
    return rows.select((F.col("turn") * (1 << 58) + front).alias("grp"), "rank")


def _links(ranks: np.ndarray, groups: np.ndarray, bits: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (as they were before turning) of pairs within ``bits`` of each other that meet in no earlier block, thinned to a forest of stars."""
    edges = _edges(bits)
    turn = (groups >> 58).astype(np.int64)
    by = np.array(edges, dtype=np.uint64)[turn]
    codes = ranks ^ (ranks >> np.uint64(1))
    codes = np.where(by == 0, codes, (codes >> by) | (codes << ((np.uint64(64) - by) % np.uint64(64))))
    a, b = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    # Turning back changes no distance within a block of codes; equal groups have equal turns.
    i, j = np.nonzero(np.bitwise_count(codes[a, None] ^ codes[None, b]) <= bits)
    j = j + (split or 0)
    fit = (i < j) & (groups[i] == groups[j])
    i, j = i[fit], j[fit]
    differ = codes[i] ^ codes[j]
    for t in range(bits):
        mask = np.uint64((_ALL >> edges[t]) & ~(_ALL >> edges[t + 1]))
        fit = (turn[i] <= t) | ((differ & mask) != 0)
        i, j, differ = i[fit], j[fit], differ[fit]
    return _forest(codes, i, j)


def _forest(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same codes: each with the first of those it is connected to."""
    root = list(range(len(codes)))
    for a, b in zip(i.tolist(), j.tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for k, r in enumerate(root):  # a root is never later than its own members
        root[k] = root[r]
    top = np.array(root)
    member = np.flatnonzero(top != np.arange(len(top)))
    return codes[member], codes[top[member]]


def _found(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64)), "grp": none, "leaf": none,
                                       "every": none, "any": none, "ranks": pa.nulls(len(u), pa.list_(pa.int64()))})


def _within(bits: int) -> Callable:
    """Links inside leaves, and the leaves whose block value may fill more than one."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, packs, open_groups in tiles(batches, "grp", LEAF, PACK):
            groups, ranks = block.column("grp").to_numpy(), block.column("rank").to_numpy().view(np.uint64)
            for a, b in packs:
                if b - a > 1:
                    u, v = _links(ranks[a:b], groups[a:b], bits)
                    if len(u):
                        yield _found(u, v)
            for _, a, b in open_groups:
                codes = ranks[a:b] ^ (ranks[a:b] >> np.uint64(1))
                one = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "u": one, "v": one, "grp": pa.array([groups[a]]), "leaf": pa.array(ranks[a:a + 1].view(np.int64)),
                    "every": pa.array([np.bitwise_and.reduce(codes)]).view(pa.int64()),
                    "any": pa.array([np.bitwise_or.reduce(codes)]).view(pa.int64()),
                    "ranks": pa.array([ranks[a:b].view(np.int64).tolist()], pa.list_(pa.int64()))})
    return task


def _across(bits: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, left, right in zip(*(batch.column(c) for c in ("grp", "ranks", "ranks2"))):
                left, right = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                ranks = np.concatenate([left, right])
                u, v = _links(ranks, np.full(len(ranks), group.as_py()), bits, len(left))
                if len(u):
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})
    return task


def _differences(left: str, right: str) -> Column:
    """Places where two nodes differ for certain: bits all codes below each of them share, with different values."""
    def shared(n: str) -> Column:
        return F.bitwise_not(F.col(f"{n}every").bitwiseXOR(F.col(f"{n}any")))
    return F.bit_count(shared(left).bitwiseAND(shared(right)).bitwiseAND(F.col(f"{left}every").bitwiseXOR(F.col(f"{right}every"))))


def _leaf_pairs(leaves: DataFrame, bits: int, folder: str) -> DataFrame:
    """(grp, a, b): pairs of leaves of one block value that may hold codes within ``bits`` of each other, found from the top down."""
    left = leaves.select("grp", F.col("leaf").alias("a"), F.col("every").alias("l_every"), F.col("any").alias("l_any"))
    right = leaves.select("grp", F.col("leaf").alias("b"), F.col("every").alias("r_every"), F.col("any").alias("r_any"))
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    if sizes.filter(F.col("n") > FEW).isEmpty():
        return left.join(right, "grp").filter((F.col("a") < F.col("b")) & (_differences("l_", "r_") <= bits)).select("grp", "a", "b")
    front = min(b - a for a, b in zip(_edges(bits), _edges(bits)[1:]))
    levels = [*range(front + STEP, 64, STEP), 64]
    pairs = sizes.filter("n > 1").select("grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    above = None
    for level in levels:
        node = F.shiftrightunsigned("leaf", 64 - level) if level < 64 else F.col("leaf")
        parent = F.shiftrightunsigned("leaf", 64 - above) if above else F.lit(0).cast("long")
        nodes = leaves.groupBy("grp", parent.alias("parent"), node.alias("node")).agg(
            F.expr("bit_and(every)").alias("every"), F.expr("bit_or(any)").alias("any"))
        left = nodes.select("grp", F.col("parent").alias("a"), F.col("node").alias("a2"), F.col("every").alias("l_every"), F.col("any").alias("l_any"))
        right = nodes.select("grp", F.col("parent").alias("b"), F.col("node").alias("b2"), F.col("every").alias("r_every"), F.col("any").alias("r_any"))
        pairs = saved(pairs.join(left, ["grp", "a"]).join(right, ["grp", "b"])
                      .filter(((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))) & (_differences("l_", "r_") <= bits))
                      .select("grp", F.col("a2").alias("a"), F.col("b2").alias("b")), f"level{level}", folder)
        above = level
    return pairs.filter("a <> b")


def near_codes(codes: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v): links between different codes that connect all codes within ``bits`` differing bits of each other."""
    if not 1 <= bits <= 15:
        raise ValueError("bits must be between 1 and 15")
    folder = scratch(codes.sparkSession)
    dealt = _dealt(codes, bits).repartitionByRange("grp", "rank").sortWithinPartitions("grp", "rank")
    found = saved(dealt.mapInArrow(_within(bits), "u long, v long, grp long, leaf long, every long, any long, ranks array<long>"), "found", folder)
    links = found.filter("u IS NOT NULL").select("u", "v")
    leaves = found.filter("leaf IS NOT NULL").select("grp", "leaf", "every", "any", "ranks")
    pairs = _leaf_pairs(leaves.drop("ranks"), bits, folder)
    held = leaves.select("grp", "leaf", "ranks")
    both = (pairs.join(held.withColumnRenamed("leaf", "a"), ["grp", "a"])
            .join(held.select("grp", F.col("leaf").alias("b"), F.col("ranks").alias("ranks2")), ["grp", "b"]))
    return links.unionByName(both.select("grp", "ranks", "ranks2").mapInArrow(_across(bits), "u long, v long"))


def simhash_dedup(docs: DataFrame, n: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of its component)."""
    folder = scratch(docs.sparkSession)
    printed = saved(fingerprints(docs, n), "prints", folder)
    codes = saved(printed.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "codes", folder)
    links = saved(near_codes(codes.select("code"), bits), "links", folder)
    group = components(links)
    named = codes.join(group.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("component_id"))
    total = codes.count()
    classes = attach(named.select("code", "root", F.col("n").alias("size")), least, "root", total)
    table = saved(classes.select("code", "component_id", F.col("size").alias("n")), "classes", folder)
    return attach(printed, table, "code", printed.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
