"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter.

A word is a row of letter counts. One edit changes few counts: words of one length that differ by a replaced letter have a squared
distance of two, words of neighbouring lengths that differ by an inserted one have a squared distance of one. Products of blocks of
such rows (Gram matrices) give the distances of all pairs of a block; pairs within two are then compared letter by letter.

Not every word meets every other. The letters are dealt to m parts, in turn by how frequent they are. An edit touches at most two
parts, so two near words agree in their counts on some choice of m - 2 parts: each word is sent once per choice, under a hash of the
counts it has there, and only equal hashes meet. A pair that meets under several choices counts under the first. How many parts are
best is measured on the words (more parts: more copies, smaller groups); it changes no result.

Rows are dealt by ranges of (hash, length), so a hash that very many words share spreads over tasks. A task holds TILE words of one
hash at a time; tiles of a hash that fills more than one are written out and compared pair by pair.

Null and empty texts have no words. A null doc_id leaves the words of its text as they are (there is no number to hash); rows that
repeat a doc_id all count. Text may be of any length. No words give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import mix, saved, scratch, tiles

#: Letters a word may hold: a to z, and the code points from C0 to FF.
COLUMNS = 26 + 64
#: Words of one hash that a task compares at once, and rows of one product where hashes are small.
TILE, PACK = 1024, 256
#: Numbers of parts to choose from.
PARTS = range(3, 9)
#: Rough costs in seconds of one compared pair and of one row sent.
PAIR, ROW = 2e-8, 6e-6

_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[ord("a"): ord("z") + 1] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, COLUMNS)
_WEIGHT = np.random.default_rng(91).integers(0, 1 << 63, COLUMNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, least_chars: int = 6, least_times: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with planted slips: a run whose crc32 (with its doc_id) ``every`` divides loses a letter."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}"), F.lit(0)))
    low = docs.select(F.col("doc_id").cast("string").alias("doc"), run.alias("run")).select(
        "doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))
    word = F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_times)


# --------------------------------------------------------------------------------------------------------------------
# Letter counts and the hashes under which words meet

def _counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts of each word, and word lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    letters = _COLUMN[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    row = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(row * COLUMNS + letters, minlength=len(words) * COLUMNS).reshape(len(words), COLUMNS), lengths


def _deal(frequency: np.ndarray, m: int) -> np.ndarray:
    """Part of each letter: back and forth by falling frequency, so that parts tell words apart equally well."""
    turn = np.concatenate([np.arange(m), np.arange(m)[::-1]])
    part = np.empty(COLUMNS, dtype=np.int64)
    part[np.argsort(-frequency, kind="stable")] = np.resize(turn, COLUMNS)
    return part


def _choices(frequency: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (letters x choices) and an offset per choice of the parts that two near words agree on."""
    part = _deal(frequency, m)
    left_out = list(combinations(range(m), 2))
    weights = np.stack([np.where(np.isin(part, pair), np.uint64(0), _WEIGHT) for pair in left_out], axis=1)
    return weights, mix(np.arange(1, len(left_out) + 1, dtype=np.uint64) * np.uint64(m))


def _hashes(counts: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mix(counts.astype(np.uint64) @ weights + offsets)


def _letter_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COLUMNS, dtype=np.int64)
    for batch in batches:
        total += _counts(batch.column("word").to_pylist())[0].sum(axis=0)
    yield pa.RecordBatch.from_pydict({"letter": pa.array(np.arange(COLUMNS)), "n": pa.array(total)})


def _trial(frequency: np.ndarray) -> Callable:
    """Hash of each word under the first choice, for every number of parts."""
    first = {m: tuple(x[..., :1] for x in _choices(frequency, m)) for m in PARTS}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, _ = _counts(batch.column("word").to_pylist())
            for m, (weights, offsets) in first.items():
                yield pa.RecordBatch.from_pydict({"m": pa.array(np.full(len(counts), m, dtype=np.int32)),
                                                  "key": pa.array(_hashes(counts, weights, offsets)[:, 0].view(np.int64))})
    return task


def _spread(frequency: np.ndarray, m: int) -> Callable:
    weights, offsets = _choices(frequency, m)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lengths = _counts(batch.column("word").to_pylist())
            keys = _hashes(counts, weights, offsets)
            at = pa.array(np.repeat(np.arange(len(counts)), keys.shape[1]))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys.reshape(-1).view(np.int64)), "length": pa.array(np.repeat(lengths, keys.shape[1])),
                "word": batch.column("word").take(at), "n": batch.column("n").take(at)})
    return task


# --------------------------------------------------------------------------------------------------------------------
# Products of blocks

def _one_edit(words: list[str], i: np.ndarray, j: np.ndarray, longest: int) -> np.ndarray:
    """Which pairs (the first not longer than the second) differ by exactly one edit."""
    if longest > 256:
        return np.array([_one_edit_long(words[a], words[b]) for a, b in zip(i, j)], dtype=bool)
    size = np.array([len(w) for w in words])
    left = np.zeros((len(words), longest), dtype=np.uint8)
    right = np.zeros((len(words), longest), dtype=np.uint8)
    for k, w in enumerate(words):
        letters = np.frombuffer(w.encode("latin-1"), dtype=np.uint8)
        left[k, :len(w)] = letters
        right[k, longest - len(w):] = letters
    same_start = np.logical_and.accumulate(left[i] == left[j], axis=1).sum(axis=1)
    same_end = np.logical_and.accumulate((right[i] == right[j])[:, ::-1], axis=1).sum(axis=1)
    # Blank ends agree with blank ends only where both words have ended.
    same_start, same_end = np.minimum(same_start, size[i]), np.minimum(same_end, size[i])
    return same_start + same_end >= size[j] - 1


def _one_edit_long(a: str, b: str) -> bool:
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def _near(words: list[str], first: np.ndarray, keys: np.ndarray, choices: tuple[np.ndarray, np.ndarray], split: int | None = None):
    """Numbers (i, j) of near words that meet under the hash ``keys`` and under none before it. ``split`` compares words before it with those after."""
    counts, lengths = first
    kind = np.float32 if lengths.max() < 2000 else np.float64
    rows = counts.astype(kind)
    a, b = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    norm = (rows * rows).sum(axis=1)
    distance = norm[a, None] + norm[None, b] - 2 * (rows[a] @ rows[b].T)
    i, j = np.nonzero(distance <= 2)
    j = j + (split or 0)
    if split is None:
        i, j = i[i < j], j[i < j]
    apart = np.abs(lengths[i] - lengths[j])
    fit = (keys[i] == keys[j]) & (apart <= 1)
    i, j = i[fit], j[fit]
    if not len(i):
        return i, j
    i, j = np.where(lengths[i] <= lengths[j], i, j), np.where(lengths[i] <= lengths[j], j, i)
    used, number = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = number[:len(i)], number[len(i):]
    hashes, own = _hashes(counts[used], *choices), keys[used].view(np.uint64)
    at = (hashes[x] == hashes[y]).argmax(axis=1)
    fit = (hashes[x, at] == own[x]) & _one_edit([words[k] for k in used], x, y, int(lengths[used].max()))
    i, j = i[fit], j[fit]
    differ = np.array([words[a] != words[b] for a, b in zip(i, j)], dtype=bool)
    return i[differ], j[differ]


_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string()),
                    ("key", pa.int64()), ("tile", pa.int64()), ("words", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))])


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """One row per word with near words: how many, and the most frequent one."""
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.diff(a, prepend=-1))
    near = np.diff(start, append=len(a))
    rows = [(words[x], int(c), int(n[y]), words[y]) for x, y, c in zip(a[start], b[start], near)]
    columns = [pa.array(list(c), type=_FOUND.field(k).type) for k, c in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), t) for t in _FOUND.types[4:]], schema=_FOUND)


def _within(frequency: np.ndarray, m: int) -> Callable:
    choices = _choices(frequency, m)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, packs, open_groups in tiles(batches, "key", TILE, PACK):
            words, n = block.column("word").to_pylist(), block.column("n").to_numpy()
            keys = block.column("key").to_numpy()
            for a, b in packs:
                if b - a < 2:
                    continue
                i, j = _near(words[a:b], _counts(words[a:b]), keys[a:b], choices)
                if len(i):
                    yield _best(words[a:b], n[a:b], i, j)
            for number, a, b in open_groups:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, t) for t in _FOUND.types[:4]], pa.array([keys[a]]), pa.array([number]),
                     pa.array([words[a:b]]), pa.array([n[a:b].tolist()], pa.list_(pa.int64()))], schema=_FOUND)
    return task


def _across(frequency: np.ndarray, m: int) -> Callable:
    choices = _choices(frequency, m)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r].as_py() for k in ("key", "words", "ns", "words2", "ns2")}
                words, n = row["words"] + row["words2"], np.array(row["ns"] + row["ns2"], dtype=np.int64)
                i, j = _near(words, _counts(words), np.full(len(words), row["key"]), choices, len(row["words"]))
                if len(i):
                    yield _best(words, n, i, j).select(["word", "near", "form_n", "form"])
    return task


def _near_words(words: DataFrame, folder: str) -> DataFrame:
    """(word, near, form_n, form) per word and block in which it has near words; a pair is in one block only."""
    sums = words.mapInArrow(_letter_sums, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    frequency = np.zeros(COLUMNS, dtype=np.int64)
    for r in sums.collect():  # one row per letter
        frequency[r.letter] = r.n
    sizes = words.mapInArrow(_trial(frequency), "m int, key long").groupBy("m", "key").agg(F.count(F.lit(1)).alias("c"))
    cost = {r.m: len(list(combinations(range(r.m), 2))) * (r.pairs * PAIR + r.rows * ROW)
            for r in sizes.groupBy("m").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"), F.sum("c").alias("rows")).collect()}
    m = min(cost, key=cost.get, default=PARTS[0])
    sent = words.mapInArrow(_spread(frequency, m), "key long, length long, word string, n long")
    dealt = sent.repartitionByRange("key", "length", "word").sortWithinPartitions("key", "length", "word")
    found = saved(dealt.mapInArrow(_within(frequency, m), _schema(_FOUND)), "found", folder)
    part = found.filter("tile IS NOT NULL").select("key", "tile", "words", "ns")
    other = part.select("key", *[F.col(c).alias(f"{c}2") for c in ("tile", "words", "ns")])
    crossed = part.join(other, "key").filter("tile < tile2").mapInArrow(
        _across(frequency, m), "word string, near long, form_n long, form string")
    return found.filter("tile IS NULL").select("word", "near", "form_n", "form").unionByName(crossed)


def _schema(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n), one row per word: its near words, the one it is a variant of, and where that leads.

    A word's form is its most frequent near word (of equally frequent ones the first in code-point order) if that is at least ``times``
    as frequent. Each step of a chain of forms multiplies the count by ``times``, so chains are short and never close a ring.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    folder = scratch(words.sparkSession)
    words = saved(words.select("word", "n"), "words", folder)
    near = _near_words(words, folder).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    rare = -F.col("best.less") >= F.col("n") * times
    marked = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(rare, F.col("best.form")).alias("form"),
        F.when(rare, -F.col("best.less")).alias("form_n")), "marked", folder)
    steps = saved(marked.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps0", folder)
    for number in range(1, 7):  # a chain has fewer than log(2^63) / log(times) < 2^6 words; every round doubles the steps taken
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(further, "root", "left")
        if joined.filter("further IS NOT NULL").isEmpty():
            break
        steps = saved(joined.select("word", F.coalesce("further", "root").alias("root")), f"steps{number}", folder)
    return marked.join(steps, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
