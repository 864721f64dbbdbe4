"""What the operators share: a scratch folder all executors reach, and numpy hashing of whole Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts mean it: blank and \\t \\n \\v \\f \\r.
SPACE = r"[\x20\x09-\x0D]"
#: Text held by one step of a task, in bytes; a longer document is handled alone.
PIECE = 1 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="visitmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or scratch(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 * PIECE) -> Iterator[None]:
    """What runs meanwhile passes at most about ``size`` bytes between the JVM and Python at once: rows of long texts fill 64 MB otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --------------------------------------------------------------------------------------------------------------------
# Hashing without a Python step per word

_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _ranged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end] that depends on the values alone, not on where they stand."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _powers(_INVERSE, len(values) + 1)[starts]


@dataclass
class Words:
    """All words of a run of texts, in order. start and end are byte places in data, doc is the text's number."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    docs: int

    def bounds(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words within one text."""
        count = max(0, len(self.hash) - n + 1)
        first = np.arange(count)
        first = first[self.doc[:count] == self.doc[n - 1: n - 1 + count]]
        return first, mix(_ranged(self.hash, first, first + n))

    def windows_all(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for every run of n words, also across texts."""
        first = np.arange(max(0, len(self.hash) - n + 1))
        return first, mix(_ranged(self.hash, first, first + n))


def words(texts: pa.Array) -> Words:
    """Words (runs without white space) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    filled = at[1:] > at[:-1]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    before[at[:-1][filled]] = False
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    after[at[1:][filled] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(raw.tobytes(), start, end, doc, mix(_ranged(_BYTE[raw], start, end)), len(texts))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text and at most ``rows`` rows; one longer text stands alone."""
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size if len(lengths) else lengths
        cuts = sorted({0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), *range(0, batch.num_rows, rows), batch.num_rows})
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def arrow(table: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table[f.name], type=f.type) for f in schema], schema=schema)


def tiles(batches: Iterator[pa.RecordBatch], key: str, tile: int, pack: int) -> Iterator[tuple[pa.Table, list, list]]:
    """Rows in order of ``key``, as blocks of whole keys or, where one key holds more than ``tile`` rows, pieces of it.

    Yields (block, packs, open): packs are row ranges made of whole keys, of about ``pack`` rows or one larger key; open lists (number,
    start, end) of pieces of a key that may go on in another block or task. Numbers tell the pieces of a key apart.
    """
    held, last, begun = None, None, False
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        while held.num_rows > tile:
            head = held.column(key).slice(0, tile + 1).to_numpy()
            borders = np.flatnonzero(head[1:] != head[:-1]) + 1
            cut = int(borders[-1]) if len(borders) else tile
            block, held = held.slice(0, cut).combine_chunks(), held.slice(cut)
            yield block, *_ranges(block, key, pack, not begun or block.column(key)[0].as_py() == last, not len(borders))
            last, begun = block.column(key)[-1].as_py(), True
    if held is not None and held.num_rows:
        block = held.combine_chunks()
        yield block, *_ranges(block, key, pack, not begun or block.column(key)[0].as_py() == last, True)


def _ranges(block: pa.Table, key: str, pack: int, before: bool, after: bool) -> tuple[list, list]:
    keys = block.column(key).to_numpy()
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).tolist()
    packs, start, to = [], 0, 0
    for end in ends:
        if end - start > pack and to > start:
            packs.append((start, to))
            start = to
        to = end
    packs.append((start, to))
    pieces_ = {}
    if before:
        pieces_[0] = ends[0]
    if after:
        pieces_[ends[-2] if len(ends) > 1 else 0] = ends[-1]
    return packs, [(uuid.uuid4().int >> 65, a, b) for a, b in pieces_.items()]


def attach(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per ``key`` whose column n says how many rows the key has at least.

    Keys with more than a thousandth of ``total`` rows are fewer than a thousand times (rows / total); they are joined by broadcast, so
    that a hot key's rows never meet in one task. All others are joined by shuffle.
    """
    hot = table.filter(F.col("n") * 1000 > total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n"), key)
    return rows.join(F.broadcast(hot.drop("n")), key).unionByName(cold)
