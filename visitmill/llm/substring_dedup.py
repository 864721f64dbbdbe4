"""Removing passages that stand earlier in the corpus, word by word.

Method: every window of ``width`` words has a minimiser, the leftmost of its m-grams with the smallest hash. Consecutive windows with
the same minimiser travel as one packed string to the minimiser's bucket; equal windows always meet there. Buckets are sorted by
minimiser, text and place: a string that was seen before is a repeat as a whole, and different strings of one minimiser are cut
into windows, whose first places decide. Strings travel in compressed blocks and are sorted by Spark, so no task holds a bucket.
A minimiser with more than ``MANY`` different strings is not held either: its windows are grouped by Spark (``_grouped``).

Defined cases: null text has no words; texts with fewer words than ``width`` lose nothing. A null doc_id comes before all others.
Rows that repeat a doc_id are texts of their own, ordered by doc_id and start alone, so that equal windows at the same start of
rows with one doc_id all stay. The output has only the columns named below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import PIECE, arrow, pieces, saved, scratch, small_batches, words

GRAM = 4
#: Different strings of one minimiser that a task holds at once.
MANY = 20_000
NULL_ID = -(1 << 63)
#: Bytes of strings that wait to be compressed together, and how hard: blocks of few strings compress badly, and they are most of the shuffle.
BLOCK, LEVEL = 16 << 20, 6
#: Bytes of text cut at once: numbers of each byte and word take some fifty times as much.
STEP = PIECE // 8

BLOCKS = pa.schema([("p", pa.int32()), ("block", pa.binary())])
STRINGS = pa.schema([("mini", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32())])
FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())])
FOUND_TYPE = "doc_id long, tag long, start int, stop int, text string"


def plain(texts: pa.Array) -> pa.Array:
    """Words joined by one blank."""
    return pc.utf8_trim(pc.replace_substring_regex(texts.fill_null(""), r"[\x20\x09-\x0D]+", " "), " ")


def _tag(text: str | None) -> int:
    """Spark's xxhash64 of the text."""
    return (xxhash.xxh64_intdigest((text or "").encode(), seed=42) ^ (1 << 63)) - (1 << 63)


def _blocks(waiting: list[tuple], squeeze) -> Iterator[pa.RecordBatch]:
    """One compressed block for each bucket: numbers of all strings, then their text."""
    *numbers, begin, end, texts = zip(*waiting)
    shift = np.cumsum([0, *map(len, texts)])
    begin, end = (np.concatenate([x + at for x, at in zip(places, shift)]) for places in (begin, end))
    bucket, *numbers = (np.concatenate(x) for x in numbers)
    data = b"".join(texts)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.unique(bucket[order], return_index=True)[1], len(order))
    out: dict[str, list] = {"p": [], "block": []}
    size = 0
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        out["p"].append(int(bucket[own[0]]))
        out["block"].append(squeeze(b"".join([
            np.int64(len(own)).tobytes(), *[x[own].tobytes() for x in numbers], (end[own] - begin[own]).astype(np.int32).tobytes(),
            *[data[s:e] for s, e in zip(begin[own].tolist(), end[own].tolist())]])))
        size += len(out["block"][-1])
        if size >= PIECE:
            yield arrow(out, BLOCKS)
            out, size = {"p": [], "block": []}, 0
    yield arrow(out, BLOCKS)


def _cut(width: int, buckets: int):
    """Blocks of packed strings, one per bucket that the texts at hand touch. Texts wait as they are, and are cut into strings block by block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        waiting: list[tuple] = []
        held = 0
        for batch in pieces(batches, size=STEP):
            found = words(plain(batch.column("text")))
            first, _ = found.windows(width)
            if not len(first):
                continue
            _, gram = found.windows_all(GRAM)
            least, smallest = first.copy(), gram[first]
            for k in range(1, width - GRAM + 1):
                now = gram[first + k]
                less = now < smallest
                np.copyto(smallest, now, where=less)
                np.copyto(least, first + k, where=less)
            doc = found.doc[first]
            new = np.ones(len(first), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(first)) - 1
            mini = gram[least[head]]
            begin, end = found.start[first[head]], found.end[first[tail] + width - 1]
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)[doc[head]]
            tags = np.array([_tag(t) for t in batch.column("text").to_pylist()], dtype=np.int64)[doc[head]]
            place = (first[head] - found.bounds()[doc[head]]).astype(np.int32)
            bucket = (mini % np.uint64(buckets)).astype(np.int32)
            waiting.append((bucket, mini, ids, tags, place, begin, end, found.data))
            held += int((end - begin).sum())
            if held >= BLOCK:
                yield from _blocks(waiting, squeeze)
                waiting, held = [], 0
        if waiting:
            yield from _blocks(waiting, squeeze)
    return task


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for block in batch.column("block"):
            raw = open_(block.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            mini, ids, tags = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * k) for k in range(3))
            place, size = (np.frombuffer(raw, np.int32, n, 8 + 24 * n + 4 * n * k) for k in range(2))
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            text = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[8 + 32 * n:]))
            yield pa.RecordBatch.from_arrays([pa.array(mini), text, pa.array(ids), pa.array(tags), pa.array(place)], schema=STRINGS)


class _Minimiser:
    """The strings of one minimiser, as they come sorted by text and place."""

    def __init__(self, width: int, out: dict[str, list]) -> None:
        self.width, self.out, self.first, self.many = width, out, [], False

    def emit(self, doc: int, tag: int, start: int, stop: int, text: str | None = None) -> None:
        for name, value in zip(("doc_id", "tag", "start", "stop", "text"), (doc, tag, start, stop, text)):
            self.out[name].append(value)

    def add(self, text: str, doc: int, tag: int, start: int) -> None:
        if self.last != text:
            self.last, self.at = text, (doc, start)
            self.first.append((text, doc, tag, start))
            if len(self.first) > MANY:
                self.many = True
                self.hand_over()
        elif self.at < (doc, start):
            self.emit(doc, tag, start, start + text.count(" ") + 1)
        else:  # a row that repeats the doc_id, at the same start
            self.first.append((text, doc, tag, start))

    last: str | None = None

    def hand_over(self) -> None:
        for text, doc, tag, start in self.first:
            self.emit(doc, tag, start, -1, text)
        self.first = []

    def close(self) -> None:
        if self.many:
            self.hand_over()
            return
        if len(self.first) < 2:
            return
        earliest: dict[str, tuple[int, int]] = {}
        cut = []
        for text, doc, tag, start in self.first:
            parts = text.split(" ")
            own = [" ".join(parts[k: k + self.width]) for k in range(len(parts) - self.width + 1)]
            cut.append(own)
            for k, window in enumerate(own):
                place = (doc, start + k)
                if earliest.setdefault(window, place) > place:
                    earliest[window] = place
        for (_, doc, tag, start), own in zip(self.first, cut):
            for k, window in enumerate(own):
                if earliest[window] < (doc, start + k):
                    self.emit(doc, tag, start + k, start + k + self.width)


def _repeats(width: int):
    """Places of repeated words, from strings sorted by minimiser, text, doc_id and start."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        current, group = None, _Minimiser(width, out)
        for batch in batches:
            if not batch.num_rows:
                continue
            minis = batch.column("mini").to_numpy()
            heads = np.append(np.flatnonzero(np.append(True, minis[1:] != minis[:-1])), len(minis))
            columns = [batch.column(n) for n in ("text", "doc_id", "tag", "start")]
            for k in range(len(heads) - 1):
                a, b = int(heads[k]), int(heads[k + 1])
                inner = 0 < k < len(heads) - 2
                if inner and b - a == 1:
                    continue  # a minimiser with one string has no repeats
                if minis[a] != current:
                    group.close()
                    current, group = minis[a], _Minimiser(width, out)
                for row in zip(*(c[a:b].to_pylist() for c in columns)):
                    group.add(*row)
            if out["start"]:
                yield arrow(out, FOUND)
                for values in out.values():
                    values.clear()
        group.close()
        yield arrow(out, FOUND)
    return task


def _windows(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in FOUND}
            for doc, tag, start, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "tag", "start", "text"))):
                parts = text.split(" ")
                for k in range(len(parts) - width + 1):
                    for name, value in zip(out, (doc, tag, start + k, start + k + width, " ".join(parts[k: k + width]))):
                        out[name].append(value)
            yield arrow(out, FOUND)
    return task


def _grouped(strings: DataFrame, width: int) -> DataFrame:
    """Repeated windows of handed-over strings: the first place of each window by a grouping, compared by a join."""
    cut = strings.mapInArrow(_windows(width), FOUND_TYPE)
    first = cut.groupBy("text").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return cut.join(first, "text").filter(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "tag", "start", "stop")


def repeated_places(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, tag, start, stop): word ranges covered by windows that stand earlier; tag tells rows with one doc_id apart."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strings = texts.mapInArrow(_cut(width, buckets), "p int, block binary").repartitionById(buckets, "p").mapInArrow(
        _unpack, "mini long, text string, doc_id long, tag long, start int")
    with small_batches(spark):
        found = saved(strings.sortWithinPartitions("mini", "text", "doc_id", "start").mapInArrow(_repeats(width), FOUND_TYPE),
                      "found", scratch(spark))
    return found.filter("stop >= 0").drop("text").unionByName(_grouped(found.filter("stop < 0"), width))


def _pack(text):
    return None if text is None else zstandard.ZstdCompressor(level=3).compress(text.encode())


def _remove(packed, starts, stops):
    """Text, its words before, and how many of them go."""
    own = "" if packed is None else plain(pa.array([zstandard.ZstdDecompressor().decompress(packed).decode()]))[0].as_py()
    parts = own.split(" ") if own else []
    if not starts:
        return own, len(parts), 0
    change = np.zeros(len(parts) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    gone = np.cumsum(change[:-1]) > 0
    return " ".join(p for p, g in zip(parts, gone.tolist()) if not g), len(parts), int(gone.sum())


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """One row per input row: doc_id, text (the words that stay, joined by one blank), n_words before, n_removed.

    Texts are packed and cleaned row by row: plain UDFs get a hundred rows at once, Arrow batches would hold 64 MB of text on both sides.
    """
    places = (repeated_places(docs, width).groupBy("doc_id", "tag")
              .agg(F.collect_list(F.struct("start", "stop")).alias("r"))
              .select(F.col("doc_id").alias("id"), "tag", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops")))
    pack = F.udf(_pack, "binary", useArrow=False)
    remove = F.udf(_remove, "text string, n_words long, n_removed long", useArrow=False)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    packed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("id"),
                         F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), pack(text).alias("packed"))
    return (packed.join(places, ["id", "tag"], "left").select("doc_id", remove("packed", "starts", "stops").alias("r"))
            .select("doc_id", "r.text", "r.n_words", "r.n_removed"))
