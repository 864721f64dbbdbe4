"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Method: texts are cut into pre-tokens ("words") by the pattern. A chunk of texts becomes one row: its distinct words, and each word
position as a number into them. The words of all chunks are shuffled by word, so that each distinct word is encoded once in the
whole corpus; its ids go back to the chunks and are put in place by position. The layout of chunks is written bucketed by chunk,
so only words and ids are shuffled, never texts.

Defined cases: null text counts as empty and gives no ids. Special tokens are ordinary text. Rows that repeat a doc_id each get
their own row; a null doc_id stays null. A very long text is a chunk of its own. The output has doc_id and ids only, so other
columns of the input cannot clash.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import pieces, scratch

CHUNK = 8 << 20
#: Distinct words of chunks that one encoding group gets, about.
GROUP = 200_000

CHUNKS = "chunk long, doc_ids array<long>, lengths array<int>, codes binary, words array<string>"


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, compressed: most of them are small."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _open(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).reshape(-1)


def _squeeze_words(own: pa.Array) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in own.to_pylist()]
    return _squeeze(np.array([len(w) for w in raw], np.int32)), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def _open_words(lengths: bytes, packed: bytes) -> pa.Array:
    size = _open(lengths)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(zstandard.ZstdDecompressor().decompress(packed)))


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver; its size does not depend on the data."""
    return Path(path).read_bytes()


@functools.lru_cache(maxsize=2)
def _table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_table(ranks), special_tokens={})


def _chunks(pattern: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = regex.compile(pattern).findall, TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, size=CHUNK)):
            seen: dict[str, int] = {}
            codes, lengths = [], []
            for text in batch.column("text").to_pylist():
                found = split(text) if text else []
                lengths.append(len(found))
                codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found)))
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number]),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([_squeeze(np.concatenate(codes))], pa.binary()),
                pa.array([list(seen)], pa.list_(pa.string())),
            ], ["chunk", "doc_ids", "lengths", "codes", "words"])
    return task


def _deal(groups: int):
    """One row per chunk and group of words: the words and their numbers in the chunk."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own in zip(batch.column("chunk").to_pylist(), batch.column("words")):
                own = own.values
                if not len(own):
                    continue
                group = (pd.util.hash_array(own.to_numpy(zero_copy_only=False), categorize=False) % groups).astype(np.int64)
                order = np.argsort(group, kind="stable")
                filled, first = np.unique(group[order], return_index=True)
                parts = np.split(order, first[1:])
                packed = [_squeeze_words(own.take(pa.array(p))) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(filled), pa.array(np.full(len(filled), chunk, dtype=np.int64)),
                    pa.array([_squeeze(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                    pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary()),
                ], ["grp", "chunk", "codes", "lengths", "words"])
    return task


def _encode(ranks, pattern: str):
    def task(table: pa.Table) -> pa.Table:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        parts = [_open_words(*x) for x in zip(table["lengths"].to_pylist(), table["words"].to_pylist())]
        words = pa.concat_arrays(parts).dictionary_encode()
        each = [encode(w) for w in words.dictionary.to_pylist()]
        size = np.array([len(x) for x in each], dtype=np.int32)
        start = np.cumsum(size) - size
        flat = np.fromiter((i for x in each for i in x), np.int32, int(size.sum()))
        at = words.indices.to_numpy()
        ids, sizes = [], []
        for part in np.split(at, np.cumsum([len(p) for p in parts])[:-1]):
            sizes.append(_squeeze(size[part]))
            ids.append(_squeeze(flat[_gather(start[part], size[part])]))
        return pa.table({"chunk": table["chunk"], "codes": table["codes"],
                         "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})
    return task


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start..start+size of every pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _assemble(layout: pa.Table, encoded: pa.Table) -> pa.Table:
    """The ids of each text of one chunk, in the order of its word positions."""
    row = layout.slice(0, 1)
    codes = _open(row["codes"][0].as_py())
    lengths = np.array(row["lengths"][0].as_py(), dtype=np.int64)
    none = [np.zeros(0, np.int32)]
    words = np.concatenate([np.cumsum(_open(x)) for x in encoded["codes"].to_pylist()] or none)
    sizes, ids = (np.concatenate([_open(x) for x in encoded[name].to_pylist()] or none) for name in ("sizes", "ids"))
    size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    size[words] = sizes
    start[words] = np.cumsum(sizes) - sizes
    own = size[codes]
    total = np.concatenate([[0], np.cumsum(own)])
    offsets = total[np.concatenate([[0], np.cumsum(lengths)])]
    flat = ids[_gather(start[codes], own)]
    return pa.table({"doc_id": row["doc_ids"].combine_chunks().flatten(),
                     "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of docs, as the tiktoken library encodes ordinary text."""
    spark = docs.sparkSession
    path = scratch(spark)
    name, shared = f"bpe_{path.rsplit('-', 1)[1]}", spark.sparkContext.broadcast(ranks)
    chunks = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunks(pattern), CHUNKS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (chunks.write.option("path", f"{path}/chunks").option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name))
    layout = spark.table(name)
    groups = layout.agg(F.sum(F.size("words"))).first()[0] or 0
    encoded = (layout.select("chunk", "words").mapInArrow(_deal(max(1, -(-groups // GROUP))), "grp long, chunk long, codes binary, lengths binary, words binary")
               .groupBy("grp").applyInArrow(_encode(shared, pattern), "chunk long, codes binary, sizes binary, ids binary"))
    return (layout.drop("words").groupBy("chunk").cogroup(encoded.groupBy("chunk"))
            .applyInArrow(_assemble, "doc_id long, ids array<int>"))


def _decode(ranks):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: raw for raw, i in _table(ranks.value).items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        size = np.array([len(p) for p in parts], dtype=np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                own = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                out.append(flat[_gather(start[own], size[own])].tobytes())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])
    return task


def decode(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """tokens (with a column ids) plus ``decoded``, the bytes of the ids. Null ids decode to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    kept = tokens.drop("decoded")
    kinds = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(_decode(shared), f"{kinds}, decoded binary")
