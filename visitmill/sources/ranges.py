"""Byte ranges of text files as lines: from an offset on, split among tasks, and as a stream of files that grow.

A range is read from a line's start; of what lies beyond its last line end nothing is returned, so an unfinished line is read once it is
finished. A large range is split by bytes: a split owns the lines that begin in it, finds the first by looking for the line end before it,
and follows its last line past its own end. Gzip is unpacked as it is read, by one task per file, however large the file.

Files are opened by the tasks themselves (local and shared folders, s3, gs, hdfs; whatever ``pyarrow.fs`` knows).
"""

from __future__ import annotations

import dataclasses
import glob
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, offset long, next_offset long"
#: Bytes read at once, and bytes of a range that one task reads.
CHUNK, SPLIT = 8 << 20, 128 << 20
#: Bytes read at first beyond the end of a split, for the rest of its last line; twice as many each time that was not enough.
BEYOND = 4 << 10
#: Tasks of a look at files beyond which neighbouring splits are read by one task, while it holds no more than ``SPLIT`` bytes.
TASKS = 64
#: First bytes of a file, by which it is known again after a rotation, and how many are needed to follow it to another name.
HEAD, TELLING = 64, 32

_ARROW = pa.schema([("value", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("next_offset", pa.int64())])


@dataclasses.dataclass(frozen=True)
class FileRange(InputPartition):
    """Lines that begin in [start, end) of a file, of the range that reaches from ``low`` to ``high`` (None: the end of the file)."""

    path: str
    start: int = 0
    end: int | None = None
    low: int = 0
    high: int | None = None
    compressed: bool = False
    complete: bool = False


@dataclasses.dataclass(frozen=True)
class Ranges(InputPartition):
    """What one task reads, range after range."""

    parts: tuple[FileRange, ...] = ()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def is_readable(path: str) -> bool:
    """Whether tasks can open the path themselves; some stores only open to the engine's own readers."""
    try:
        filesystem(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def splits(path: str, low: int, high: int, size: int = SPLIT, complete: bool = False) -> list[FileRange]:
    """A plain file's range in pieces of about ``size`` bytes."""
    return [FileRange(path, a, min(a + size, high), low, high, False, complete) for a in range(low, high, size)]


def dealt(parts: list[FileRange], tasks: int = TASKS, most: int = SPLIT) -> list[Ranges]:
    """Splits as tasks, in order: one each or, of more than ``tasks`` of them, as many as together hold a share of the bytes.

    A task costs far more than a small split, and its row in the plan, its answer and its output file are the driver's to hold. Packed
    files, of unknown size, stay alone.
    """
    if len(parts) <= tasks:
        return [Ranges((p,)) for p in parts]
    share = min(most, -(-sum(p.end - p.start for p in parts if not p.compressed) // tasks))
    out, held, filled = [], [], 0
    for part in parts:
        if part.compressed:
            out.append(Ranges((part,)))
            continue
        if held and filled + part.end - part.start > share:
            out.append(Ranges(tuple(held)))
            held, filled = [], 0
        held.append(part)
        filled += part.end - part.start
    return [*out, Ranges(tuple(held))] if held else out


def read_ranges(task: Ranges | None) -> Iterator[pa.RecordBatch]:
    """Lines of all ranges of a task; no files make one task of nothing."""
    for part in task.parts if task else ():
        yield from read_range(part)


def read_range(part: FileRange, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    files, name = filesystem(part.path)
    if part.compressed:
        stream = files.open_input_stream(name, compression="gzip")
        skip = part.start
        while skip and (gone := stream.read(min(skip, chunk))):
            skip -= len(gone)
        yield from _lines(stream, part.start, part, False, chunk)
    else:
        stream = files.open_input_file(name)
        behind = part.start > part.low
        stream.seek(part.start - behind)
        yield from _lines(stream, part.start - behind, part, behind, chunk)
    stream.close()


def _lines(stream: pa.NativeFile, at: int, part: FileRange, behind: bool, chunk: int) -> Iterator[pa.RecordBatch]:
    """Lines of a stream that stands at offset ``at``; ``behind``: the first one belongs to the split before."""
    begun, read, last, beyond = [], at, False, BEYOND
    while not last and (part.end is None or at < part.end):
        # A split far smaller than a chunk reads little more than its own bytes.
        want = chunk if part.end is None else min(chunk, max(part.end - read, 0) + beyond)
        want, beyond = want if part.high is None else min(want, part.high - read), min(2 * beyond, chunk)
        now = stream.read(want) if want > 0 else b""
        read += len(now)
        last = not now
        cut = now.rfind(b"\n")
        if cut < 0 and not last:
            begun.append(now)
            continue
        data = b"".join(begun) + now[:cut + 1]
        begun = [now[cut + 1:]] if not last else []
        if last and not (part.complete and data):
            return
        lines = data.removesuffix(b"\n").split(b"\n")
        ends = at + np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        starts = np.concatenate([[at], ends[:-1]])
        at = int(ends[-1])
        if last:
            ends[-1] -= 1
        keep = slice(int(behind), len(lines) if part.end is None else int(np.searchsorted(starts, part.end)))
        behind = False
        if lines[keep]:
            yield pa.RecordBatch.from_arrays([_texts(lines[keep]), pa.array([part.path] * len(lines[keep]), pa.string()),
                                              pa.array(starts[keep]), pa.array(ends[keep])], schema=_ARROW)


def _texts(lines: list[bytes]) -> pa.Array:
    lines = [x.removesuffix(b"\r") for x in lines]
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


# ---- ranges from a table ----------------------------------------------------------------------------------------

def _read_all(complete: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from read_range(FileRange(r["path"], r["a"], r["b"], r["start"], r["end"], r["compressed"], complete or r["compressed"]))
    return task


def scan_ranges(ranges: DataFrame, split: int = SPLIT, complete: bool = False) -> DataFrame:
    """(value, path, offset, next_offset) of the lines of (path, start, end, compressed), in any number of tasks.

    ``end`` may be null for packed files. ``complete`` also returns a last line without a line end; packed files are always complete.
    The greatest ``next_offset`` of a file is where to go on later.
    """
    rows = ranges.select("path", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                         F.coalesce("compressed", F.lit(False)).alias("compressed"))
    plain = rows.filter(~F.col("compressed") & (F.col("end") > F.col("start")))
    plain = plain.withColumn("a", F.explode(F.sequence("start", F.col("end") - 1, F.lit(split).cast("long")))).withColumn(
        "b", F.least("end", F.col("a") + split))
    none = F.lit(None).cast("long")
    packed = rows.filter("compressed").withColumns({"end": none, "a": F.col("start"), "b": none})
    # Numbered, since a row is small whatever its split holds: without, adaptive execution would read all files in one task.
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plain.unionByName(packed).repartition(tasks, "path", "a").mapInArrow(_read_all(complete), SCHEMA)


def scan_changes(changes: DataFrame, current: DataFrame, **options) -> DataFrame:
    """Lines of what ``detect_changed_files`` found new, grown, rotated or changed, up to the sizes of the ``current`` listing."""
    read = changes.filter(F.col("start_offset").isNotNull()).select("source_id", "path", F.col("start_offset").alias("start"))
    sizes = current.select("source_id", "path", F.col("size").alias("end"), "compressed")
    return scan_ranges(read.join(sizes, ["source_id", "path"]), **options)


def list_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size) by the engine's own listing; nothing is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


# ---- ranges as a data source ------------------------------------------------------------------------------------

def find_files(pattern: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of the files that fit a path with ``*``, ``?`` and ``**``, or lie below a folder."""
    scheme = re.match(r"[a-z0-9]+://", pattern)
    files, name = filesystem(pattern if not scheme else pattern.split("*")[0].rsplit("/", 1)[0])
    if scheme:
        name = name.rstrip("/") + pattern[len(pattern.split("*")[0].rsplit("/", 1)[0]):]
    found = re.search(r"[*?\[]", name)
    if found:
        base, wanted = name[:found.start()].rsplit("/", 1)[0] or "/", re.compile(glob.translate(name, recursive=True, include_hidden=True))
    else:
        info = files.get_file_info(name)
        if info.type == fs.FileType.File:
            return [(name, info.size, info.mtime_ns or 0)]
        base, wanted = name, None
    infos = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    before = f"{scheme[0]}" if scheme else ""
    return sorted((before + i.path, i.size, i.mtime_ns or 0) for i in infos
                  if i.type == fs.FileType.File and (wanted.match(i.path) if wanted else not i.base_name.startswith(("_", "."))))


def _first_bytes(path: str) -> str:
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        return f.read(HEAD).hex()


def last_line_end(path: str, size: int, step: int = 1 << 16) -> int:
    """Offset after the last line end within the first ``size`` bytes, looking back from there."""
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        for end in range(size, 0, -step):
            f.seek(max(0, end - step))
            cut = f.read(min(step, end)).rfind(b"\n")
            if cut >= 0:
                return max(0, end - step) + cut + 1
    return 0


class LineRanges(DataSource):
    """``spark.read.format("line_ranges")``: lines of files with their offsets; register with ``spark.dataSource.register``.

    Options: ``path`` (file, folder or pattern), ``start`` and ``end`` (bytes), ``complete`` (also a last line without end),
    ``split`` (bytes per task, or more where that makes over ``TASKS`` tasks), ``compression`` (auto, gz, none). As a stream
    (``readStream``) the checkpoint holds for every file how far it was read: files may grow, be rotated (known by a smaller size or
    other first bytes) or be renamed while they are followed.
    A rotated file starts over, a renamed one goes on where it was; a packed file that changes is read again whole. What was appended
    and then removed between two looks at the folder is not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _is_packed(path: str, options: dict) -> bool:
    kind = options.get("compression", "auto")
    return kind == "gz" or (kind == "auto" and path.lower().endswith(".gz"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Ranges]:
        start, end = int(self.options.get("start", 0)), int(self.options.get("end", 0))
        complete = self.options.get("complete", "false").lower() == "true"
        out = []
        for path, size, _ in find_files(self.options["path"]):
            if _is_packed(path, self.options):
                out.append(FileRange(path, start, low=start, compressed=True, complete=True))
            else:
                out += splits(path, start, min(size, end) if end > 0 else size, int(self.options.get("split", SPLIT)), complete)
        return dealt(out)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per file: offset after its last line end, size, time and first bytes. Files that did not change are not opened again."""
        now = {}
        for path, size, mtime in find_files(self.options["path"]):
            old = self.known.get(path)
            if old and (old["size"], old["mtime"]) == (size, mtime):
                now[path] = old
                continue
            packed = _is_packed(path, self.options)
            now[path] = {"end": size if packed else last_line_end(path, size), "size": size, "mtime": mtime,
                         "head": _first_bytes(path), "packed": packed}
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt(follow(start, end, int(self.options.get("split", SPLIT))))

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back for finished batches."""


def is_same_file(old: dict, new: dict) -> bool:
    """Whether a file of this state can be what became of the old one: not shorter, and the same first bytes."""
    return new["size"] >= old["size"] and new["end"] >= old["end"] and new["head"].startswith(old["head"])


def follow(start: dict, end: dict, split: int = SPLIT) -> list[FileRange]:
    """What is to be read between two states of a folder."""
    moved = {p: s for p, s in start.items() if not s["packed"] and len(s["head"]) >= 2 * TELLING
             and (p not in end or not is_same_file(s, end[p]))}
    out = []
    for path, new in sorted(end.items()):
        old = start.get(path)
        if new["packed"]:
            if old is None or (old["size"], old["mtime"]) != (new["size"], new["mtime"]):
                out.append(FileRange(path, compressed=True, complete=True))
            continue
        if old is not None and is_same_file(old, new):
            begin = old["end"]
        else:
            began = [p for p, s in moved.items() if p != path and is_same_file(s, new)] if old is None else []
            begin = moved.pop(max(began, key=lambda p: moved[p]["end"]))["end"] if began else 0
        out += splits(path, begin, new["end"], split)
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineRanges)


def stream_growing_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of files that are still written to, each once; see ``LineRanges`` for what the checkpoint remembers."""
    register(spark)
    return spark.readStream.format("line_ranges").options(path=path, **options).load()


def read_range_of(spark: SparkSession, path: str, start: int = 0, end: int = 0, **options) -> DataFrame:
    """Lines of one file, or of each file of a pattern, from byte ``start`` to byte ``end`` (0: the end of the file)."""
    register(spark)
    return spark.read.format("line_ranges").options(path=path, start=str(start), end=str(end), **options).load()
