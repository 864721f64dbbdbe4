"""Ranges of files: every line once, however files are split, grow, rotate or are packed."""

import gzip
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visitmill.sources import listing, ranges, text


def lines_of(parts, chunk=ranges.CHUNK):
    return [(v, o, n) for p in parts for b in ranges.read_range(p, chunk) for v, o, n in
            zip(*(b.column(c).to_pylist() for c in ("value", "offset", "next_offset")))]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("chunk", [1, 5, 10_000])
def test_splits_give_each_line_once(split, chunk, tmp_path):
    body = b"one\n\ntwo three\r\nfour\n\n\nfive \xff six\nunfinished"
    path = tmp_path / "x.log"
    path.write_bytes(body)
    want, at = [], 0
    for raw in body.split(b"\n"):
        want.append((raw.removesuffix(b"\r").decode("utf-8", "replace"), at, min(at + len(raw) + 1, len(body))))
        at += len(raw) + 1
    assert lines_of(ranges.splits(str(path), 0, len(body), split), chunk) == want[:-1]
    assert lines_of(ranges.splits(str(path), 0, len(body), split, True), chunk) == want
    begin = body.index(b"four")
    assert lines_of(ranges.splits(str(path), begin, len(body) - 12, split), chunk) == [w for w in want[3:] if w[2] <= len(body) - 12]
    assert lines_of(ranges.splits(str(path), 0, 0, split), chunk) == []


def test_small_splits_read_little_more_than_their_bytes(tmp_path, monkeypatch):
    body = b"".join(b"line %d\n" % i for i in range(100_000))
    path, read = tmp_path / "x.log", []
    path.write_bytes(body)

    class Counted:
        def __init__(self, file):
            self.file, self.seek, self.close = file, file.seek, file.close

        def read(self, size):
            read.append(size)
            return self.file.read(size)

    class Files:
        def open_input_file(self, name):
            return Counted(open(name, "rb"))

    monkeypatch.setattr(ranges, "filesystem", lambda name: (Files(), name))
    assert [v for v, _, _ in lines_of(ranges.splits(str(path), 0, len(body), 10_000))] == body.decode().split("\n")[:-1]
    assert sum(read) < 2 * len(body)


def test_splits_are_dealt_out_to_several_tasks(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("".join(f"line {i}\n" for i in range(1000)))
    whole = spark.createDataFrame([(str(path), 0, path.stat().st_size, False)], "path string, start long, end long, compressed boolean")
    got = ranges.scan_ranges(whole, split=100).withColumn("task", F.spark_partition_id())
    assert got.agg(F.countDistinct("value"), F.count("*"), F.countDistinct("task") > 1).first() == (1000, 1000, True)


def test_open_range_and_growth(spark, tmp_path):
    path = tmp_path / "grown.log"
    path.write_text("".join(f"line {i}\n" for i in range(1000)) + "begun")
    whole = ranges.read_range_of(spark, str(path), split="100")
    assert whole.count() == 1000 and whole.rdd.getNumPartitions() > 50
    end = whole.agg(F.max("next_offset")).first()[0]
    assert ranges.read_range_of(spark, str(path), start=7, end=21).select("value").collect() == [("line 1",), ("line 2",)]
    for more in ("later\n", "".join(f"more {i}\n" for i in range(300)) + "last"):
        with open(path, "a") as f:
            f.write(more)
        part = ranges.read_range_of(spark, str(path), start=end)
        whole, end = whole.select("value").unionByName(part.select("value")), part.agg(F.max("next_offset")).first()[0]
    rest = ranges.read_range_of(spark, str(path), start=end, complete="true").collect()
    assert [r.value for r in rest] == ["last"]
    assert ranges.read_range_of(spark, str(tmp_path / "absent*")).count() == 0


def test_changed_files_are_read_from_their_offset(spark, tmp_path):
    sizes = {}
    for name, body in {"grown.log": "a\nb\nc\n", "rotated.log": "x\n", "new.log": "n\nunfinished", "same.log": "s\n"}.items():
        (tmp_path / name).write_text(body)
        sizes[name] = len(body)
    with gzip.open(tmp_path / "packed.gz", "wt") as f:
        f.write("p\nq")
    sizes["packed.gz"] = os.path.getsize(tmp_path / "packed.gz")
    schema = "source_id string, path string, size long, mtime long, etag string"
    now = spark.createDataFrame([("s", str(tmp_path / n), z, 2, "", n.endswith("gz")) for n, z in sizes.items()], schema + ", compressed boolean")
    old = spark.createDataFrame([("s", str(tmp_path / n), z, 1, "", o) for n, z, o in
                                 [("grown.log", 4, 4), ("rotated.log", 50, 50), ("same.log", 2, 2), ("packed.gz", 9, 9), ("gone.log", 3, 3)]],
                                schema + ", offset long")
    got = ranges.scan_changes(listing.detect_changed_files(old, now), now)
    assert sorted(r.value for r in got.collect()) == ["c", "n", "p", "q", "x"]


def test_forced_gzip_is_unpacked_as_it_is_read(spark, tmp_path):
    """A file of many members that unpacks to far more than a task may hold."""
    path = tmp_path / "big.log"
    member = gzip.compress(b"".join(b"%07d %s\n" % (i, b"x" * 200) for i in range(20_000)))
    with open(path, "wb") as f:
        for _ in range(100):
            f.write(member)
    got = text.scan_text(spark, str(path), "gz")
    assert got.agg(F.count("*"), F.countDistinct("value"), F.min(F.length("value"))).first() == (2_000_000, 20_000, 208)
    tracemalloc.start()
    count = sum(b.num_rows for b in ranges.read_range(ranges.FileRange(str(path), compressed=True, complete=True)))
    held, before = tracemalloc.get_traced_memory()[1], pa.total_allocated_bytes()
    tracemalloc.stop()
    assert count == 2_000_000 and held < 100 << 20 and before < 100 << 20


def test_stream_follows_growth_rotation_rename_and_restart(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    written = []

    def add(name, lines, end="\n"):
        with open(folder / name, "a") as f:
            f.write("".join(f"{x}\n" for x in lines[:-1]) + lines[-1] + end)
        written.extend(lines)

    def run(number):
        def each(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        stream = ranges.stream_growing_files(spark, str(folder / "*.log*"), split="64")
        (stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .start().awaitTermination())
        return sorted(r.value for r in spark.read.parquet(out).select("value").collect())

    first = [f"2024-01-01 00:00:{i:02d} first file line {i}" for i in range(50)]
    add("a.log", first[:20])
    add("b.log", ["2024-01-01 other file with a first line of its own"])
    assert run(0) == sorted(written)
    add("a.log", first[20:30], end="")          # the last line has no end yet
    assert run(1) == sorted(w for w in written if w != first[29])
    add("a.log", ["", first[30]])               # ends it
    written.remove("")
    assert run(2) == sorted(written)
    add("a.log", first[31:40])
    os.rename(folder / "a.log", folder / "a.log.1")   # rotated by name, with lines not read yet
    add("a.log", [f"2024-01-02 second file line {i}" for i in range(60)])
    add("b.log", ["more"])
    assert run(3) == sorted(written)
    (folder / "b.log").write_text("")           # rotated in place
    add("b.log", ["2024-01-03 short"])
    with gzip.open(folder / "c.log.gz", "wt") as f:
        f.write("packed 1\npacked 2")
    written += ["packed 1", "packed 2"]
    assert run(4) == sorted(written)
    assert run(5) == sorted(written)            # nothing new


def test_many_splits_make_a_bounded_number_of_tasks(spark, tmp_path):
    parts = ranges.splits("x", 7, 100_007, 10) + [ranges.FileRange("y.gz", compressed=True)] + ranges.splits("z", 0, 95, 10)
    tasks = ranges.dealt(parts, 50)
    assert sorted((p for t in tasks for p in t.parts), key=str) == sorted(parts, key=str) and 50 <= len(tasks) <= 101
    assert all(len(t.parts) == 1 or not any(p.compressed for p in t.parts) for t in tasks)
    assert max(sum(p.end - p.start for p in t.parts) for t in ranges.dealt(parts, 50, most=300) if not t.parts[0].compressed) == 300
    assert [len(t.parts) for t in ranges.dealt([ranges.FileRange("y.gz", compressed=True)] * 60, 50)] == [1] * 60
    path = tmp_path / "x.log"
    path.write_text("".join(f"line {i}\n" for i in range(1000)))
    whole = ranges.read_range_of(spark, str(path), split="5")
    assert sorted(r.value for r in whole.collect()) == sorted(f"line {i}" for i in range(1000))
    assert whole.rdd.getNumPartitions() <= 2 * ranges.TASKS


def test_follow_reads_a_longer_file_with_other_first_bytes_from_its_start():
    old = {"x": {"end": 40, "size": 40, "mtime": 1, "head": "aa" * 40, "packed": False}}
    new = {"x": {"end": 90, "size": 95, "mtime": 2, "head": "bb" * 64, "packed": False}}
    assert [(p.start, p.end) for p in ranges.follow(old, new)] == [(0, 90)]
    same = {"x": {"end": 90, "size": 95, "mtime": 2, "head": "aa" * 64, "packed": False}}
    assert [(p.start, p.end) for p in ranges.follow(old, same, 30)] == [(40, 70), (70, 90)]
