"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Method: vectors are brought to unit length with one more component, so that the largest inner product is the smallest distance. Each
of ``tables`` hash tables cuts a few random projections into slots of equal width; a combination of slots is a bucket. A query
knows how a neighbour's projections are distributed around its own, visits perturbed buckets in the order of that probability, and
stops when the probabilities add up to what the wanted recall asks of one table. Candidates are compared by their exact inner
product on the original vectors in double precision, and the tables' best are merged. A query that found fewer rows than asked for
is compared with all vectors.

Buckets are visited in rounds, the likeliest first, each round about eight times the buckets of those before it. After a round a query
knows the score that its last place takes so far, and a later round reports only candidates that reach it. So the rows that are merged
grow with the queries, not with queries times groups.

Work is dealt by groups of buckets. Both sides of a group are split into parts of bounded size, as measured, so neither a large
bucket nor many queries meet in one task. Equal vectors are one candidate with its smallest ids.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows without vec_id. Rows that repeat a vec_id are candidates of their own, reported once with the better score, and never of a query
with that id. Ties go to the smaller vec_id. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitmill.llm.shared import arrow, saved, scratch

#: Queries, drawn by a hash of their id, on which the distance of neighbours is estimated.
SAMPLE = 64
#: Vectors that a bucket should hold on average; rows of one part of a group.
BUCKET, PART, GROUP = 300, 8192, 16384
MOST_PROBES = 1 << 14
#: Buckets of one table that have been visited at the end of each round.
ROUNDS = (1, 8, 64, 512, 4096, MOST_PROBES)


@dataclass
class Tables:
    """Random projections and offsets, and the expected cosine of a neighbour."""

    planes: np.ndarray  # tables x hashes x (dimensions + 1)
    offsets: np.ndarray  # tables x hashes
    width: float
    cosine: float
    reach: float  # probability that each table has to cover
    longest: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Candidates on the unit sphere: scaled by the longest, the missing length as one more component."""
        unit = vectors / self.longest
        return np.hstack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))[:, None]])

    def slots(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return np.floor((lifted @ self.planes[table].T + self.offsets[table]) / self.width).astype(np.int64)

    @staticmethod
    def key(table: int, slots: np.ndarray) -> np.ndarray:
        key = np.full(len(slots), table + 1, dtype=np.int64)
        for k in range(slots.shape[1]):
            key = key * 31 + np.clip(slots[:, k] + 15, 0, 30)
        return key

    def probes(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets to visit for one query, and the round of each."""
        unit = np.append(query / np.linalg.norm(query), 0.0)
        spread = math.sqrt(max(1e-6, 1.0 - self.cosine**2))
        keys, rounds = [], []
        for table in range(len(self.planes)):
            centre = self.planes[table] @ unit * self.cosine
            chance, slots = np.ones(1), np.zeros((1, 0), dtype=np.int64)
            for k in range(self.planes.shape[1]):
                low, high = (math.floor((centre[k] + s * 4 * spread + self.offsets[table, k]) / self.width) for s in (-1, 1))
                own = np.arange(low, high + 1)
                edges = (np.arange(low, high + 2) * self.width - self.offsets[table, k] - centre[k]) / spread
                below = np.array([0.5 * math.erfc(-e / math.sqrt(2)) for e in edges])
                chance = np.outer(chance, np.diff(below)).ravel()
                slots = np.hstack([np.repeat(slots, len(own), axis=0), np.tile(own, len(slots))[:, None]])
                best = np.argsort(-chance, kind="stable")[:MOST_PROBES]
                chance, slots = chance[best], slots[best]
            enough = int(np.searchsorted(np.cumsum(chance), self.reach)) + 1
            own, first = np.unique(self.key(table, slots[:enough]), return_index=True)
            keys.append(own)
            rounds.append(np.searchsorted(ROUNDS, first, side="right"))
        return np.concatenate(keys), np.concatenate(rounds)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): the usable vectors; floats stay floats, which are shorter to shuffle, all else is double."""
    v = F.col("embedding").cast("array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>")
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    rows = table.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (usual[0]["d"] if usual else -1))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, with all that tie with the last up to rounding."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 1e-9 * max(1.0, float(np.abs(scores).max())))


def _cosine(candidates: DataFrame, queries: list, longest: float, k: int) -> float:
    """A low quantile of the sampled queries' cosine to their k-th neighbour; candidates are read once, each batch keeps its best."""
    points = np.array([q.v for q in queries])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = points @ _matrix(batch.column("v")).T
            out: dict[str, list] = {"q": [], "score": []}
            for q, own in enumerate(scores):
                top = np.sort(own)[-k - 1:]
                out["q"] += [q] * len(top)
                out["score"] += top.tolist()
            yield arrow(out, pa.schema([("q", pa.int32()), ("score", pa.float64())]))

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    kth = candidates.select("v").mapInArrow(task, "q int, score double").withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("q").agg(
        F.min("score").alias("s")).collect()
    values = [r.s / (longest * float(np.linalg.norm(points[r.q]))) for r in kth]
    return float(np.clip(np.quantile(values, 0.25), 0.05, 0.999)) if values else 0.5


def _place(tables: Tables, groups: int):
    """Candidates with their bucket in every table."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lifted = tables.lifted(_matrix(batch.column("v")))
            for table in range(len(tables.planes)):
                key = tables.key(table, tables.slots(table, lifted))
                yield pa.RecordBatch.from_arrays([pa.array(_group(key, groups)), pa.array(key), batch.column("ids"), batch.column("v")],
                                                 ["grp", "bucket", "ids", "v"])
    return task


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % groups


def _visit(tables: Tables, groups: int):
    """Queries with the buckets they visit in each round and group."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"round": [], "grp": [], "at": [], "buckets": []}
            for at, query in enumerate(_matrix(batch.column("v")) if batch.num_rows else []):
                keys, rounds = tables.probes(query)
                place = rounds * groups + _group(keys, groups)
                order = np.argsort(place, kind="stable")
                filled, first = np.unique(place[order], return_index=True)
                out["round"] += (filled // groups).tolist()
                out["grp"] += (filled % groups).tolist()
                out["at"] += [at] * len(filled)
                out["buckets"] += [np.sort(x).tolist() for x in np.split(keys[order], first[1:])]
            take = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["round"], pa.int32()), pa.array(out["grp"], pa.int64()),
                                              pa.array(out["buckets"], pa.list_(pa.int64())), batch.column("vec_id").take(take),
                                              batch.column("v").take(take)], ["round", "grp", "buckets", "vec_id", "v"])
    return task


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _compare(k: int, tables: int):
    """The best candidates of each query among those in the buckets it visits (all, if it names none) that reach its floor."""
    def task(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        if len(queries) and len(candidates):
            order = np.argsort(candidates["bucket"].to_numpy(), kind="stable")
            bucket, points = candidates["bucket"].to_numpy()[order], _matrix(candidates["v"])[order]
            ids = candidates["ids"].take(pa.array(order)).to_pylist()
            points_t, points_of = np.ascontiguousarray(points.T), _matrix(queries["v"])
            for row in range(len(queries)):
                query = points_of[row]
                own, visits, floor = queries["vec_id"][row].as_py(), queries["buckets"][row].as_py(), queries["floor"][row].as_py()
                if visits is None:
                    there = np.arange(len(bucket))
                    scores = query @ points_t
                else:
                    low, high = np.searchsorted(bucket, visits, side="left"), np.searchsorted(bucket, visits, side="right")
                    spans = [(a, b) for a, b in zip(low.tolist(), high.tolist()) if b > a]
                    if not spans:
                        continue
                    there = np.concatenate([np.arange(a, b) for a, b in spans])
                    scores = np.concatenate([query @ points_t[:, a:b] for a, b in spans])
                # Tables share groups: one vector may stand here once for each table.
                top = there[_best(scores, (k + 1) * tables)]
                exact = (points[top] * query).sum(axis=1)
                if floor is not None:
                    top, exact = top[exact >= floor], exact[exact >= floor]
                found = sorted({(-s, i) for s, place in zip(exact.tolist(), top.tolist()) for i in ids[place] if i != own})[:k]
                out["query_id"] += [own] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
        return pa.table(out, schema=FOUND)
    return task


def _parts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PART).alias(name))


def _search(queries: DataFrame, candidates: DataFrame, j_parts: DataFrame, k: int, tables: int) -> DataFrame:
    """Compare both sides of each group, in parts of at most about PART rows each."""
    sizes = _parts(queries, "i_parts").join(j_parts, "grp")
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = queries.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("vec_id"), "i_parts").alias("i"), every("j_parts").alias("j"), "vec_id", "v", "buckets", "floor")
    right = candidates.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("ids"), "j_parts").alias("j"), every("i_parts").alias("i"), "bucket", "ids", "v")
    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(_compare(k, tables), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query so far."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def nearest(table: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96, tables: int = 4, width: float = 1.6) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` (vec_id, embedding) that satisfy ``is_query``."""
    folder = scratch(table.sparkSession)
    rows = saved(vectors(table), "vectors", folder)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = saved(rows.distinct().withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "candidates", folder)
    queries = rows.filter(is_query).dropDuplicates(["vec_id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    count, longest, size = candidates.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sample = queries.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    longest *= 1 + 1e-9
    rng = np.random.default_rng(17)
    hashes = int(np.clip(round(math.log2(max(1.0, count / BUCKET)) / 1.37), 1, 10))
    shape = Tables(rng.standard_normal((tables, hashes, size + 1)), rng.uniform(0, width, (tables, hashes)), width,
                   _cosine(candidates, sample, longest, k), 1 - (1 - recall) ** (1 / tables), longest)
    groups = max(1, -(-count * tables // GROUP))
    kind = rows.schema["v"].dataType.simpleString()
    placed = candidates.mapInArrow(_place(shape, groups), f"grp long, bucket long, ids array<long>, v {kind}")
    sizes = saved(_parts(placed, "j_parts"), "sizes", folder)
    visits = saved(queries.repartition("vec_id").mapInArrow(_visit(shape, groups), f"round int, grp long, buckets array<long>, vec_id long, v {kind}"), "visits", folder)
    last = visits.agg(F.max("round")).first()[0]
    best = None
    for number in range(0 if last is None else last + 1):
        now = visits.filter(F.col("round") == number)
        if best is None:
            now = now.withColumn("floor", F.lit(None).cast("double"))
        else:
            floor = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            now = now.join(floor, "vec_id", "left")
        found = _search(now, placed, sizes, k, tables)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = saved(_ranked(found, k), f"best-{number}", folder)
    if best is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    # Few candidates in its buckets: such a query is compared with all vectors.
    full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    parts = max(1, -(-count // PART))
    everywhere = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("grp"), "vec_id", "v",
                              F.lit(None).cast("array<long>").alias("buckets"), F.lit(None).cast("double").alias("floor"))
    whole = candidates.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("long").alias("grp"), F.lit(0).cast("long").alias("bucket"), "ids", "v")
    rest = _search(everywhere, whole, _parts(whole, "j_parts"), k, 1)
    return _ranked(best.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
