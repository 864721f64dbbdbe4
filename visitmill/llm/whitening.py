"""Whitening of vectors, with a covariance found by polarisation.

For two centred columns a and b, ``(a + b)^2 = a^2 + 2ab + b^2``: the variance of every column and of the sum of every two columns tells all
covariances. Only squares are ever added up, in whole numbers, so the order in which tasks finish changes nothing.

Entries become whole numbers floor(scale * c). The fit list holds each distinct vector once. A first pass adds up its columns; the second
centres every entry on the whole part of its column's mean, adds columns in pairs, and adds up the squares. What is left of the centre,
less than one unit, is taken out exactly afterwards: the variance of v times n^2 is n * sum(v^2) - sum(v)^2. The d * (d + 1) / 2 sums
(d is the length of a vector) come to the driver, as the eigenvectors of one d x d matrix are found there.

Left out are vectors that are null or empty, hold null or non-finite entries, or entries beyond the whole numbers of 64 bits, and vectors
of another length than most have (of equally many, the shorter). No vectors give no rows. Repeated vec_ids, null ones and equal vectors
each get their rows. A direction without variance (relative to the whole) has null ``whitened``; ``explained`` is null if nothing varies.
``deviation`` is null if it does not fit 64 bits. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import saved, scratch

#: Rows times pair sums held at once.
CELLS = 1 << 18
#: A direction with less than this share of the variance has none that doubles can tell.
FLAT = 1e-13


def whole_vectors(table: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, x as whole numbers."""
    def sound(c):
        y = F.floor(c.cast("double") * scale)
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < 2.0 ** 62) & y.isNotNull()
    rows = table.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", sound)).select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "d").limit(1).select("d")
    return rows.join(F.broadcast(usual), F.size("x") == F.col("d"), "left_semi")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rows(first: list[int], second: list[int], sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array(first, pa.int32()), "j": pa.array(second, pa.int32()),
                                       "s": pa.array([str(s) for s in sums])})


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per column, and one (i = -1) with the number of rows."""
    count, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            # High and low halves, as a sum of large entries need not fit.
            now = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            count, total = count + len(x), now if total is None else total + now
    if count:
        yield _rows([-1, *range(len(total))], [-1, *range(len(total))], [count, *total])


def _square_sums(centre: np.ndarray) -> Callable:
    """Sums of the squares of every column (i, i) and of every sum of two columns (i, j)."""
    d = len(centre)
    first, second = np.triu_indices(d)
    pair = first != second

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(first), dtype=object)
        step = max(1, CELLS // len(first))
        for batch in batches:
            x = _matrix(batch.column("x"))
            for k in range(0, len(x), step):
                z = x[k:k + step].astype(object) - centre
                if max(abs(z.max()), abs(z.min())) < 1 << 28:
                    z = z.astype(np.int64)
                v = z[:, first]
                v[:, pair] += z[:, second[pair]]
                total += (v * v).sum(axis=0)
        if total.any():
            yield _rows(first.tolist(), second.tolist(), [int(t) for t in total])
    return task


def _added(rows: DataFrame, task: Callable) -> dict[tuple[int, int], int]:
    """Sums of all tasks, exactly; as many rows as the task has kinds."""
    parts = rows.mapInArrow(task, "i int, j int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
    # Halves of a decimal are added, so that no sum of very many parts outgrows the type.
    half = F.lit(10 ** 18).cast("decimal(38,0)")
    low = F.col("s") % half
    high = ((F.col("s") - low) / half).cast("decimal(38,0)")
    return {(r.i, r.j): int(r.high) * 10 ** 18 + int(r.low)
            for r in parts.groupBy("i", "j").agg(F.sum(high).alias("high"), F.sum(low).alias("low")).collect()}


@dataclass(frozen=True)
class Whitening:
    """What the fit found: number of vectors, column sums, unit eigenvectors (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=object)

    def scaled(self, components: int) -> np.ndarray:
        """Columns that turn a centred vector into whitened values; not-a-number where there is no variance."""
        values = self.values[:components]
        good = values > FLAT * max(self.trace, 0)
        return np.where(good, self.vectors[:, :components] / np.sqrt(np.where(good, values, 1)), np.nan)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        rest = np.array([s % self.n for s in self.sums], dtype=float) / self.n
        return ((x.astype(object) - self.centre).astype(float) - rest) @ self.scaled(components)


def covariance(fit_list: DataFrame) -> tuple[int, list[int], list[list[Fraction]]]:
    """Number of rows, column sums, and the exact covariance (divisor n) of (x); no rows give 0 and empty lists."""
    sums = _added(fit_list, _column_sums)
    if not sums:
        return 0, [], []
    n = sums.pop((-1, -1))
    total = [sums[k, k] for k in range(len(sums))]
    centre = np.array([s // n for s in total], dtype=object)
    rest = [s % n for s in total]
    squares = _added(fit_list, _square_sums(centre))
    d = len(total)

    def variance(i: int, j: int) -> int:
        """n^2 times the variance of column i, or of the sum of columns i and j."""
        return n * squares.get((i, j), 0) - (rest[i] + (rest[j] if i != j else 0)) ** 2
    own = [variance(i, i) for i in range(d)]
    out = [[Fraction(own[i] if i == j else 0, n * n) for j in range(d)] for i in range(d)]
    for i in range(d):
        for j in range(i + 1, d):
            out[i][j] = out[j][i] = Fraction(variance(i, j) - own[i] - own[j], 2 * n * n)
    return n, total, out


def fit(fit_list: DataFrame) -> Whitening | None:
    n, total, exact = covariance(fit_list)
    if not n:
        return None
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]))
    return Whitening(n, total, values[::-1], vectors[:, ::-1], float(sum(exact[k][k] for k in range(len(total)))))


def _moments(model: Whitening, components: int) -> Callable:
    """Sums of whitened values (i, -1) and of their squares, alone and in pairs, over one task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.triu_indices(components)
        sums, squares = np.zeros(components), np.zeros(len(first))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column("x")), components)
                sums += w.sum(axis=0)
                squares += (np.where(first == second, w[:, first], w[:, first] + w[:, second]) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array([*range(components), *first.tolist()], pa.int32()),
                                          "j": pa.array([-1] * components + second.tolist(), pa.int32()),
                                          "s": pa.array([*sums, *squares], pa.float64(), from_pandas=False)})
    return task


def identity_error(fit_list: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over directions that vary."""
    parts = fit_list.mapInArrow(_moments(model, components), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    got = {(r.i, r.j): r.s / model.n for r in parts.collect()}  # one row per pair of components
    means = [got[i, -1] for i in range(components)]

    def variance(i: int, j: int) -> float:
        return got[i, j] - (means[i] + (means[j] if i != j else 0)) ** 2
    errors = [abs(variance(i, i) - 1) for i in range(components)]
    errors += [abs(variance(i, j) - variance(i, i) - variance(j, j)) / 2 for i in range(components) for j in range(i + 1, components)]
    return max((e for e in errors if not math.isnan(e)), default=None)


def _project(model: Whitening, components: int, error: float | None) -> Callable:
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:components]]
    rest = np.array([s % model.n for s in model.sums], dtype=object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            centred = (x.astype(object) - model.centre) * model.n - rest
            if max(abs(centred.max()), abs(centred.min())) ** 2 * len(model.sums) < 1 << 62:
                centred = centred.astype(np.int64)
            deviation = [int(v) if v < 1 << 63 else None for v in (centred * centred).sum(axis=1)]
            whitened = model.whitened(x, components)
            at = np.repeat(np.arange(len(x)), components)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(at), model.n)), "deviation": pa.array(deviation, pa.int64()).take(pa.array(at)),
                "whitened": pa.array(whitened.reshape(-1), from_pandas=True),
                "explained": pa.array(explained * len(x), pa.float64()), "identity_error": pa.array([error] * len(at), pa.float64())})
    return task


def whitening(table: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector that takes part and each of its first components."""
    folder = scratch(table.sparkSession)
    rows = saved(whole_vectors(table, scale), "rows", folder)
    fit_list = saved(rows.select("x").distinct(), "fit", folder)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(fit_list)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    components = min(components, len(model.sums))
    error = identity_error(fit_list, model, components)
    return rows.mapInArrow(_project(model, components, error), schema)
