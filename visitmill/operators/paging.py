"""Pages of ordered rows, however deep, without sorting or gathering what lies before them.

An order is a list of (column, descending); it should tell all rows apart. NULL sorts as the smallest value. A cursor names the last row
of a page: its values in the order's columns and how many rows with just these values have been shown (more than one only if the
order leaves rows equal).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]

#: Rows that a single top-k may have to pass over; beyond, the place is found by selection. The rows are the same either way.
TOP = 10_000
#: Rows drawn per round of the selection; they only decide how fast it narrows.
DRAWN = 20_000


class Cursor(NamedTuple):
    values: tuple
    shown: int = 1


def ways(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def _first_differs(column: str, down: bool, value: Any) -> Column:
    """The column's value comes before ``value``."""
    here = F.col(column)
    if value is None:
        return here.isNotNull() if down else F.lit(False)
    return F.coalesce(here > value, F.lit(False)) if down else here.isNull() | (here < value)


def before(order: Order, values: Sequence[Any]) -> Column:
    """Rows that come before the one with these values."""
    found = F.lit(False)
    for (column, down), value in reversed(list(zip(order, values, strict=True))):
        found = _first_differs(column, down, value) | (F.col(column).eqNullSafe(F.lit(value)) & found)
    return found


def equal(order: Order, values: Sequence[Any]) -> Column:
    same = F.lit(True)
    for (column, _), value in zip(order, values, strict=True):
        same = same & F.col(column).eqNullSafe(F.lit(value))
    return same


def _from(rows: DataFrame, order: Order, values: Sequence[Any]) -> DataFrame:
    """Rows at or after the values; the leading column's bound stands apart, so that it reaches the scan."""
    (column, down), value = order[0], values[0]
    if value is not None:
        here = F.col(column)
        rows = rows.filter(here.isNull() | (here <= value) if down else here >= value)
    return rows.filter(~before(order, values))


def row_at(rows: DataFrame, order: Order, rank: int, drawn: int = DRAWN) -> Cursor | None:
    """The row of that rank (from 1), as a cursor; None if there are fewer rows.

    Selection by narrowing: a random draw of the order's columns gives two pivots around the rank, one aggregation counts the rows before
    and between them, and the search goes on between (or beside, when the draw misled). Every round reads the narrow columns once or
    twice and leaves a few hundredths of the rows; no round shuffles or sorts them. Rows equal in all columns are one step.
    """
    columns = [c for c, _ in order]
    left = rows.select(*columns)
    size = left.count()
    if rank > size:
        return None
    while size > drawn:
        draw = left.sample(min(1.0, drawn / size), seed=size % 1_000_003).orderBy(*ways(order)).collect()
        draw = draw or left.limit(1).collect()
        at, slack = rank / size * len(draw), 3 * len(draw) ** 0.5 / 2 + 1
        low, high = (tuple(draw[min(max(int(i), 0), len(draw) - 1)]) for i in (at - slack, at + slack))
        counted = left.agg(
            F.count(F.when(before(order, low), 1)).alias("under"), F.count(F.when(equal(order, low), 1)).alias("low"),
            F.count(F.when(before(order, high), 1)).alias("upto"), F.count(F.when(equal(order, high), 1)).alias("high")).first()
        if rank <= counted.under:
            left, size = left.filter(before(order, low)), counted.under
        elif rank <= counted.under + counted.low:
            return Cursor(low, rank - counted.under)
        elif rank <= counted.upto:
            left = left.filter(before(order, high) & ~before(order, low) & ~equal(order, low))
            rank, size = rank - counted.under - counted.low, counted.upto - counted.under - counted.low
        elif rank <= counted.upto + counted.high:
            return Cursor(high, rank - counted.upto)
        else:
            left = left.filter(~before(order, high) & ~equal(order, high))
            rank, size = rank - counted.upto - counted.high, size - counted.upto - counted.high
    last = [tuple(r) for r in left.orderBy(*ways(order)).limit(rank).collect()]
    return Cursor(last[-1], last.count(last[-1]))


def page(rows: DataFrame, order: Order, number: int = 1, size: int = 100, after: Cursor | None = None) -> DataFrame:
    """One page: the ``number``-th, or with ``after`` the one that follows the cursor. A top-k of about ``size`` rows either way: a
    page further down than ``TOP`` rows starts at the row that ``row_at`` finds."""
    skip = (number - 1) * size
    if after is None and skip > TOP:
        after = row_at(rows, order, skip)
        if after is None:
            return rows.limit(0)
    if after is None:
        ordered = rows.orderBy(*ways(order))
        return (ordered.offset(skip) if skip else ordered).limit(size)
    # Rows like the cursor's come first. Those shown are left out, and no other row if the cursor's own is gone by now.
    ahead = _from(rows, order, after.values).orderBy(*ways(order)).limit(size + after.shown)
    place = F.row_number().over(Window.partitionBy().orderBy(*ways(order)))
    unseen = ahead.withColumn("_place", place).filter(~equal(order, after.values) | (F.col("_place") > after.shown))
    return unseen.drop("_place").orderBy(*ways(order)).limit(size)


def page_and_more(rows: DataFrame, order: Order, number: int = 1, size: int = 100, after: Cursor | None = None) -> DataFrame:
    """The same with ``has_more``: one row past the page is looked at, so only the page and what a top-k passes over is numbered."""
    skip = (number - 1) * size if after is None else 0
    if skip > TOP:
        after, skip = row_at(rows, order, skip), 0
        if after is None:
            return rows.limit(0).withColumn("has_more", F.lit(False))
    ahead = page(rows, order, 1, skip + size + 1, after)
    place = F.row_number().over(Window.partitionBy().orderBy(*ways(order))) - skip
    seen = ahead.withColumn("_place", place).withColumn("has_more", F.max("_place").over(Window.partitionBy()) > size)
    return seen.filter(F.col("_place").between(1, size)).drop("_place")


def first_rows(rows: DataFrame, order: Order, limit: int) -> DataFrame:
    """The first ``limit`` rows, in no order and spread over the tasks as they were. Small limits are a top-k."""
    if limit <= TOP:
        return rows.orderBy(*ways(order)).limit(limit)
    last = row_at(rows, order, limit)
    if last is None:
        return rows
    tied = rows.filter(equal(order, last.values)).limit(last.shown)
    return rows.filter(before(order, last.values)).unionByName(tied)


def next_cursor(shown: DataFrame, order: Order, after: Cursor | None = None) -> Cursor | None:
    """The cursor after a page, None if it is empty. ``after`` is the cursor the page was asked with."""
    keys = [tuple(r) for r in shown.select(*[c for c, _ in order]).orderBy(*ways(order)).collect()]
    if not keys:
        return after
    same = after.shown if after is not None and after.values == keys[-1] else 0
    return Cursor(keys[-1], keys.count(keys[-1]) + same)


def fetch(rows: DataFrame, keys: DataFrame, order: Order) -> DataFrame:
    """The whole rows of a page of keys. Rows with equal keys are taken to be copies and come as often as the page holds them.

    The first key's bounds are measured on the page and cut the scan of the wide rows; the page itself is small and is broadcast.
    """
    columns = [c for c, _ in order]
    wanted = keys.groupBy(*columns).agg(F.count("*").alias("_copies"))
    low, high = (keys.agg(f(columns[0]).alias("b")).scalar() for f in (F.min, F.max))
    near = rows.filter((F.col(columns[0]) >= low) & (F.col(columns[0]) <= high))
    found = near.join(F.broadcast(wanted), columns)
    one = found.groupBy(*columns).agg(F.first(F.struct(*rows.columns, "_copies")).alias("_row"))
    return one.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_row._copies")))).select(*[F.col("_row")[c].alias(c) for c in rows.columns])
