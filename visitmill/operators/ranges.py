"""Lookup of addresses in a table of disjoint or nested ranges, without comparing every address with every range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitmill.functions.net import V4_HEAD

SLICES = 1024
START, KEY, END = 0, 1, 2


def place(key: Column) -> Column:
    """A number that never falls as the key grows: v4 addresses exactly, v6 by their first 60 bits, what sorts before v4 as -1."""
    v4 = F.conv(F.substring(key, 25, 8), 16, 10).cast("long")
    v6 = F.conv(F.substring(key, 1, 15), 16, 10).cast("long") + (1 << 32)
    return F.when(key.startswith(V4_HEAD), v4).when(key < V4_HEAD, -1).otherwise(v6)


def _smaller(splits: Column, at: Column, inclusive: bool, size: int) -> Column:
    """How many of the sorted splits are smaller than the place (``inclusive``: or equal to it), by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        split = F.get(splits, found + width - 1)
        return F.when(split <= at if inclusive else split < at, found + width).otherwise(found)
    return F.aggregate(steps, F.lit(0), step)


def dealt(keys: DataFrame, ranges: DataFrame, key: str = "ip_key", slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """Keys and ranges with the number ``_b`` of their slice of the address space; ranges once per slice they reach into.

    Slices are cut at quantiles of the keys and range starts, measured in one aggregation (a sketch; it decides how even the slices are,
    never the result). A place that holds more than a slice's worth is several splits in a row: its rows are spread over
    the slices between them by a hash of the whole row (rows equal in every column should be folded before), and each of those gets its ranges. At a split lie as many ranges as nest there, so at most
    slices x depth of them are copies.
    """
    measured = keys.select(place(F.col(key)).alias("_p")).unionByName(ranges.select(place(F.col("lo")).alias("_p")))
    # One literal, not a thousand: every later step of the plan is analysed with it.
    cuts = F.split(F.lit(",".join(str(i / slices) for i in range(1, slices))), ",").cast("array<double>") if slices > 1 else F.array(F.lit(0.5))
    splits = measured.agg(F.percentile_approx("_p", cuts, 20 * slices).alias("s")).scalar()

    def between(frame: DataFrame, low: str, high: str) -> DataFrame:
        placed = frame.withColumns({"_splits": splits, "_p": place(F.col(low)), "_q": place(F.col(high))})
        return placed.withColumns({"_first": _smaller(F.col("_splits"), F.col("_p"), False, slices - 1),
                                   "_last": _smaller(F.col("_splits"), F.col("_q"), True, slices - 1)}).drop("_splits", "_p", "_q")
    # Unreadable keys match nothing, so they may go anywhere. The choice depends on the row alone, so a repeated task makes the same.
    width = F.when(F.col(key).isNull(), slices).otherwise(F.col("_last") - F.col("_first") + 1)
    first = F.when(F.col(key).isNull(), 0).otherwise(F.col("_first"))
    some = between(keys, key, key).withColumn("_b", (first + F.pmod(F.xxhash64(*keys.columns), width)).cast("int"))
    copies = between(ranges, "lo", "hi").withColumn("_b", F.explode(F.sequence("_first", "_last")))
    return some.drop("_first", "_last"), copies.drop("_first", "_last")


def match_ranges(keys: DataFrame, ranges: DataFrame, value: str, key: str = "ip_key", slices: int = SLICES) -> DataFrame:
    """Adds ``value`` of the innermost range that holds the key, or NULL.

    Ranges (lo, hi) are disjoint or nested; of equal ones the greatest value counts, those with lo > hi or a NULL end are empty, and
    two that cross end the query with an error. Starts, keys and ends of a slice are sorted together. The running sum of starts less ends
    is the depth; the range a key lies in is the one that last started at the key's own depth: two window functions over one
    shuffle, which spill. Neither a crowded network nor one address with most rows makes a large slice, and nothing is paired.
    """
    names = keys.columns
    valid = ranges.filter(F.col("lo") <= F.col("hi")).select("lo", "hi", F.col(value).alias("_value"))
    some, copies = dealt(keys, valid, key, slices)
    points = some.select("_b", F.col(key).alias("_at"), F.lit(KEY).alias("_kind"), F.lit(None).cast("string").alias("_other"),
                         F.lit(None).cast(valid.schema["_value"].dataType).alias("_value"), F.struct(*names).alias("_row"))
    none = F.lit(None).cast(points.schema["_row"].dataType).alias("_row")
    starts = copies.select("_b", F.col("lo").alias("_at"), F.lit(START).alias("_kind"), F.col("hi").alias("_other"), "_value", none)
    ends = copies.select("_b", F.col("hi").alias("_at"), F.lit(END).alias("_kind"), F.col("lo").alias("_other"), "_value", none)
    # Of ranges that start together the longest is outside; of those that end together the shortest ends first.
    order = ["_at", "_kind", F.desc("_other"), "_value"]
    so_far = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("_kind") == START, 1).when(F.col("_kind") == END, -1).otherwise(0)
    deep = points.unionByName(starts).unionByName(ends).withColumn("_depth", F.sum(change).over(so_far))
    # An end is looked at as the range it closes, one deeper than what follows.
    deep = deep.withColumn("_depth", F.col("_depth") + F.when(F.col("_kind") == END, 1).otherwise(0))
    same_depth = Window.partitionBy("_b", "_depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("_kind") == START, F.struct(F.col("_at").alias("lo"), F.col("_value").alias("value")))
    found = deep.withColumn("_in", F.last(opened, ignorenulls=True).over(same_depth))
    crossing = (F.col("_kind") == END) & (F.col("_in.lo") != F.col("_other"))
    told = F.raise_error(F.concat(F.lit("ranges cross at "), F.col("_at"))).cast(valid.schema["_value"].dataType)
    inside = F.when(F.col("_kind") == END, told).when(F.col("_depth") > 0, F.col("_in.value"))
    return found.filter((F.col("_kind") == KEY) | crossing).select("_row.*", inside.alias(value))
