"""Small building blocks used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1000


def pageviews(log: DataFrame) -> DataFrame:
    return log.filter(F.col("pageview_flag") == 1)


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "left",
           spread: str = "id", count_over: DataFrame | None = None) -> DataFrame:
    """Join many rows with a table that holds one row per ``key``, whatever share of the rows a key has.

    Keys that own more than 1/1000 of the rows are hot; there are fewer than a thousand of them, so their table rows
    can be broadcast, and hot rows never meet in one task: for the shuffle of the others they get a key made from
    their own id, which spreads them evenly and matches nothing. Keys must be texts and not NULL. Lookups in a row
    should count their keys over the first frame (``count_over``), so that the steps between are not run for it.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in table.columns if c not in keys]
    counts = (rows if count_over is None else count_over).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    hot_keys = counts.filter(F.col("_n") * HOT_SHARE > total).select(*keys)
    found = table.join(F.broadcast(hot_keys), keys, "left_semi")
    held = found.select(*keys, F.struct(*values).alias("_held"))
    hot = hot_keys.join(F.broadcast(held), keys, "left").select(*keys, "_held", F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.col("_hot").isNotNull()
    apart = F.when(is_hot, F.concat(F.lit("\0"), F.hex(F.xxhash64(spread)))).otherwise(F.col(keys[0]))
    left = marked.withColumns({"_k0": apart, **{f"_k{i}": F.col(k) for i, k in enumerate(keys) if i}})
    right = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_cold"))
    both = left.join(right, [f"_k{i}" for i in range(len(keys))], "left")
    both = both.withColumn("_v", F.coalesce("_held", "_cold"))
    if how == "inner":
        both = both.filter(F.col("_v").isNotNull())
    return both.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def one_row(*frames: DataFrame) -> DataFrame:
    """Merge frames of a single row each, with different columns, into one row without joining them."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.agg(*[F.max(c).alias(c) for c in names])


def total_of(column: str) -> Column:
    """Sum over the rows of an already limited frame (top-N reports only: at most N rows)."""
    return F.sum(column).over(Window.partitionBy())


def percent(part: Column | str, whole: Column) -> Column:
    """Whole percent, halves away from zero; NULL when there is nothing to divide by."""
    part = F.col(part) if isinstance(part, str) else part
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double") * 100).cast("long"))


def share(part: Column | str, whole: Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
