"""What has been parsed: hours, ranges, and the part of a query that still waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_hours(log: DataFrame) -> DataFrame:
    keys = ["website_id"] if "website_id" in log.columns else []
    return log.select(*keys, F.expr("timestamp - pmod(timestamp, 3600)").alias("hour")).distinct()


def hour_coverage(hours: DataFrame, bounds: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Whole percent of the hours of a range that hold parsed rows; -1 for a range outside the log.

    ``bounds`` is one row with ``log_min`` and ``log_max``; open ends take them.
    """
    def hour(c: Column) -> Column:
        return c - F.pmod(c, F.lit(3600))

    low, high = F.col("log_min"), F.col("log_max")
    edges = bounds.select(
        hour(F.greatest(F.lit(start) if start > 0 else low, low)).alias("first"),
        hour(F.least(F.lit(end) if end > 0 else high, high)).alias("last"),
        (F.least(F.lit(end) if end > 0 else high, high) >= F.greatest(F.lit(start) if start > 0 else low, low))
        .alias("inside"))
    first, last = edges.select("first").scalar(), edges.select("last").scalar()
    counted = hours.filter(F.col("hour").between(first, last)).agg(F.count("*").alias("parsed"))
    total = F.expr("(last - first) div 3600 + 1")
    row = counted.select("parsed", first.alias("first"), last.alias("last"),
                         edges.select("inside").scalar().alias("inside"))
    return row.select("parsed", F.when(F.col("inside"), total).otherwise(0).cast("long").alias("total")).select(
        "parsed", "total", F.when(F.col("total") > 0, F.expr("parsed * 100 div total")).otherwise(-1).cast("long")
        .alias("percent"))


def parsed_range(rows: DataFrame, file: str = "path") -> DataFrame:
    """First and last parsed second of each file."""
    return rows.groupBy(file).agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


def site_range(files: DataFrame) -> DataFrame:
    """The same over all files of the site."""
    return files.agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def pending_range(status: DataFrame) -> DataFrame:
    """The part of a queried range that is not parsed yet.

    Columns read: log_min, log_max, parsed_min, parsed_max, recent_cutoff, range_start, range_end (0 = absent) and
    hour_progress (-1 = unknown). Adds pending, pending_start, pending_end (NULL when empty) and progress.
    """
    c = F.col
    low, high = c("log_min"), c("log_max")
    known = (low > 0) & (high > 0) & (high >= low)
    base = status.withColumns({
        "_rs": F.when(c("range_start") <= 0, low).otherwise(c("range_start")),
        "_re": F.when(c("range_end") <= 0, high).otherwise(c("range_end")),
        "_pm": F.when((c("parsed_min") == 0) & (c("recent_cutoff") > 0), c("recent_cutoff")).otherwise(c("parsed_min")),
    })
    rs, re_, pm, px = c("_rs"), c("_re"), c("_pm"), c("parsed_max")
    asked = known & (re_ >= low) & (rs <= high) & (c("hour_progress") < 100)
    nothing = (pm == 0) & (px == 0)
    before, after = (pm > 0) & (rs < pm), (px > 0) & (re_ > px)
    start = (F.when(nothing, rs).when(before & after, F.greatest(rs, low, px + 1)).when(before, F.greatest(rs, low))
             .otherwise(F.greatest(px + 1, rs)))
    end = (F.when(nothing, re_).when(before & after, F.greatest(F.least(re_, pm - 1), F.least(re_, high)))
           .when(before, F.least(re_, pm - 1)).otherwise(F.least(re_, high)))
    pending = F.coalesce(asked & (nothing | before | after), F.lit(False))
    found = base.withColumns({"_pending": pending, "_start": start, "_end": end,
                              "_done": _done(low, high, rs, re_, pm, px)})
    shown = c("_pending") & (c("_end") >= c("_start"))
    return found.select(
        *status.columns, c("_pending").alias("pending"), F.when(shown, c("_start")).alias("pending_start"),
        F.when(shown, c("_end")).alias("pending_end"),
        F.when(~c("_pending"), F.lit(None)).when(c("hour_progress") >= 0, c("hour_progress")).otherwise(c("_done"))
        .cast("long").alias("progress"))


def _done(low: Column, high: Column, rs: Column, re_: Column, pm: Column, px: Column) -> Column:
    """Whole percent of the range's seconds that lie inside the parsed span."""
    first, last = F.greatest(rs, low), F.least(re_, high)
    a, b = F.when(pm == 0, px).otherwise(pm), F.when(px == 0, pm).otherwise(px)
    covered = F.greatest(F.least(last, F.greatest(a, b)) - F.greatest(first, F.least(a, b)) + 1, F.lit(0))
    share = F.floor(covered * 100 / F.greatest(last - first + 1, F.lit(1)))
    return F.when(((pm == 0) & (px == 0)) | (last < first), 0).otherwise(F.least(F.greatest(share, F.lit(0)), F.lit(100)))
