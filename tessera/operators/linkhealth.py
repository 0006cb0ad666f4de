"""Health of media links: counts and quantile sketches a provider, day and batch, stored once and merged over any span.

A partial is small, whatever the number of checks behind it, so a report over months reads partials only. Sketches are
KLL; a quantile's rank is off by at most ``ERROR``, told by the sketch's size, and merging does not add to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch (about 800 values a level, some 10 kB) and the error of ranks that it keeps with near certainty.
SIZE, ERROR = 800, 0.01
_EXACT = ("n", "ok", "failures", "unanswered", "timed")


def failed(status: Column, error: Column) -> Column:
    """A check failed if it has an error, no status or one outside 200 to 299."""
    return F.coalesce(error.isNotNull() | ~status.between(200, 299), F.lit(True))


def partials(checks: DataFrame, batch: Column) -> DataFrame:
    """``provider, day, batch``, counts, ``slowest`` and ``sketch`` of ``checks(provider, day, status, error, seconds)``.

    Seconds that are null, negative or not finite are no times: the check counts, its time doesn't. Null providers and days are
    groups of their own. Repeated rows count as often as they are there; no rows give no partials.
    """
    fault = failed(F.col("status"), F.col("error"))
    usable = ~F.isnan("seconds") & (F.col("seconds") >= 0) & (F.col("seconds") < float("inf"))
    rows = checks.select("provider", "day", batch.alias("batch"), "status", fault.alias("fault"), F.when(usable, F.col("seconds").cast("double")).alias("time"))
    counts = (F.count("*").alias("n"), F.count_if(~F.col("fault")).alias("ok"), F.count_if("fault").alias("failures"), F.count_if(F.col("status").isNull()).alias("unanswered"), F.count("time").alias("timed"))
    return rows.groupBy("provider", "day", "batch").agg(*counts, F.max("time").alias("slowest"), F.kll_sketch_agg_double("time", SIZE).alias("sketch"))


def replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All partials after ``new`` has come: those of its batches take the place of stored ones, so a repeated batch counts once."""
    batches = new.select(F.col("batch").alias("_b")).distinct()
    return stored.join(batches, F.col("batch").eqNullSafe(F.col("_b")), "left_anti").unionByName(new)


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Partials of the same ``by`` put together: ``by``, counts, ``slowest``, ``first_day``, ``last_day`` and ``sketch``."""
    sums = [F.sum(c).cast("long").alias(c) for c in _EXACT]
    sketch = F.kll_merge_agg_double("sketch", SIZE).alias("sketch")
    return parts.groupBy(*by).agg(*sums, F.max("slowest").alias("slowest"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), sketch)


def quantile(sketch: Column, timed: Column, share: float) -> Column:
    """The quantile of a sketch, null where no time came in."""
    return F.when(timed > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def report(parts: DataFrame, *by: str) -> DataFrame:
    """``by``, counts, ``slowest``, first and last day, ``median`` and ``p95`` (within ``ERROR`` of their rank)."""
    quantiles = [quantile(F.col("sketch"), F.col("timed"), share).alias(name) for name, share in (("median", 0.5), ("p95", 0.95))]
    return merged(parts, *by).select("*", *quantiles).drop("sketch")


def within(report_rows: DataFrame, checks: DataFrame, by: str) -> DataFrame:
    """``by, median_right, p95_right``: whether the reported quantiles have their rank among the times, up to ``ERROR``; null without times."""
    told = report_rows.select(F.col(by).alias("_by"), "timed", "median", "p95")
    joined = checks.select(F.col(by), F.col("seconds").alias("_s")).join(told, F.col(by).eqNullSafe(F.col("_by")))
    share = lambda condition: F.count_if(condition) / F.first("timed")
    fits = lambda name, at: (share(F.col("_s") < F.col(name)) <= at + ERROR) & (share(F.col("_s") <= F.col(name)) >= at - ERROR)
    return joined.filter("_s >= 0 and not isnan(_s) and _s < double('inf')").groupBy(by).agg(fits("median", 0.5).alias("median_right"), fits("p95", 0.95).alias("p95_right"))
