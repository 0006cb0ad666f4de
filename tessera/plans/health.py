"""Link health: events stand for checks, their type for the provider, their value for seconds; a check with k of 90 or more in its props failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.linkhealth import partials, report, within
from tessera.sources.io import read_table

from .registry import query


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k >= 95, None).when(k >= 90, 404).otherwise(200)
    rows = read_table(spark, sf_dir, "events")
    return rows.select(F.col("event_type").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day"), status.alias("status"), F.when(k == 99, "timeout").alias("error"), F.col("value").alias("seconds"))


_CHECKS = """c AS (SELECT event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, value AS seconds,
  coalesce(json_extract_string(props, '$.k')::INT, 0) AS k FROM events)"""
_COUNTS = "count(*) AS n, count(*) FILTER (k < 90) AS ok, count(*) FILTER (k >= 90) AS failures, count(*) FILTER (k >= 95) AS unanswered, count(*) FILTER (seconds >= 0) AS timed, max(seconds) FILTER (seconds >= 0) AS slowest"


@query(f"""WITH {_CHECKS} SELECT provider, {_COUNTS}, min(day) AS first_day, max(day) AS last_day,
  CASE WHEN count(*) FILTER (seconds >= 0) > 0 THEN true END AS median_right, CASE WHEN count(*) FILTER (seconds >= 0) > 0 THEN true END AS p95_right FROM c GROUP BY 1""")
def link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's counts over all days from merged partials; its sketched quantiles are held against all times."""
    rows = checks(spark, sf_dir)
    told = report(partials(rows, F.col("day")), "provider")
    right = within(told, rows, "provider").withColumnRenamed("provider", "_p")
    return told.join(right, F.col("provider").eqNullSafe(F.col("_p")), "left").drop("_p", "median", "p95")


@query(f"WITH {_CHECKS} SELECT provider, day, {_COUNTS} FROM c GROUP BY 1, 2")
def daily_link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partials of each provider and day, but for the sketches."""
    return partials(checks(spark, sf_dir), F.col("day")).drop("sketch", "batch")
