"""Structured Streaming twins of the lead jobs; each runs over what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.web import shared_link
from tessera.sources.io import shared_folder


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a table; a single file is read through its folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _timed(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _run(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Append a stream to Parquet and read what it has written."""
    folder = shared_folder(spark)
    written = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    written.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_first_by_key(spark: SparkSession, path: str) -> DataFrame:
    """The first event of each user and hour, repeats dropped within 23 hours of the watermark."""
    rows = _timed(spark, path).withColumn("key", F.concat("user_id", F.lit(":"), F.date_format("ts", "yyyyMMddHH")))
    return _run(rows.withWatermark("ts", "23 hours").dropDuplicatesWithinWatermark(["key"]), spark)


def stream_daily(spark: SparkSession, path: str) -> DataFrame:
    """``day, event_type, n`` by Lisbon day: each micro-batch adds its partial counts, which are then summed.

    The sink is appended to by batch number, so a batch that is run again replaces its own counts.
    """
    folder = shared_folder(spark)

    def add(batch: DataFrame, number: int) -> None:
        day = F.to_date(F.from_utc_timestamp("ts", "Europe/Lisbon"))
        counts = batch.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = _timed(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("day date, event_type string, n long").parquet(f"{folder}/out")
    return rows.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def stream_lead_split(spark: SparkSession, path: str, judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Submissions that ``judge`` accepts (null ``error``) and those it refuses, each written to a sink of its own.

    A micro-batch writes its folder anew, so one that is run again leaves no row twice.
    """
    folder = shared_folder(spark)

    def split(batch: DataFrame, number: int) -> None:
        rows = judge(batch)
        for sink, part in (("accepted", rows.filter("error is null")), ("refused", rows.filter("error is not null"))):
            part.write.mode("overwrite").parquet(f"{folder}/{sink}/batch={number}")

    _rows(spark, path).writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = judge(spark.createDataFrame([], spark.read.parquet(path).schema)).schema
    return tuple(spark.read.schema(schema).parquet(f"{folder}/{sink}") for sink in ("accepted", "refused"))


def stream_share_views(spark: SparkSession, path: str, link: Column) -> DataFrame:
    """``slug, views`` of links that were shared with a token; each micro-batch adds its partial counts."""
    folder = shared_folder(spark)

    def add(batch: DataFrame, number: int) -> None:
        views = batch.select(shared_link(link).alias("s")).filter("s is not null")
        views.groupBy("s.slug").agg(F.count("*").alias("views")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _rows(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("slug string, views long").parquet(f"{folder}/out").groupBy("slug").agg(F.sum("views").alias("views"))
