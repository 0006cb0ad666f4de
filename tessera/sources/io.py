"""Reading tables and document exports, and writing snapshots."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("cmsLocaleId", T.StringType()), T.StructField("isDraft", T.BooleanType()),
    T.StructField("isArchived", T.BooleanType()), T.StructField("createdOn", T.StringType()), T.StructField("fieldData", T.VariantType()),
])
STAGE = T.StructType([T.StructField("items", T.ArrayType(ITEM)), T.StructField("pagination", T.StructType([T.StructField("total", T.LongType())]))])
FIELDS = T.ArrayType(T.StructType([T.StructField("slug", T.StringType()), T.StructField("type", T.StringType())]))
EXPORT = T.StructType([T.StructField("collections", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("slug", T.StringType()),
    T.StructField("schema", T.StructType([T.StructField("fields", FIELDS)])), T.StructField("staged", STAGE), T.StructField("live", STAGE),
])))])


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder. Where none is set, a local one in local mode (tests); else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared checkpoint folder, so that every later use sees the same."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system it would be."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (a row for each collection, stage and place), field types and stated totals of source exports."""
    collections = spark.read.schema(EXPORT).json(path, multiLine=True).select(F.inline("collections"))

    def of(stage: str) -> DataFrame:
        rows = collections.select("slug", F.posexplode(f"{stage}.items").alias("pos", "item"))
        return rows.select(F.col("slug").alias("collection"), F.lit(stage).alias("stage"), "pos", "item.*", F.expr("try_variant_get(item.fieldData, '$.slug', 'string')").alias("item_slug"))

    fields = collections.select(F.col("slug").alias("collection"), F.inline("schema.fields"))
    totals = collections.select(F.col("slug").alias("collection"), F.expr("stack(2, 'staged', staged.pagination.total, 'live', live.pagination.total) as (stage, total)"))
    return of("staged").unionByName(of("live")), fields, totals


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc`` (variant): the records of snapshots that are a bare array or hold one under ``documents``; else none."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.expr("try_variant_get(v, '$.documents', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    return raw.select(F.explode(listed).alias("doc"))


def read_answers(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """``row`` (variant): the records of a service's answers, one file each, in any of its envelopes.

    An answer is an array, or an object that holds one under the first of ``fields`` that it has, or a record by itself.
    Malformed files give no rows.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    arrays = [F.expr("try_variant_get(v, '$', 'array<variant>')"), *[F.try_variant_get("v", f"$.{name}", "array<variant>") for name in fields]]
    return raw.select(F.explode(F.coalesce(*arrays, F.array("v"))).alias("row"))


def read_built_routes(spark: SparkSession, root: str) -> DataFrame:
    """``route`` of every built HTML file: ``index.html`` stands for its folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root).select("path")
    inner = F.regexp_replace(F.regexp_extract("path", rf"{root.rstrip('/')}(/.*)$", 1), r"(index)?\.html$", "")
    return files.select(F.when(inner == "/", "/").otherwise(F.regexp_replace(inner, "/$", "")).alias("route"))


def binary_receipts(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha1, bytes`` of original files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha1("content").alias("sha1"), F.col("length").alias("bytes"))


def publish_snapshot(rows: DataFrame, root: str, version: int) -> str:
    """Write a version in its own folder, then the pointer; readers of the pointer never see half a snapshot."""
    path = f"{root.rstrip('/')}/v={version}"
    rows.write.mode("errorifexists").parquet(path)
    spark = rows.sparkSession
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")
    return path


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version that was published last."""
    last = spark.read.parquet(f"{root.rstrip('/')}/pointer").orderBy(F.desc("version")).first()
    return spark.read.parquet(last["path"])


def insert_if_absent(new: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: the first of each key among ``new``, where the target has none."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return first.join(target.select(key).distinct(), key, "left_anti")
