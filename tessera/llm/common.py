"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII controls tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Shares of rows are told by a hash modulo this: fine enough for a few thousand of 10**11 rows.
FINE = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder. Where none is set, under a local one in local mode (tests); else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a finished step, on whatever file system it is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder (they survive lost executors)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in a fresh shared folder; unlike a checkpoint, the plan then knows their size alone.

    For loops: estimates of joins multiply, so round after round on checkpoints they grow to numbers of millions of digits.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields columns as dicts of lists, cast to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def bounded_sample(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, if fewer), chosen by a hash of ``key``.

    The share is the same for every row of a class, so the sample is not a prefix; its size is bounded by
    ``most`` up to the spread of the hash. Any number of classes, null among them: only those with more than
    ``most`` rows stand in the table of shares, which is stored, so that the planner knows its size: it is
    broadcast where it is small and shuffled where it is not.
    """
    share = (F.lit(float(FINE)) * (F.lit(float(most)) / F.col("_n"))).cast("long")
    large = rows.groupBy(F.col(by).alias("_class")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    shares = stored(large.select("_class", share.alias("_share")))
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(FINE))
    joined = rows.join(shares, F.col(by).eqNullSafe(F.col("_class")), "left")
    return joined.filter(spread < F.coalesce("_share", F.lit(FINE))).drop("_class", "_share")
