"""A gate before publishing: what changed since the last snapshot, reading again only the parts that did."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.io import exists

#: Parts that a snapshot is cut into by its keys.
PARTS = 64


class Digest(NamedTuple):
    """Of a part: rows, two sums over their SHA-256 (of parts of parts they add up), and the version that wrote it."""

    n: int
    a: str
    b: str
    version: int


def hashed(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``rows`` with ``_p``, the part of the key, and ``_a, _b``, numbers of the row's digest whatever the order of its columns."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)])).cast("binary"), 256)
    number = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    return rows.select("*", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int").alias("_p"), number(1).alias("_a"), number(16).alias("_b"))


def summed(name: str) -> Column:
    return F.sum(F.col(name).cast("decimal(38,0)")).cast("string")


def pointer(spark: SparkSession, root: str) -> dict[int, Digest]:
    """The parts of the newest version that was written to its end; a row for each part."""
    if not exists(spark, f"{root}/pointer"):
        return {}
    rows = spark.read.schema("p int, n long, a string, b string, version int, of int").json(f"{root}/pointer")
    newest = rows.agg(F.max("of")).first()[0]
    return {r["p"]: Digest(r["n"], r["a"], r["b"], r["version"]) for r in rows.filter(F.col("of") == newest).collect() if r["n"]}


def snapshot(spark: SparkSession, root: str, parts: list[int] | None = None) -> DataFrame | None:
    """The rows of the newest version, or of some of its parts; None where there are none."""
    at = pointer(spark, root)
    paths = [f"{root}/rows/v={d.version}/_p={p}" for p, d in sorted(at.items()) if parts is None or p in parts]
    return spark.read.parquet(*paths) if paths else None


def publish_changes(rows: DataFrame, root: str, key: str, parts: int = PARTS) -> DataFrame:
    """Make ``rows`` the newest snapshot under ``root``; ``key, kind`` of what was ``added``, ``removed`` or ``changed`` by it.

    Parts are compared by their digests, so one pass over the new rows tells which changed; only those are written again, and only
    their old rows are read. The pointer to the new version is written last: a run that was cut off has published
    nothing, and is run again over its own files. Equal rows in another order publish no version. A key that several rows
    have is compared by all its rows together; null keys are one key. The number of parts stays that of the first version.
    """
    spark = rows.sparkSession
    before = pointer(spark, root)
    new = hashed(rows, key, parts)
    now = {r["_p"]: (r["n"], r["a"], r["b"]) for r in new.groupBy("_p").agg(F.count("*").alias("n"), summed("_a").alias("a"), summed("_b").alias("b")).collect()}
    differ = sorted(p for p in now.keys() | before.keys() if now.get(p) != before.get(p, (None,) * 4)[:3])
    kind = dict(rows.dtypes)[key]
    if not differ:
        return spark.createDataFrame([], f"{key} {kind}, kind string")
    version = 1 + max((d.version for d in before.values()), default=0)
    path = f"{root}/rows/v={version}"
    new.filter(F.col("_p").isin(differ)).write.mode("overwrite").partitionBy("_p").parquet(path)
    sides = [spark.read.schema(new.schema).parquet(path).select(F.col(key).alias("k"), "_a", "_b", F.lit(True).alias("new"))]
    old = snapshot(spark, root, differ)
    if old is not None:
        sides.append(old.select(F.col(key).alias("k"), "_a", "_b", F.lit(False).alias("new")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    side = lambda which: F.struct(F.count_if(which).alias("n"), *[F.sum(F.when(which, F.col(c)).cast("decimal(38,0)")).alias(c) for c in ("_a", "_b")])
    keys = both.groupBy("k").agg(side(F.col("new")).alias("now"), side(~F.col("new")).alias("was"))
    told = F.when(F.col("was.n") == 0, "added").when(F.col("now.n") == 0, "removed").when(F.col("now") != F.col("was"), "changed")
    keys.select(F.col("k").alias(key), told.alias("kind")).filter("kind is not null").write.mode("overwrite").parquet(f"{root}/events/v={version}")
    lines = [(p, *(now.get(p) or (0, None, None)), version if p in differ else before[p].version, version) for p in sorted(now.keys() | before.keys())]
    spark.createDataFrame(lines, "p int, n long, a string, b string, version int, of int").coalesce(1).write.mode("overwrite").json(f"{root}/pointer/v={version}")
    return spark.read.schema(f"{key} {kind}, kind string").parquet(f"{root}/events/v={version}")
