"""Positions within an order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.io import materialised


def with_sums(rows: DataFrame, group: str, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with running sums of long columns along each group, the row itself included; a null counts as nothing.

    Rows are range-partitioned by group and order, summed within each partition, and shifted by the sums of
    the group's rows in earlier partitions; of those there is one for each group and partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, columns = list(sums), [F.coalesce(c, F.lit(0)).cast("long").alias(f"_v_{name}") for name, c in sums.items()]
    # Both branches below must see one and the same dealing: its borders are sampled anew each time it is planned.
    dealt = materialised(rows.select("*", *columns).repartitionByRange(n, F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", group).agg(*[F.sum(f"_v_{name}").alias(f"_n_{name}") for name in names])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum(f"_n_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in names]
    shift = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *shifts)
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.sum(f"_v_{name}").over(inside).alias(f"_i_{name}") for name in names])
    joined = summed.join(shift, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, *[(F.col(f"_i_{name}") + F.col(f"_s_{name}")).alias(name) for name in names])


def with_ordinals(rows: DataFrame, group: str, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``rows`` with the position (from 1) of each row in its group."""
    return with_sums(rows, group, order, **{name: F.lit(1)})


def pages(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """``rows`` with ``page`` (from 1) and ``place`` (from 1 within the page)."""
    at = with_ordinals(rows, group, order, "_at")
    page = F.floor((F.col("_at") - 1) / size) + 1
    return at.select(*rows.columns, page.alias("page"), (F.col("_at") - (page - 1) * size).alias("place"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``run``: consecutive rows of a key with equal values share a number (from 1)."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
