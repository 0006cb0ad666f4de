"""Requests of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_sums
from tessera.sources.io import shared_folder


def pack(rows: DataFrame, shard: str, order: str, size: str, limit: int, envelope: int) -> DataFrame:
    """``order, shard, batch, bytes``: greedy packing in order within each shard, from batch 1.

    A batch is ``envelope`` bytes, its rows and a comma between them; a row that alone exceeds the limit is an
    error and gets batch 0. Shards must be of bounded size: the packing of one is sequential.
    """

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        batch, held, out = 1, envelope, []
        for n in group[size]:
            if envelope + n > limit:
                out.append(0)
                continue
            more = n + (held > envelope)
            if held + more > limit:
                batch, held, more = batch + 1, envelope, n
            held += more
            out.append(batch)
        return group.assign(batch=out)

    kinds = dict(rows.dtypes)
    packed = rows.select(order, shard, size).groupBy(shard).applyInPandas(greedy, f"{order} {kinds[order]}, {shard} {kinds[shard]}, {size} {kinds[size]}, batch long")
    return packed


def batches(packed: DataFrame, shard: str, size: str, envelope: int) -> DataFrame:
    """``shard, batch, n, request_bytes`` of packed rows."""
    rows = packed.filter("batch > 0").groupBy(shard, "batch")
    return rows.agg(F.count("*").alias("n"), (F.sum(size) + envelope + F.count("*") - 1).alias("request_bytes"))


def oversize(packed: DataFrame, order: str, shard: str, size: str, limit: int, envelope: int) -> DataFrame:
    """``order, shard, batch, size, error`` of the packed rows that no batch can hold."""
    error = F.concat(F.lit("exceeds request limit ("), (F.col(size) + envelope).cast("string"), F.lit(f" > {limit} bytes)"))
    return packed.filter("batch = 0").select(order, shard, "batch", size, error.alias("error"))


def starts_next(placed: DataFrame, room: int) -> DataFrame:
    """``grp, i, next``: where the batch after the one that begins at place i begins, for ``placed(grp, i, start)``.

    That is the last place whose start is no more than ``room`` bytes on. Bytes are cut into cells of ``room``: it lies in the
    next cell, no farther into it than the row into its own, or, where that part of the cell is empty, is the last of the
    row's own cell. A cell holds ``room`` rows at most, as each takes a byte or more.
    """
    cell, off = F.floor(F.col("start") / room), F.pmod("start", F.lit(room))
    rows = placed.select("grp", "i", cell.alias("cell"), off.alias("off"))
    rows = rows.withColumn("last", F.max("i").over(Window.partitionBy("grp", "cell")))
    asks = rows.select("grp", (F.col("cell") + 1).alias("cell"), "off", F.col("i").alias("of"), "last", F.lit(None).cast("long").alias("at"))
    have = rows.select("grp", "cell", "off", F.lit(None).cast("long").alias("of"), "last", F.col("i").alias("at"))
    before = Window.partitionBy("grp", "cell").orderBy("off", F.col("at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = asks.unionByName(have).withColumn("seen", F.max("at").over(before)).filter(F.col("of").isNotNull())
    return met.select("grp", F.col("of").alias("i"), F.coalesce("seen", "last").alias("next"))


def orbit(jumps: DataFrame) -> DataFrame:
    """``grp, i``: the places that are reached from place 0 of each group by ``jumps(grp, i, next)``, which never lead back.

    Jumps are doubled until all lead to a group's end. A doubled jump is only needed from where jumps of half its length
    arrive (and from 0), so each round has the fewer rows, the longer its jumps; they are then taken back from the
    longest: each round adds the places half-way to the next.
    """
    spark, levels = jumps.sparkSession, []
    while True:
        folder = shared_folder(spark)
        jumps.write.parquet(folder)
        jumps = spark.read.schema(jumps.schema).parquet(folder)
        levels.append(jumps)
        arrive = jumps.select("grp", F.col("next").alias("i")).unionByName(jumps.filter("i = 0").select("grp", "i")).distinct()
        then = jumps.select("grp", F.col("i").alias("next"), F.col("next").alias("beyond"))
        once = jumps.join(arrive, ["grp", "i"], "left_semi")
        doubled = once.join(then, ["grp", "next"], "left").select("grp", "i", F.coalesce("beyond", "next").alias("next"))
        if once.join(then.filter("beyond <> next"), ["grp", "next"], "left_semi").isEmpty():
            break
        jumps = doubled
    reached = levels[-1].filter("i = 0").select("grp", "i")
    for level in reversed(levels):
        onward = reached.join(level, ["grp", "i"]).select("grp", F.col("next").alias("i"))
        folder = shared_folder(spark)
        reached.unionByName(onward).distinct().write.parquet(folder)
        reached = spark.read.schema(reached.schema).parquet(folder)
    return reached


def pack_whole(rows: DataFrame, group: str, order: str, size: str, limit: int, envelope: int) -> DataFrame:
    """``order, group, size, batch``: greedy packing in order of a whole group of any size, from batch 1; equal to the sequential one.

    A batch is ``envelope`` bytes, its rows and a comma between them. A row that alone exceeds the limit gets batch 0 and takes no room.
    A null size counts as 0, a null group is one group; ``order`` has to be distinct within a group. No group is gathered in a task: running
    sums give each row's place, a search in cells where the batch after it would begin, and doubled jumps which rows do begin one.
    """
    sized = rows.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.coalesce(size, F.lit(0)).cast("long").alias("len"))
    # A null group as one that joins find.
    sized = sized.withColumn("grp", F.struct(F.col("grp").isNull().alias("none"), F.col("grp").alias("name")))
    fits = F.col("len") + envelope <= limit
    placed = with_sums(sized.filter(fits), "grp", [F.col("ord")], i=F.lit(1), start=F.col("len") + 1)
    placed = placed.withColumns({"i": F.col("i") - 1, "start": F.col("start") - F.col("len") - 1})
    end = placed.groupBy("grp").agg((F.max("i") + 1).alias("i"), F.max(F.col("start") + F.col("len") + 1).alias("start"))
    name = F.concat_ws(":", F.col("grp.none").cast("string"), F.col("grp.name").cast("string"))
    named = placed.select(name.alias("grp"), "i", "start").unionByName(end.select(name.alias("grp"), "i", "start"))
    begins = orbit(starts_next(named, limit - envelope + 1)).withColumn("begins", F.lit(1))
    marked = placed.select(F.col("grp").alias("_grp"), "ord", "len", name.alias("grp"), "i").join(begins, ["grp", "i"], "left")
    packed = with_sums(marked, "grp", [F.col("ord")], batch=F.col("begins")).select(F.col("_grp").alias("grp"), "ord", "len", "batch")
    out = packed.unionByName(sized.filter(~fits).select("grp", "ord", "len", F.lit(0).cast("long").alias("batch")))
    return out.select(F.col("ord").alias(order), F.col("grp.name").alias(group), F.col("len").alias(size), "batch")
