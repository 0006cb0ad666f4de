"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges(a, b)``.

    Each round hangs a node's neighbours on the smallest node among them (large star), then does the same for
    the smaller neighbours only (small star), until every node hangs on its component's smallest. A node's
    neighbours are never gathered: the smallest is a partial aggregate, handed back by a plain join that Spark
    may split where a node has very many. Loops and repeated edges do no harm; no edges give no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct()
    links = checkpointed(links)
    state = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m")).withColumnRenamed("v", "k")
        large = both.filter("u > v").join(least, F.col("v") == F.col("k")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = large.join(least, F.col("v") == F.col("k"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(small.select("v", F.col("m").alias("u")))
        links = checkpointed(small.filter("u < v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
