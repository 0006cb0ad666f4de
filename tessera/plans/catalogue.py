"""Published-content queries bound to the test tables: orders stand for listings, parts for cards, documents for articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expr import clean_text
from tessera.operators.ordinals import pages
from tessera.sources.io import read_table

from .registry import query

#: Listing states by order status.
STATES = {"O": "active", "P": "reserved", "F": "sold"}


def listings(spark: SparkSession, sf_dir: str, *states: str) -> DataFrame:
    """Orders as listings, those in the given states only. The stored code is filtered, so that the scan gets the filter."""
    o = read_table(spark, sf_dir, "orders")
    if states:
        o = o.filter(F.col("o_orderstatus").isin([code for code, state in STATES.items() if state in states]))
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", state.alias("state"))



@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'reserved' END AS state, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def available_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, "active", "reserved")
    return rows.select("o_orderkey", "state", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_sold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir, "sold").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(5)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS DISTINCT FROM '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
def featured_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null banner passes."""
    rows = listings(spark, sf_dir, "active").filter(~F.col("o_orderpriority").eqNullSafe("1-URGENT"))
    return rows.select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(3)


@query("""SELECT c_nationkey, o_orderkey, rn FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn <= 2""")
def newest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window's limit is applied before the shuffle, so a large nation costs two rows a task."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = listings(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("c_nationkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


#: Display labels of brands.
LABELS = [("Brand#1", "Primeira"), ("Brand#2", "Segunda"), ("Brand#3", "Terceira"), ("Brand#4", "Quarta"), ("Brand#5", "Quinta")]


@query("""SELECT p_partkey, coalesce(l.label, p_brand) AS title, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 15 THEN 'medium' ELSE 'small' END AS band,
CASE WHEN p_retailprice IS NULL THEN 'on request' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || ' €' END AS price
FROM part LEFT JOIN (VALUES ('Brand#1', 'Primeira'), ('Brand#2', 'Segunda'), ('Brand#3', 'Terceira'), ('Brand#4', 'Quarta'), ('Brand#5', 'Quinta')) l(brand, label) ON p_brand = l.brand""")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in LABELS for x in kv])[F.col("p_brand")]
    band = F.when(F.col("p_size") > 40, "large").when(F.col("p_size") > 15, "medium").otherwise("small")
    price = F.when(F.col("p_retailprice").isNull(), "on request").otherwise(F.concat(F.floor("p_retailprice").cast("string"), F.lit(" €")))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.coalesce(label, "p_brand").alias("title"), band.alias("band"), price.alias("price"))


#: A fixed rail of keys with fallback titles; the last ones have no record.
RAIL = [(1, 0, "first"), (2, 5, "second"), (3, 19, "third"), (4, 10_000_001, "fourth"), (5, 10_000_002, "fifth")]


@query("""SELECT r.place::INT AS place, r.key::BIGINT AS key, coalesce(p_name, r.fallback) AS title, p_partkey IS NOT NULL AS own
FROM (VALUES (1, 0, 'first'), (2, 5, 'second'), (3, 19, 'third'), (4, 10000001, 'fourth'), (5, 10000002, 'fifth')) r(place, key, fallback) LEFT JOIN part ON p_partkey = r.key""")
def cards_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rail = spark.createDataFrame(RAIL, "place int, key long, fallback string")
    own = read_table(spark, sf_dir, "part").filter(F.col("p_partkey").isin([k for _, k, _ in RAIL])).select("p_partkey", "p_name")
    joined = rail.join(own, F.col("key") == F.col("p_partkey"), "left")
    return joined.select("place", "key", F.coalesce("p_name", "fallback").alias("title"), F.col("p_partkey").isNotNull().alias("own"))


@query("""WITH c AS (SELECT c_custkey, i AS pos, c_custkey * 7 + i * 3 AS cand FROM customer, (VALUES (0), (1), (2)) v(i)),
k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT c_custkey, min(pos) AS pos FROM c JOIN k ON cand = l_orderkey GROUP BY 1)
SELECT customer.c_custkey, CASE WHEN f.pos IS NULL THEN -1 ELSE customer.c_custkey * 7 + f.pos * 3 END AS chosen FROM customer LEFT JOIN f USING (c_custkey)""")
def first_candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a customer's ordered candidates that a returned line has, else -1."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", F.expr("posexplode(array(c_custkey * 7, c_custkey * 7 + 3, c_custkey * 7 + 6)) as (pos, cand)"))
    keys = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    joined = c.join(keys, F.col("cand") == F.col("l_orderkey"), "left")
    return joined.groupBy("c_custkey").agg(F.coalesce(F.min_by("l_orderkey", F.when(F.col("l_orderkey").isNotNull(), F.col("pos"))), F.lit(-1)).alias("chosen"))


@query("""SELECT doc_id, lang, (rn - 1) // 6 + 1 AS page, (rn - 1) % 6 + 1 AS place FROM
(SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents)""")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return pages(rows, "lang", [F.desc("n_chars"), F.col("doc_id")], 6).select("doc_id", "lang", "page", "place")


@query(r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[ \t\n\r\f\x0b\x{00a0}]+', ' ', 'g')), 160) AS excerpt FROM documents""")
def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.substring(clean_text(F.col("text")), 1, 160).alias("excerpt"))
