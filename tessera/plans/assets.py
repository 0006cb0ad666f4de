"""Asset queries: pages stand for source URLs, parts for files, orders for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.assets import allowed_source, metadata_conflicts, same_files, sample_parity
from tessera.sources.io import read_table

from .registry import query

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(f"SELECT page_id, url LIKE 'https://%' AND (regexp_full_match({_HOST}, '(.*\\.)?example\\.(org|net)')) AS allowed FROM pages")
def allowed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", allowed_source(F.col("url"), ("example.org", "example.net")).alias("allowed"))


@query("SELECT p_partkey AS file_id, min(p_partkey) OVER w AS first_id, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_name, p_size)")
def equal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name and size are one file."""
    p = read_table(spark, sf_dir, "part")
    return same_files(p.select(F.col("p_partkey").alias("file_id"), F.sha1(F.col("p_name").cast("binary")).alias("digest"), F.col("p_size").alias("bytes")))


@query("SELECT p_brand AS ref, count(DISTINCT (p_name, p_size)) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT (p_name, p_size)) > 1")
def conflicting_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_conflicts(read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("ref"), F.col("p_name").alias("digest"), F.col("p_size").alias("bytes")))


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS type, l_orderkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
p AS (SELECT o_orderstatus AS type, o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0), n AS (SELECT type, id FROM (SELECT o_orderstatus AS type, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0))
SELECT *, 'not-in-payload' AS verdict FROM (SELECT * FROM s EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'not-planned' FROM (SELECT * FROM s EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'not-taken' FROM (SELECT * FROM n EXCEPT SELECT * FROM s)""")
def sample_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned line are the samples, those of even keys the plan."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("id"))
    returned = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return sample_parity(o.join(returned, "id", "left_semi"), o.filter("id % 9 <> 0"), o.filter("id % 2 = 0"))
