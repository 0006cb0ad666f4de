"""Snapshots against one another: canonical documents, three-way parity and what a new snapshot changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.canonical import METADATA, json_digest
from tessera.operators.reconcile import three_way
from tessera.sources.gate import publish_changes
from tessera.sources.io import read_table, shared_folder

from .registry import query


def documents_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, text``: parts as JSON documents, their keys in one of two orders, with metadata, nulls and empty branches."""
    p = read_table(spark, sf_dir, "part")
    q = lambda c: F.to_json(F.array(F.col(c).cast("string")))
    text = lambda c: F.substr(q(c), F.lit(2), F.length(q(c)) - 2)
    key = F.col("p_partkey").cast("string")
    one = F.concat(F.lit('{"_id": "drafts.'), key, F.lit('", "name": '), text("p_name"), F.lit(', "size": {"n": '), F.col("p_size").cast("string"), F.lit(', "none": null, "empty": {"x": {}}}, "list": [3, 1, null], "_rev": "a"}'))
    two = F.concat(F.lit('{"list":[3,1,null],"size":{"empty":{"x":{}},"n":'), F.col("p_size").cast("string"), F.lit('.0},"_rev":"b","name":'), text("p_name"), F.lit("}"))
    return p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("text"))


_CANONICAL = """'{"list":[3,1],"name":' || to_json(p_name)::VARCHAR || ',"size":{"n":' || p_size || '}}'"""


@query(f"SELECT p_partkey AS key, sha256({_CANONICAL}) AS digest FROM part")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pruned documents without their metadata: the order of keys does not matter."""
    return documents_as_json(spark, sf_dir).select("key", json_digest(F.col("text"), METADATA, prune=True).alias("digest"))


@query(f"""WITH d AS (SELECT p_partkey AS k, sha256({_CANONICAL}) AS x FROM part),
t AS (SELECT k, CASE WHEN k % 17 = 0 THEN 'changed' ELSE x END AS x FROM d WHERE k % 13 <> 0 UNION ALL SELECT k, x FROM d WHERE k % 19 = 0), e AS (SELECT k, x FROM d WHERE k % 7 <> 0),
a AS (SELECT k, CASE WHEN k % 23 = 0 THEN 'other' ELSE x END AS x FROM d WHERE k % 11 <> 0)
SELECT z.k AS key, CASE WHEN (SELECT count(*) FROM t WHERE t.k = z.k) > 1 THEN 'duplicate-target' WHEN e.k IS NULL THEN 'unexpected' WHEN a.k IS NULL THEN 'not-approved' WHEN t1.k IS NULL THEN 'missing'
  WHEN a.x <> e.x THEN 'approved-differs' WHEN t1.x <> a.x THEN 'target-differs' ELSE 'equal' END AS verdict
FROM (SELECT k FROM t UNION SELECT k FROM e UNION SELECT k FROM a) z LEFT JOIN e ON e.k = z.k LEFT JOIN a ON a.k = z.k LEFT JOIN (SELECT k, max(x) AS x FROM t GROUP BY k) t1 ON t1.k = z.k""")
def three_way_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, expected and approved documents by their canonical digests."""
    d, k = canonical_digests(spark, sf_dir), F.col("key")
    other = lambda by, text: F.when(k % by == 0, text).otherwise(F.col("digest")).alias("digest")
    target = d.filter(k % 13 != 0).select("key", other(17, "changed")).unionByName(d.filter(k % 19 == 0))
    return three_way(target, d.filter(k % 7 != 0), d.filter(k % 11 != 0).select("key", other(23, "other")))


def _balance(by: int) -> Column:
    return F.when(F.col("c_custkey") % by == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal")


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 101 <> 0), n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 103 <> 0)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM o FULL JOIN n USING (c_custkey) WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second snapshot of the customers changes; a third, equal to it in another order, changes nothing more."""
    c, root = read_table(spark, sf_dir, "customer"), shared_folder(spark)
    publish_changes(c.filter("c_custkey % 101 <> 0").select("c_custkey", "c_name", "c_acctbal"), root, "c_custkey")
    second = c.filter("c_custkey % 103 <> 0").select("c_custkey", "c_name", _balance(50))
    events = publish_changes(second, root, "c_custkey")
    return events.unionByName(publish_changes(second.select("c_acctbal", "c_name", "c_custkey").repartition(7), root, "c_custkey"))
