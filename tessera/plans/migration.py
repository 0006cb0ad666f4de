"""Migration and reconciliation queries: orders stand for items, lineitem for media slots, part for assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_ordinals
from tessera.operators.packing import batches, oversize, pack, pack_whole
from tessera.operators.reconcile import content_digest, differences, eligibility, gate, merge_history, only_in_inventory
from tessera.sources.io import read_table

from .registry import query


def staged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with derived flags; where the key is divisible by 17 or 19 a flag is unknown."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    draft = F.when(k % 17 == 0, F.lit(None)).otherwise(k % 7 == 0)
    archived = F.when(k % 19 == 0, F.lit(None)).otherwise(k % 11 == 0)
    return o.select(k.alias("id"), F.when(k % 23 == 0, "").otherwise(F.col("o_orderpriority")).alias("locale"), F.concat(F.lit("item-"), k.cast("string")).alias("slug"),
                    draft.cast("boolean").alias("is_draft"), archived.cast("boolean").alias("is_archived"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source_locale"))


def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five staged items; some slugs differ."""
    rows = staged_items(spark, sf_dir).filter("id % 5 <> 0")
    return rows.select("id", "locale", F.when(F.col("id") % 13 == 0, F.concat("slug", F.lit("-old"))).otherwise(F.col("slug")).alias("slug"))


_STAGED = """staged AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS locale, 'item-' || o_orderkey AS slug, o_orderstatus AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS is_draft, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 11 = 0 END AS is_archived FROM orders),
live AS (SELECT id, locale, CASE WHEN id % 13 = 0 THEN slug || '-old' ELSE slug END AS slug FROM staged WHERE id % 5 <> 0),
elig AS (SELECT s.id, s.locale, s.status, concat_ws(',', CASE WHEN s.is_draft IS NULL THEN 'unknown-draft' END, CASE WHEN s.is_draft THEN 'draft' END,
  CASE WHEN s.is_archived IS NULL THEN 'unknown-archived' END, CASE WHEN s.is_archived THEN 'archived' END, CASE WHEN trim(s.locale) = '' THEN 'blank-locale' END,
  CASE WHEN l.id IS NULL THEN 'not-live' END, CASE WHEN l.slug <> s.slug THEN 'slug-mismatch' END) AS reasons
  FROM staged s LEFT JOIN live l ON s.id = l.id AND s.locale IS NOT DISTINCT FROM l.locale)"""


@query(f"WITH {_STAGED} SELECT id, locale, reasons, reasons = '' AS eligible FROM elig")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eligibility(staged_items(spark, sf_dir), live_items(spark, sf_dir))
    return found.select("id", "locale", F.concat_ws(",", "reasons").alias("reasons"), "eligible")


@query(f"""WITH {_STAGED}, slots AS (SELECT l_orderkey, count(*) AS photos, count(*) FILTER (l_returnflag = 'R') AS gallery FROM lineitem GROUP BY 1)
SELECT status, count(*) AS items, coalesce(sum(photos), 0)::BIGINT AS photos, coalesce(sum(gallery), 0)::BIGINT AS gallery
FROM elig LEFT JOIN slots ON id = l_orderkey WHERE reasons = '' GROUP BY status""")
def eligible_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots are counted before the join, so that it sees a row an item."""
    staged = staged_items(spark, sf_dir)
    good = eligibility(staged, live_items(spark, sf_dir), keep=("status",)).filter("eligible")
    slots = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("g"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return good.join(slots, "id", "left").groupBy("status").agg(F.count("*").alias("items"), zero("n").alias("photos"), zero("g").alias("gallery"))


@query(f"""WITH {_STAGED} SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM staged WHERE status <> 'P') AND l_orderkey NOT IN (SELECT id FROM live WHERE id % 2 = 0)""")
def inventory_only_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return only_in_inventory(inventory, staged_items(spark, sf_dir).filter("status <> 'P'"), live_items(spark, sf_dir).filter("id % 2 = 0"), "id")


@query("""SELECT o_orderpriority, count(*) AS received, count(*) - (o_orderpriority = '1-URGENT')::INT AS stated, o_orderpriority <> '1-URGENT' AS complete FROM orders GROUP BY 1""")
def pagination_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated totals are those of the table, one short for the first priority."""
    o = read_table(spark, sf_dir, "orders")
    stated = o.groupBy(F.col("o_orderpriority").alias("p")).agg((F.count("*") - F.max((F.col("o_orderpriority") == "1-URGENT").cast("int"))).alias("stated"))
    received = o.groupBy("o_orderpriority").agg(F.count("*").alias("received"))
    joined = received.join(stated, F.col("p") == F.col("o_orderpriority"), "left")
    return joined.select("o_orderpriority", "received", "stated", (F.coalesce("stated", F.lit(-1)) == F.col("received")).alias("complete"))


@query("""WITH e AS (SELECT o_orderstatus AS status, count(*) AS expected FROM orders GROUP BY 1), a AS (SELECT l_linestatus AS status, count(*) AS actual FROM lineitem GROUP BY 1)
SELECT status, expected, actual, CASE WHEN expected IS NULL THEN 'unexpected' WHEN actual IS NULL THEN 'missing' WHEN expected = actual THEN 'match' ELSE 'mismatch' END AS verdict FROM e FULL JOIN a USING (status)""")
def count_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("expected"))
    a = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("actual"))
    verdict = F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").when(F.col("expected") == F.col("actual"), "match").otherwise("mismatch")
    return e.join(a, "status", "full").select("status", "expected", "actual", verdict.alias("verdict"))


@query("""SELECT l_partkey AS file_id, count(*) AS occurrences, count(DISTINCT l_suppkey) AS urls, min(l_orderkey * 10 + l_linenumber) AS first_slot FROM lineitem GROUP BY 1""")
def media_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"), "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slot"))
    return slots.groupBy("file_id").agg(F.count("*").alias("occurrences"), F.count_distinct("l_suppkey").alias("urls"), F.min("slot").alias("first_slot"))


@query("SELECT l_partkey AS file_id, count(DISTINCT l_suppkey) AS urls FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def asset_url_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_inventory(spark, sf_dir).filter("urls > 1").select("file_id", "urls")


@query("""WITH a AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS refs,
string_agg(l_partkey, ',' ORDER BY CASE WHEN l_orderkey % 10 = 0 THEN -l_linenumber ELSE l_linenumber END, CASE WHEN l_orderkey % 10 = 0 THEN -l_partkey ELSE l_partkey END) AS other FROM lineitem GROUP BY 1) SELECT l_orderkey, refs = other AS equal FROM a""")
def ordered_ref_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered references of each item against a copy in which every tenth item's are reversed."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(refs.alias("refs"))
    other = F.when(F.col("l_orderkey") % 10 == 0, F.reverse("refs")).otherwise(F.col("refs"))
    return rows.select("l_orderkey", (F.col("refs") == other).alias("equal"))


@query("""WITH m AS (SELECT p_partkey AS meta_id, p_brand AS digest, p_size AS bytes FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT p_partkey AS file_id, count(DISTINCT CASE WHEN p_size = bytes THEN meta_id END) AS same, count(meta_id) AS near FROM part LEFT JOIN m ON lower(p_brand) = lower(digest) GROUP BY 1)
SELECT file_id, CASE WHEN same = 1 THEN 'matched' WHEN same > 1 THEN 'ambiguous' WHEN near > 0 THEN 'size-mismatch' ELSE 'missing' END AS verdict FROM c""")
def receipt_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata are pre-counted by digest and size, so that popular digests don't multiply rows."""
    p = read_table(spark, sf_dir, "part")
    assets = p.select(F.col("p_partkey").alias("file_id"), F.lower("p_brand").alias("digest"), F.col("p_size").alias("bytes"))
    meta = p.filter("p_partkey % 3 = 0").select(F.lower("p_brand").alias("digest"), F.col("p_size").alias("bytes"))
    same = meta.groupBy("digest", "bytes").agg(F.count("*").alias("same"))
    some = meta.groupBy("digest").agg(F.count("*").alias("some"))
    joined = assets.join(same, ["digest", "bytes"], "left").join(some, "digest", "left")
    verdict = F.when(F.col("same") == 1, "matched").when(F.col("same") > 1, "ambiguous").when(F.col("some") > 0, "size-mismatch").otherwise("missing")
    return joined.select("file_id", verdict.alias("verdict"))


@query("""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 <> 0 THEN 'reused-sample' WHEN p_partkey % 2 = 0 THEN 'metadata-mismatch' ELSE 'planned' END AS status FROM part""")
def upload_plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys have a receipt; every third of these has another size there."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), "p_size")
    receipts = p.filter("file_id % 2 = 0").select(F.col("file_id").alias("r_id"), F.when(F.col("file_id") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("r_size"))
    joined = p.join(receipts, F.col("file_id") == F.col("r_id"), "left")
    return joined.select("file_id", F.when(F.col("r_id").isNull(), "planned").when(F.col("r_size") == F.col("p_size"), "reused-sample").otherwise("metadata-mismatch").alias("status"))


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 2 THEN c_name || '*' ELSE c_name END AS n FROM customer WHERE c_custkey % 10 <> 3)
SELECT coalesce(a.k, b.k) AS c_custkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'changed' END AS verdict FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = c.filter("c_custkey % 10 <> 3").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 2, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return differences(c.filter("c_custkey % 10 <> 1"), other, "c_custkey", ["c_name"])


#: Bytes of a request, of its envelope, and ids of a shard.
LIMIT, ENVELOPE, SHARD = 92_160, 40, 500


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards are a source's ids by the five hundred, so that a large source is many shards."""
    d = read_table(spark, sf_dir, "documents")
    shard = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / SHARD).cast("string"))
    rows = d.select("doc_id", shard.alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return pack(rows, "shard", "doc_id", "bytes", LIMIT, ENVELOPE)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source || '-' || (doc_id // {SHARD}) AS shard, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS i FROM d WHERE {ENVELOPE} + bytes <= {LIMIT}),
p AS (SELECT doc_id, shard, bytes, i, 1::BIGINT AS batch, {ENVELOPE} + bytes AS held FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.shard, o.bytes, o.i, CASE WHEN held + 1 + o.bytes > {LIMIT} THEN batch + 1 ELSE batch END, CASE WHEN held + 1 + o.bytes > {LIMIT} THEN {ENVELOPE} + o.bytes ELSE held + 1 + o.bytes END
  FROM p JOIN o ON o.shard = p.shard AND o.i = p.i + 1)
SELECT shard, batch, count(*) AS n, (sum(bytes) + {ENVELOPE} + count(*) - 1)::BIGINT AS request_bytes FROM p GROUP BY 1, 2""")
def request_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches; ``request_packing_errors`` has the documents that no batch can hold."""
    return batches(packed_documents(spark, sf_dir), "shard", "bytes", ENVELOPE)


@query(f"""WITH d AS (SELECT doc_id, source || '-' || (doc_id // {SHARD}) AS shard, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents)
SELECT doc_id, shard, 0::BIGINT AS batch, bytes, 'exceeds request limit (' || ({ENVELOPE} + bytes) || ' > {LIMIT} bytes)' AS error FROM d WHERE {ENVELOPE} + bytes > {LIMIT}""")
def request_packing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that alone exceed the limit, as batch 0."""
    return oversize(packed_documents(spark, sf_dir), "doc_id", "shard", "bytes", LIMIT, ENVELOPE)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM d WHERE {ENVELOPE} + bytes <= {LIMIT}),
p AS (SELECT doc_id, source, bytes, i, 1::BIGINT AS batch, {ENVELOPE} + bytes AS held FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.source, o.bytes, o.i, CASE WHEN held + 1 + o.bytes > {LIMIT} THEN batch + 1 ELSE batch END, CASE WHEN held + 1 + o.bytes > {LIMIT} THEN {ENVELOPE} + o.bytes ELSE held + 1 + o.bytes END
  FROM p JOIN o ON o.source IS NOT DISTINCT FROM p.source AND o.i = p.i + 1)
SELECT source, batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, (sum(bytes) + {ENVELOPE} + count(*) - 1)::BIGINT AS request_bytes FROM p GROUP BY 1, 2""")
def source_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of each whole source in order of its documents, as one packer after another row would fill them."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes"))
    rows = pack_whole(d, "source", "doc_id", "bytes", LIMIT, ENVELOPE).filter("batch > 0")
    total = (F.sum("bytes") + ENVELOPE + F.count("*") - 1).alias("request_bytes")
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), total)


@query("""SELECT s_nationkey, (rn - 1) // 20 AS chunk, count(*) AS n, min(s_suppkey) AS first_key, max(s_suppkey) AS last_key FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) GROUP BY 1, 2""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ordinals(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [F.col("s_suppkey")])
    return rows.groupBy("s_nationkey", F.floor((F.col("ordinal") - 1) / 20).alias("chunk")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_key"), F.max("s_suppkey").alias("last_key"))


@query("""WITH h AS (SELECT sha256(to_json([p_partkey::VARCHAR, p_name, p_brand, p_size::VARCHAR])::VARCHAR) AS x FROM part)
SELECT count(*) AS n, sum(('0x' || substr(x, 1, 12))::BIGINT)::VARCHAR AS digest_a, sum(('0x' || substr(x, 13, 12))::BIGINT)::VARCHAR AS digest_b FROM h""")
def content_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digest(read_table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])


@query("""WITH o AS (SELECT s_suppkey AS id, '/s/' || s_suppkey AS route FROM supplier WHERE s_suppkey % 4 <> 0), n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN '/x/' ELSE '/s/' END || s_suppkey AS route FROM supplier WHERE s_suppkey % 4 <> 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.route, o.route) AS route, coalesce(n.route <> o.route, false) AS conflict FROM n FULL JOIN o ON n.id = o.id""")
def route_history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    old = s.filter("id % 4 <> 0").withColumn("route", F.concat(F.lit("/s/"), F.col("id").cast("string")))
    new = s.filter("id % 4 <> 1").withColumn("route", F.concat(F.when(F.col("id") % 9 == 0, "/x/").otherwise("/s/"), F.col("id").cast("string")))
    return merge_history(old, new, "id", "route")


@query("""WITH e AS (SELECT 'counts' AS entry, 1 AS p, (SELECT count(*) FROM orders) > 0 AS ok UNION ALL SELECT 'lines', 2, (SELECT count(*) FROM lineitem WHERE l_linestatus IS NULL) = 0
UNION ALL SELECT 'urgent', 3, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') = 0)
SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS n_failed, min_by(entry, p) FILTER (NOT ok) AS reason FROM e""")
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, items = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    one = lambda df, name, p, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("entry"), F.lit(p).alias("p"), "ok")
    entries = one(o, "counts", 1, F.count("*") > 0).unionByName(one(items, "lines", 2, F.count_if(F.col("l_linestatus").isNull()) == 0))
    return gate(entries.unionByName(one(o, "urgent", 3, F.count_if(F.col("o_orderpriority") == "1-URGENT") == 0)), "ok", "p", "entry")
