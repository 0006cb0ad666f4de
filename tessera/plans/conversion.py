"""Conversion queries: orders stand for items, lineitem for slots and form fields, page bodies for rich text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.convert import audit_receipts, contract_diff, decoded, first_fault, galleries, stable_id
from tessera.operators.reconcile import eligibility
from tessera.operators.richtext import rich_text, rich_text_audit
from tessera.sources.io import read_table

from .migration import _STAGED, live_items, staged_items
from .registry import query

#: Labels of order states; the third state has none, so its items fail.
CODES = {"O": "active", "F": "sold"}


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all orders. Parts whose key is divisible by 7 have no file reference, odd suppliers no URL reference."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("url"))
    by_file = read_table(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("image-"), F.col("p_partkey").cast("string")).alias("ref"))
    by_url = read_table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("url"), F.concat(F.lit("url-"), F.col("s_suppkey").cast("string")).alias("ref"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    whole = o.join(galleries(lines, by_file, by_url), F.col("o_orderkey") == F.col("item_id"), "left")
    label, doc_id = decoded(F.col("o_orderstatus"), CODES), stable_id(F.lit("doc"), F.col("o_orderkey"), F.lower(F.col("o_orderpriority")))
    fault = first_fault(("document-id", doc_id.isNull()), ("unknown-status", label.isNull()), ("unmatched-slot", F.col("unmatched") > 0))
    return whole.select("o_orderkey", "o_orderstatus", "o_orderpriority", doc_id.alias("document_id"), label.alias("label"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.concat_ws(",", "refs").alias("refs"), fault.alias("error"))


_CONVERTED = f"""g AS (SELECT l_orderkey, count(*) AS n_slots, count(*) FILTER (l_partkey % 7 = 0 AND l_suppkey % 2 <> 0) AS unmatched,
  string_agg(CASE WHEN l_partkey % 7 <> 0 THEN 'image-' || l_partkey WHEN l_suppkey % 2 = 0 THEN 'url-' || l_suppkey END, ',' ORDER BY l_linenumber, l_partkey,
    CASE WHEN l_partkey % 7 <> 0 THEN 'image-' || l_partkey WHEN l_suppkey % 2 = 0 THEN 'url-' || l_suppkey END) AS refs FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, o_orderstatus, 'doc-' || o_orderkey || '-' || lower(o_orderpriority) AS i, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'sold' END AS label,
  coalesce(n_slots, 0) AS n_slots, coalesce(refs, '') AS refs, unmatched FROM orders LEFT JOIN g ON o_orderkey = l_orderkey),
c AS (SELECT o_orderkey, o_orderstatus, CASE WHEN regexp_full_match(i, '[A-Za-z0-9._-]+') THEN i END AS document_id, label, n_slots, refs,
  CASE WHEN NOT regexp_full_match(i, '[A-Za-z0-9._-]+') THEN 'document-id' WHEN label IS NULL THEN 'unknown-status' WHEN unmatched > 0 THEN 'unmatched-slot' END AS error FROM d)"""


@query(f"WITH {_CONVERTED} SELECT * FROM c")
def document_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(spark, sf_dir).drop("o_orderpriority")


@query(f"""WITH {_CONVERTED} SELECT o_orderstatus AS status, coalesce(error, 'converted') AS outcome, count(*) AS n, sum(n_slots)::BIGINT AS slots, min(o_orderkey) AS first_id FROM c GROUP BY 1, 2""")
def conversion_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of each state convert, and why the others don't."""
    rows = converted(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("status"), F.coalesce("error", F.lit("converted")).alias("outcome"))
    return rows.agg(F.count("*").alias("n"), F.sum("n_slots").alias("slots"), F.min("o_orderkey").alias("first_id"))


@query(f"""WITH {_STAGED}, {_CONVERTED}, m AS (SELECT coalesce(e.status, '(all)') AS collection, count(*) FILTER (reasons = '') AS eligible, coalesce(sum(n_slots) FILTER (reasons = ''), 0)::BIGINT AS slots,
  count(*) FILTER (e.id % 100 = 1) AS samples, count(*) FILTER (e.id % 100 = 1 AND reasons <> '') AS bad_samples, count(*) FILTER (reasons = '' AND error IS NOT NULL) AS failing
  FROM elig e JOIN c ON e.id = c.o_orderkey GROUP BY ROLLUP (e.status))
SELECT *, CASE WHEN samples = 0 THEN 'no-sample' WHEN bad_samples > 0 THEN 'ineligible-sample' WHEN eligible = 0 THEN 'no-eligible-item' WHEN failing > 0 THEN 'conversion-failed' ELSE 'passed' END AS gate FROM m""")
def migration_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible items, slots and samples (every hundredth item) of each collection and of all, with the gate's first reason."""
    staged = staged_items(spark, sf_dir)
    judged = eligibility(staged, live_items(spark, sf_dir), keep=("source_locale",)).select("id", "source_locale", "eligible")
    rows = judged.join(converted(spark, sf_dir), (F.col("id") == F.col("o_orderkey")) & F.col("source_locale").eqNullSafe(F.col("o_orderpriority")))
    ok, sample = F.col("eligible"), F.col("id") % 100 == 1
    counts = rows.rollup("o_orderstatus").agg(
        F.count_if(ok).alias("eligible"), F.coalesce(F.sum(F.when(ok, F.col("n_slots"))), F.lit(0)).alias("slots"), F.count_if(sample).alias("samples"),
        F.count_if(sample & ~ok).alias("bad_samples"), F.count_if(ok & F.col("error").isNotNull()).alias("failing"),
    )
    gate = first_fault(("no-sample", F.col("samples") == 0), ("ineligible-sample", F.col("bad_samples") > 0), ("no-eligible-item", F.col("eligible") == 0), ("conversion-failed", F.col("failing") > 0))
    return counts.select(F.coalesce("o_orderstatus", F.lit("(all)")).alias("collection"), "eligible", "slots", "samples", "bad_samples", "failing", F.coalesce(gate, F.lit("passed")).alias("gate"))


@query("""WITH f AS (SELECT l_orderkey % 10 AS r, l_orderkey AS k, (l_linenumber * 10000000 + l_partkey) * 1000000 + l_suppkey AS pos, l_partkey AS p, l_suppkey AS label, l_returnflag AS t, l_linestatus AS q FROM lineitem),
s AS (SELECT k, string_agg(t || q || label, ',' ORDER BY pos, label, t, q, p) AS shape, count(*) AS n FROM f WHERE r <> 1 GROUP BY 1),
g AS (SELECT k, string_agg(CASE WHEN r = 2 THEN 'X' ELSE t END || q || label, ',' ORDER BY pos, label, CASE WHEN r = 2 THEN 'X' ELSE t END, q, p) AS shape, count(*) AS n FROM f WHERE r <> 0 GROUP BY 1),
x AS (SELECT coalesce(s.k, g.k) AS k, CASE WHEN g.k IS NULL THEN 'missing-target-form' WHEN s.k IS NULL THEN 'unexpected-target-form' WHEN s.shape <> g.shape THEN 'form-contract-diff' WHEN s.k % 10 = 3 THEN 'field-name-mapping' END AS issue,
  CASE WHEN s.k % 10 = 3 AND g.k IS NOT NULL THEN s.n ELSE 0 END::INT AS renamed FROM s FULL JOIN g ON s.k = g.k)
SELECT k::VARCHAR AS form, issue, renamed FROM x WHERE issue IS NOT NULL""")
def form_contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fields of forms; on the other side a tenth of the forms is missing, new, of other types, or renamed."""
    k = F.col("l_orderkey")
    fields = read_table(spark, sf_dir, "lineitem").select(
        k, F.concat(F.lit("form-"), k.cast("string")).alias("form"), ((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("required"), F.col("l_suppkey").alias("label"),
    )
    other = fields.filter(k % 10 != 0).withColumns({"type": F.when(k % 10 == 2, "X").otherwise(F.col("type")), "name": F.when(k % 10 == 3, F.concat("name", F.lit("-new"))).otherwise(F.col("name"))})
    return contract_diff(fields.filter(k % 10 != 1), other)


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 10 = 9 THEN 'no-receipt' WHEN doc_id % 10 = 7 THEN 'digest-mismatch' WHEN doc_id % 10 = 5 THEN 'size-mismatch' ELSE 'verified' END AS verdict FROM documents""")
def media_digest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as originals, against receipts of which some are missing, of another digest or size, or in capitals."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    originals = d.select("file_id", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("bytes"))
    r = F.col("file_id") % 10
    sha1 = F.when(r == 7, F.reverse(F.concat("sha1", F.lit("x")))).when(r == 3, F.upper("sha1")).otherwise(F.col("sha1"))
    return audit_receipts(originals, originals.filter(r != 9).select("file_id", sha1.alias("sha1"), F.when(r == 5, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes")))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page after its title."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)</h1>(.*)</article>", 1).alias("body"))


_BODIES = r"""b AS (SELECT page_id, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, body, list_filter(regexp_extract_all(body, '<([a-z0-9]+)', 1), lambda x: x NOT IN ('p', 'h2', 'h3', 'h4', 'h5', 'li', 'ul', 'ol', 'strong', 'em', 'a', 'br')) AS bad FROM b),
e AS (SELECT page_id, body, CASE WHEN len(bad) > 0 THEN 'unsupported <' || bad[1] || '>' WHEN body = '' THEN 'empty' END AS error FROM t)"""


@query(rf"""WITH {_BODIES}, x AS (SELECT page_id, string_split(body, '<p>') AS s FROM e WHERE error IS NULL), y AS (SELECT page_id, unnest(range(2, len(s) + 1)) AS i, unnest(s[2:]) AS part FROM x)
SELECT page_id, (i - 2)::INT AS pos, 'p' AS tag, replace(trim(regexp_replace(replace(replace(part, '</p>', ''), '<br>', chr(1)), '[ \t\r\n]+', ' ', 'g'), ' '), chr(1), chr(10)) AS text FROM y""")
def rich_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every article that converts, in order."""
    rows = rich_text(bodies(spark, sf_dir), "page_id", "body").select("page_id", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("page_id", "pos", F.col("b.tag").alias("tag"), F.array_join(F.transform("b.runs", lambda r: r["text"]), "").alias("text"))


@query(rf"""WITH {_BODIES}, n AS (SELECT *, error IS NULL AS ok FROM e) SELECT page_id, error, CASE WHEN ok THEN true END AS match, CASE WHEN ok THEN len(regexp_extract_all(body, '<p>'))::INT END AS paragraphs,
CASE WHEN ok THEN len(regexp_extract_all(body, '<h[2-5]>'))::INT END AS headings, CASE WHEN ok THEN len(regexp_extract_all(body, '<li>'))::INT END AS items,
CASE WHEN ok THEN len(regexp_extract_all(body, '<br>'))::INT END AS breaks, CASE WHEN ok THEN len(regexp_extract_all(body, '<a '))::INT END AS links FROM n""")
def rich_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each article's blocks, rendered and read again, are the same, and what they hold; else the fault."""
    return rich_text_audit(bodies(spark, sf_dir), "page_id", "body").drop("digest")
