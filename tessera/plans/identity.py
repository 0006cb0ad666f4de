"""Media identity: documents stand for originals; what is known of them, for receipts of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.identity import embedded_hashes, image_identity, media_evidence, merged_receipts
from tessera.sources.io import read_table

from .registry import query

_DOCS = "d AS (SELECT doc_id, lang, n_chars, source, text, sha1(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM documents WHERE doc_id IS NOT NULL)"


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, n_chars, source, content, digest, bytes``; a null text is an empty file."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "lang", "n_chars", "source", content.alias("content"))
    return rows.withColumns({"digest": F.sha1("content"), "bytes": F.octet_length("content").cast("long")})


@query(f"""WITH {_DOCS}, k AS (SELECT doc_id, 'https://a.example/' || doc_id AS url, digest, bytes, doc_id % 10 AS k FROM d),
r AS (SELECT doc_id, CASE WHEN k IN (2, 3) THEN 'https://b.example/' || doc_id ELSE url END AS rurl, CASE WHEN k = 4 THEN sha1('') ELSE digest END AS rdigest, bytes AS rbytes
  FROM k WHERE k NOT IN (0, 1, 2) AND bytes > 0)
SELECT k.doc_id AS file_id, k.url, 1 AS occurrences,
  CASE WHEN r.rurl = k.url AND k <> 5 AND rdigest = digest THEN digest END AS sha1, CASE WHEN r.rurl = k.url AND k <> 5 AND rdigest = digest THEN bytes END AS bytes,
  CASE WHEN r.rurl IS NULL OR r.rurl <> k.url THEN 'no-receipt' WHEN k = 5 THEN 'not-kept' WHEN rdigest = digest THEN 'reused' ELSE 'differs' END AS status
FROM k LEFT JOIN r USING (doc_id)""")
def media_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids by last digit: 0 has no receipt, 1 and 2 an untrusted one, 3 one of another URL, 4 of other bytes, 5 isn't kept; 6 and 7 are mended by the run's own state."""
    rows, k = originals(spark, sf_dir), F.col("doc_id") % 10
    url = F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string"))
    moved = F.concat(F.lit("https://b.example/"), F.col("doc_id").cast("string"))
    fields = lambda u, sha1, trusted: [F.col("doc_id").alias("file_id"), u.alias("url"), sha1.alias("sha1"), "bytes", trusted.alias("trusted"), F.lit(0).alias("pos")]
    validated = rows.filter(k.between(1, 9)).select(*fields(F.when(k.isin(2, 3), moved).otherwise(url), F.when(k.isin(4, 6), F.sha1(F.lit(b""))).otherwise(F.col("digest")), k > 2))
    state = rows.filter(k.isin(6, 7, 8)).select(*fields(F.when(k == 8, moved).otherwise(url), F.col("digest"), k < 8))
    slots = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), url.alias("url"))
    kept = rows.filter(k != 5).select(F.col("doc_id").alias("file_id"), "content")
    return media_evidence(slots, merged_receipts(validated, state), kept)


@query(f"""WITH {_DOCS}, f AS (SELECT lang, n_chars, min(doc_id) AS first_id FROM d GROUP BY 1, 2),
p AS (SELECT d.doc_id, first_id, 'u' || d.doc_id AS source_url, CASE WHEN d.doc_id % 3 = 0 THEN 'u/production/' || t.digest || '-' || first_id ELSE 'u' || first_id END AS target_url,
  d.digest, t.digest AS other, d.bytes, t.bytes AS other_bytes FROM d JOIN f ON d.lang IS NOT DISTINCT FROM f.lang AND d.n_chars IS NOT DISTINCT FROM f.n_chars JOIN d AS t ON t.doc_id = first_id),
v AS (SELECT *, source_url = target_url AS same, doc_id % 3 = 0 AND doc_id % 2 = 0 AND digest = other AS told,
  doc_id % 3 <> 0 AND digest = other AND bytes BETWEEN 1 AND 20971520 AND other_bytes BETWEEN 1 AND 20971520 AS equal FROM p)
SELECT source_url, target_url, count(*) AS n,
  any_value(CASE WHEN same THEN 'same-url' WHEN told OR equal THEN 'same-original-content' ELSE 'content-identity-unverified' END) AS status,
  any_value(CASE WHEN same THEN 'url' WHEN told THEN 'recorded' WHEN equal THEN 'bytes' END) AS evidence FROM v GROUP BY 1, 2""")
def media_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the first of its language and length; ids that 3 divides are settled by records, of which those of even ids are good, or not at all."""
    rows = originals(spark, sf_dir)
    narrow = rows.select("doc_id", "lang", "n_chars", "digest")
    first = narrow.groupBy("lang", "n_chars").agg(F.min(F.struct("doc_id", "digest")).alias("_f"))
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u/production/"), "_f.digest", F.lit("-"), F.col("_f.doc_id").cast("string"))).otherwise(F.concat(F.lit("u"), F.col("_f.doc_id").cast("string")))
    # Lengths have few values beside the documents, but not surely: the join is by sort, and a language is no key of its own.
    f = first.select(F.col("lang").alias("_lang"), F.col("n_chars").alias("_n"), "_f")
    pairs = narrow.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("n_chars").eqNullSafe(F.col("_n"))).select(url.alias("source_url"), target.alias("target_url"))
    recorded = narrow.select(url.alias("url"), F.col("digest").alias("target_sha1"), (F.col("doc_id") % 2 == 0).alias("matches"), F.lit(0).alias("pos"))
    return image_identity(pairs, recorded, rows.select(url.alias("url"), "content"))


@query(f"""WITH {_DOCS}, r AS (SELECT 'image-' || digest || '-' || source AS ref, min(doc_id) FILTER (doc_id % 7 <> 0) AS file_id, min(digest) AS digest FROM d WHERE source IS NOT NULL GROUP BY 1),
w AS (SELECT *, file_id % 11 = 0 AS lost FROM r)
SELECT ref, file_id, CASE WHEN file_id IS NULL THEN 'missing-map' WHEN lost THEN 'missing-original-file' ELSE 'matches' END AS status FROM w""")
def embedded_hash_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the digest of a text, a source each; ids that 7 divides aren't mapped, those that 11 divides not kept."""
    rows = originals(spark, sf_dir).filter("source is not null")
    ref = F.concat(F.lit("image-"), "digest", F.lit("-"), "source")
    mapping = rows.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("file_id"), ref.alias("ref"))
    kept = rows.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("file_id"), "content")
    return embedded_hashes(rows.select(ref.alias("ref")), mapping, kept)
