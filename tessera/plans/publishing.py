"""Contracts of published data: pages, parts, orders and events stand for exports, offers, request batches and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import url_path
from tessera.functions.web import file_name, name_uuid, robots_policy, site_url, video_embed, with_preview
from tessera.operators.publish import TYPES, live_slugs, offer_violations, reconciled_batches, route_verdicts, search_field_deltas, snapshot_violations, upload_states
from tessera.sources.io import read_table
from tessera.streaming.leads import stream_share_views

from .migration import _STAGED, staged_items
from .registry import query
from .site import _ANCHORS, _PATH, anchors, page_paths


def pick(values: tuple[str, ...], n: Column) -> Column:
    """The value that a number stands for."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


_TYPES = "['property', 'article', 'testimonial', 'offer', 'preListing', 'processStep']"


@query(f"""WITH r AS (SELECT page_id // 100 AS page, page_id % 100 AS pos, CASE WHEN page_id % 41 = 0 THEN 'drafts.' || page_id WHEN page_id % 53 = 0 THEN 'doc-000000001' ELSE 'doc-' || lpad(page_id::VARCHAR, 9, '0') END AS id,
  CASE WHEN page_id % 37 = 0 THEN 'other' ELSE {_TYPES}[page_id % 6 + 1] END AS type, CASE WHEN page_id % 31 = 0 THEN 'Bad_Slug' WHEN page_id % 23 = 0 THEN 'shared' ELSE 'item-' || page_id END AS slug,
  CASE WHEN page_id % 29 = 0 THEN 'old' END AS source_slug FROM pages WHERE page_id % 211 <> 5),
b AS (SELECT *, lag(id) OVER (ORDER BY page, pos) AS before, count(*) OVER (PARTITION BY type, slug) AS same, type IN ('property', 'article', 'preListing') AS routed FROM r),
v AS (SELECT page, pos, id, unnest([CASE WHEN id <= before THEN 'unordered' END, CASE WHEN id LIKE 'drafts.%' THEN 'unpublished' END, CASE WHEN type = 'other' THEN 'unknown-type' END,
  CASE WHEN routed AND NOT regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'invalid-slug' END, CASE WHEN routed AND source_slug <> slug THEN 'changed-slug' END, CASE WHEN routed AND same > 1 THEN 'duplicate-slug' END]) AS violation FROM b)
SELECT * FROM v WHERE violation IS NOT NULL
UNION ALL SELECT page, NULL, NULL, 'page-size' FROM (SELECT page, count(*) AS n FROM r GROUP BY page) WHERE n > 100 OR (n < 100 AND page < (SELECT max(page) FROM r))""")
def snapshot_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an export that was landed page by page."""
    n = F.col("page_id")
    id_ = F.when(n % 41 == 0, F.concat(F.lit("drafts."), n)).when(n % 53 == 0, "doc-000000001").otherwise(F.concat(F.lit("doc-"), F.lpad(n.cast("string"), 9, "0")))
    slug = F.when(n % 31 == 0, "Bad_Slug").when(n % 23 == 0, "shared").otherwise(F.concat(F.lit("item-"), n))
    rows = read_table(spark, sf_dir, "pages").filter(n % 211 != 5).select(F.floor(n / 100).alias("page"), (n % 100).alias("pos"), id_.alias("id"), F.when(n % 37 == 0, "other").otherwise(pick(TYPES, n)).alias("type"),
                                                                         slug.alias("slug"), F.when(n % 29 == 0, "old").alias("source_slug"))
    return snapshot_violations(rows, 100)


@query("""WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 'obrigado-x' WHEN p_partkey % 19 = 0 THEN 'reservada' ELSE 'oferta-' || p_partkey END AS slug, CASE WHEN p_partkey % 11 = 0 THEN p_name || chr(10) || 'x' ELSE p_name END AS title,
  CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_type END AS heading, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN repeat('x', 4001) ELSE p_brand END AS confirmation, '2024-01-' || lpad(p_size::VARCHAR, 2, '0') AS a FROM part)
SELECT k AS p_partkey, concat_ws(',', CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'slug' END, CASE WHEN k % 7 = 0 THEN 'changed-slug' END, CASE WHEN trim(heading) = '' THEN 'heading' END,
  CASE WHEN confirmation IS NULL OR length(confirmation) > 4000 THEN 'confirmation' END, CASE WHEN contains(title, chr(10)) THEN 'title-lines' END, CASE WHEN TRY_CAST(a AS DATE) IS NULL OR a > '2024-01-20' THEN 'dates' END,
  CASE WHEN k % 5 = 0 THEN 'image' END, CASE WHEN k % 3 = 0 THEN 'og-image' END) AS violations FROM o""")
def offer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    offers = read_table(spark, sf_dir, "part").select(
        n, F.when(n % 17 == 0, "obrigado-x").when(n % 19 == 0, "reservada").otherwise(F.concat(F.lit("oferta-"), n)).alias("slug"), F.when(n % 7 == 0, "x").alias("source_slug"),
        F.when(n % 11 == 0, F.concat("p_name", F.lit("\nx"))).otherwise(F.col("p_name")).alias("title"), F.when(n % 13 == 0, " ").otherwise(F.col("p_type")).alias("heading"),
        F.when(n % 23 == 0, F.lit(None)).when(n % 29 == 0, F.repeat(F.lit("x"), 4001)).otherwise(F.col("p_brand")).alias("confirmation"),
        F.concat(F.lit("2024-01-"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("start_date"), F.lit("2024-01-20").alias("end_date"),
        F.concat(F.lit("image-"), F.md5(F.col("p_name").cast("binary")), F.lit("-10x"), n % 5, F.lit("-jpg")).alias("image"), F.when(n % 3 == 0, "image-a1-10x10-svg").otherwise("image-a1-10x10-png").alias("og_image"),
    )
    return offer_violations(offers, ("reservada",)).select("p_partkey", F.concat_ws(",", "violations").alias("violations"))


_LANGS = "'^/(es|en|de)/'"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), inv AS (SELECT CASE WHEN page_id % 97 = 0 THEN path || '?x' ELSE path END AS path, page_id % 7 = 0 AS draft, NULL AS c FROM p WHERE page_id % 10 <> 1 AND NOT regexp_matches(path, {_LANGS})
  UNION ALL VALUES ('/es', false, 'es'), ('/en/', false, 'en'), ('/de', true, 'de'), (NULL, false, NULL)),
built AS (SELECT DISTINCT path FROM p WHERE page_id % 10 <> 0),
x AS (SELECT DISTINCT '/' || l || '/' || s AS path FROM (SELECT split_part(path, '/', 2) AS l, substr(path, 5) AS s FROM p WHERE regexp_matches(path, {_LANGS}) AND page_id % 3 <> 0) WHERE l IN ('es', 'en') AND s <> '' AND NOT contains(s, '/') AND path <> '/es/12'),
e AS (SELECT path FROM inv WHERE path NOT LIKE '%?%' AND c IS NULL AND NOT draft AND path <> '/es/12' UNION SELECT path FROM x UNION SELECT '/about')
SELECT path AS route, 'missing' AS verdict FROM e WHERE path NOT IN (SELECT path FROM built)
UNION ALL SELECT DISTINCT path, 'draft-built' FROM inv WHERE path NOT LIKE '%?%' AND c IS NULL AND draft AND path IN (SELECT path FROM built) AND path <> '/about'
UNION ALL SELECT '/es/12', 'excluded-built' WHERE '/es/12' IN (SELECT path FROM built)
UNION ALL SELECT path, 'unlisted' FROM built WHERE (path IN ('/es', '/en') OR path LIKE '/es/%' OR path LIKE '/en/%') AND path NOT IN (SELECT path FROM x) AND path <> '/about'
UNION ALL SELECT path, 'invalid-page' FROM inv WHERE path IS NULL OR path LIKE '%?%'""")
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built routes against an inventory with drafts and templates that stand for a collection's items."""
    paths = page_paths(spark, sf_dir).select("page_id", "path")
    below = F.regexp_extract("path", "^/(es|en|de)/(.*)$", 1)
    static = paths.filter((F.col("page_id") % 10 != 1) & (below == ""))
    pages = static.select(F.when(F.col("page_id") % 97 == 0, F.concat("path", F.lit("?x"))).otherwise(F.col("path")).alias("path"), (F.col("page_id") % 7 == 0).alias("draft"), F.lit(None).cast("string").alias("collection"))
    templates = spark.createDataFrame([("/es", False, "es"), ("/en/", False, "en"), ("/de", True, "de"), (None, False, None)], "path string, draft boolean, collection string")
    items = paths.filter((F.col("page_id") % 3 != 0) & (below != "")).select(below.alias("collection"), F.substr("path", F.lit(5)).alias("slug"))
    one = lambda route: spark.createDataFrame([(route,)], "route string")
    built = paths.filter("page_id % 10 <> 0").select(F.col("path").alias("route"))
    return route_verdicts(pages.unionByName(templates), items, built, one("/about"), one("/es/12"))


_ROBOTS = ("index, follow", "noindex, nofollow", "nofollow", "NOINDEX", "max-snippet:5, noindex")
_FIELDS = """f AS (SELECT page_id, unnest(['title', 'lang', 'charset', 'robots']) AS field, unnest([nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), nullif(regexp_extract(html, '<html lang="([^"]*)', 1), ''),
  nullif(regexp_extract(html, '<meta charset="([^"]*)', 1), ''), ['index, follow', 'noindex, nofollow', 'nofollow', 'NOINDEX', 'max-snippet:5, noindex'][page_id % 5 + 1]]) AS value FROM pages)"""


@query(f"""WITH {_FIELDS}, g AS (SELECT * FROM f WHERE value IS NOT NULL), j AS (SELECT coalesce(s.page_id, t.page_id - 1) AS route, coalesce(s.field, t.field) AS field, s.value AS s, t.value AS t
  FROM (SELECT * FROM g WHERE page_id % 2 = 0) s FULL JOIN (SELECT * FROM g WHERE page_id % 2 = 1) t ON t.page_id = s.page_id + 1 AND s.field = t.field),
k AS (SELECT *, list_transform(string_split(s, ','), lambda x: trim(x)) AS a, list_transform(string_split(t, ','), lambda x: trim(x)) AS b FROM j),
r AS (SELECT *, coalesce(list_contains(list_transform(b, lambda x: lower(x)), 'noindex'), false) AS hidden FROM k),
q AS (SELECT route, field, CASE WHEN field = 'robots' THEN nullif(array_to_string(list_filter(a, lambda x: lower(x) <> 'noindex' AND NOT (hidden AND lower(x) = 'nofollow')), ','), '') ELSE s END AS source,
  CASE WHEN field = 'robots' THEN nullif(array_to_string(list_filter(b, lambda x: lower(x) <> 'noindex' AND NOT (hidden AND lower(x) = 'nofollow')), ','), '') ELSE t END AS target FROM r)
SELECT * FROM q WHERE source IS DISTINCT FROM target""")
def search_field_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search fields of every even page against those of the page after it."""
    n = F.col("page_id")
    found = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    fields = {"title": found("<title>([^<]*)"), "lang": found('<html lang="([^"]*)'), "charset": found('<meta charset="([^"]*)'), "robots": pick(_ROBOTS, n)}
    wide = read_table(spark, sf_dir, "pages").select("page_id", *[c.alias(name) for name, c in fields.items()])
    rows = wide.unpivot("page_id", list(fields), "field", "value").filter("value is not null")
    source = rows.filter("page_id % 2 = 0").withColumnRenamed("page_id", "route")
    target = rows.filter("page_id % 2 = 1").select((n - 1).alias("route"), "field", "value")
    return search_field_deltas(source, target)


@query(f"""SELECT page_id, {_PATH} AS path, CASE WHEN {_PATH} IN ('/', '/es/1', '/blog') OR regexp_full_match({_PATH}, '/(imoveis|post|vouvender)/[a-z0-9]([a-z0-9-]*[a-z0-9])?') THEN 'index, follow' ELSE 'noindex, nofollow' END AS robots FROM pages""")
def page_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return rows.withColumn("robots", robots_policy(F.col("path"), ["/", "/es/1", "/blog"], production=True))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.youtube.com/embed/' || v || '?start=3723' WHEN 1 THEN 'https://www.youtube.com/embed/' || v || '?start=90' WHEN 2 THEN 'https://www.youtube.com/embed/' || v
  WHEN 3 THEN CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN url END END AS embed FROM (SELECT page_id, url, lpad(page_id::VARCHAR, 11, 'a') AS v FROM pages)""")
def video_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("page_id"), F.lpad(F.col("page_id").cast("string"), 11, "a")
    text = (
        F.when(n % 6 == 0, F.concat(F.lit(" https://youtu.be/"), v, F.lit("?t=1h2m3s"))).when(n % 6 == 1, F.concat(F.lit('<iframe SRC="https://www.youtube.com/watch?v='), v, F.lit('&start=90"></iframe>')))
        .when(n % 6 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).when(n % 6 == 3, F.col("url")).when(n % 6 == 4, "ftp://example.org/x").otherwise("https://youtube.com/watch?v=short")
    )
    return read_table(spark, sf_dir, "pages").select("page_id", video_embed(text).alias("embed"))


#: Fixed value: the registered namespace of URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query(f"""SELECT file_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || d[17])::INT % 4 + 1] || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS request_key FROM
(SELECT p_partkey AS file_id, sha1(unhex('{URL_NAMESPACE}') || ('{{"attempt":0,"bytes":' || (p_size + 1) || ',"fileId":"f' || p_partkey || '","sha1":"' || sha1(p_name) || '","url":"https://example.org/' || p_partkey || '.jpg"}}')::BLOB) AS d FROM part)""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which an upload is asked for, the same for the same file and attempt."""
    n = F.col("p_partkey")
    name = F.struct(F.lit(0).alias("attempt"), (F.col("p_size") + 1).alias("bytes"), F.concat(F.lit("f"), n).alias("fileId"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"), F.concat(F.lit("https://example.org/"), n, F.lit(".jpg")).alias("url"))
    return read_table(spark, sf_dir, "part").select(n.alias("file_id"), name_uuid(URL_NAMESPACE, F.to_json(name)).alias("request_key"))


@query("""SELECT page_id, CASE WHEN l = '' THEN 'original-image' ELSE coalesce(try(url_decode(l)), l) END AS name FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS l FROM pages)""")
def source_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", file_name(F.col("url")).alias("name"))


_WRAP = r"""l{i} AS (SELECT *, regexp_replace(split_part(rest, chr(10), 1), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') AS p{i}, instr(rest, chr(10)) AS nl{i} FROM {before}),
c{i} AS (SELECT *, CASE WHEN length(p{i}) <= 78 THEN length(p{i}) ELSE coalesce(nullif(78 - instr(reverse(substr(p{i}, 1, 78)), ' '), 0), 78) END AS e{i} FROM l{i}),
d{i} AS (SELECT * REPLACE (CASE WHEN e{i} < length(p{i}) THEN substr(p{i}, e{i} + 1) || CASE WHEN nl{i} > 0 THEN chr(10) || substr(rest, nl{i} + 1) ELSE '' END WHEN nl{i} > 0 THEN substr(rest, nl{i} + 1) END AS rest), substr(p{i}, 1, e{i}) AS line{i} FROM c{i})"""


@query(f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS rest FROM documents), {_WRAP.format(i=1, before='t')}, {_WRAP.format(i=2, before='d1')}
SELECT doc_id, CASE WHEN rest IS NOT NULL THEN line1 || chr(10) || regexp_replace(substr(line2, 1, 77), '[\\s\\x{{00a0}}]+$', '') || '…' WHEN line2 IS NOT NULL THEN line1 || chr(10) || line2 ELSE line1 END AS preview FROM d2""")
def message_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lines of a text that a mail may show."""
    return with_preview(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "preview")


@query(f"""WITH {_ANCHORS}, u AS (SELECT page_id, href, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM links JOIN pages USING (page_id)),
w AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN origin || href WHEN href = '' THEN origin || path WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  ELSE origin || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || href END AS whole FROM u),
h AS (SELECT *, lower(regexp_extract(whole, '^([A-Za-z]+://[^/?#]*)', 1)) AS o, regexp_extract(whole, '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS rest FROM w)
SELECT page_id, href, CASE WHEN whole IS NULL THEN href ELSE CASE WHEN split_part(o, '://', 2) IN (split_part(lower(origin), '://', 2), 'www.example.org') THEN '' ELSE o END || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END || rest END AS target FROM h""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a page's links lead, as seen from its own site."""
    links = anchors(spark, sf_dir).select("page_id", "href").distinct()
    rows = links.join(read_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return rows.select("page_id", "href", site_url(F.col("href"), F.col("url"), ("www.example.org",)).alias("target"))


@query(r"""SELECT slug, count(*) AS views FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS slug FROM pages) WHERE page_id % 3 <> 0 AND slug <> '' GROUP BY 1""")
def stream_share_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of shared links by slug, from a stream; a view without a token doesn't count."""
    token = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("k"), "page_id"))
    link = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("?a=1&t="), token, F.lit("#top"))
    return stream_share_views(spark, f"{sf_dir}/pages.parquet", link)


@query("""WITH e AS (SELECT o_orderkey // 50 AS batch, o_orderkey AS k, 's' || o_orderkey AS slug, o_orderstatus AS type FROM orders),
d AS (SELECT batch, k, k % 40 <> 3 AS here, k % 333 = 7 AND k % 40 <> 3 AS twice, k % 400 = 9 AND k % 40 <> 3 AS moved, k % 450 = 11 AND k % 40 <> 3 AS changed, k % 500 = 13 AS taken FROM e),
b AS (SELECT batch, count(*) FILTER (here) AS there, count(*) FILTER (NOT here) AS gone, CASE WHEN bool_or(taken) THEN 'foreign-id' WHEN bool_or(twice) THEN 'duplicate' WHEN bool_or(moved) THEN 'identity-mismatch' WHEN bool_or(changed) THEN 'content-mismatch' END AS r FROM d GROUP BY 1)
SELECT batch, CASE WHEN r IS NOT NULL OR gone > 1 THEN 'blocked' WHEN gone = 0 THEN 'complete' ELSE 'retry-missing-only' END AS status, coalesce(r, CASE WHEN gone > 1 THEN 'retry-too-large' END) AS reason,
CASE WHEN r IS NULL THEN there ELSE 0 END AS complete, CASE WHEN r IS NULL THEN gone ELSE 0 END AS missing FROM b""")
def unknown_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of fifty orders whose outcome is unknown, judged by the documents that are there."""
    k = F.col("o_orderkey")
    text = lambda prefix: F.concat(F.lit(prefix), k)
    expected = read_table(spark, sf_dir, "orders").select(F.floor(k / 50).alias("batch"), text("d").alias("id"), F.col("o_orderstatus").alias("type"), k.alias("legacy_id"), F.lit("pt").alias("locale"), text("s").alias("slug"),
                                                          F.format_string("%.2f", "o_totalprice").alias("content"), F.lit(100).alias("bytes"), k)
    there = expected.filter(k % 40 != 3).drop("bytes", "batch")
    there = there.withColumn("slug", F.when(k % 400 == 9, F.concat("slug", F.lit("-x"))).otherwise(F.col("slug"))).withColumn("content", F.when(k % 450 == 11, "x").otherwise(F.col("content")))
    twice = there.filter(k % 333 == 7).withColumn("id", F.concat("id", F.lit("-again")))
    foreign = expected.filter(k % 500 == 13).drop("bytes", "batch").withColumn("legacy_id", -1 - k)
    return reconciled_batches(expected, there.unionByName(twice).unionByName(foreign).drop("o_orderkey"), limit=150, envelope=40)


@query(f"""WITH {_STAGED}, l AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'xx' ELSE locale END AS locale, slug || '-live' AS slug FROM staged WHERE id % 5 <> 0 UNION ALL SELECT id, 'yy', slug || '-y' FROM staged WHERE id % 4 = 0)
SELECT s.id, s.locale, s.slug, coalesce((SELECT max(slug) FROM l WHERE l.id = s.id AND l.locale = s.locale), (SELECT CASE WHEN count(*) = 1 THEN max(slug) END FROM l WHERE l.id = s.id), s.slug) AS live_slug FROM staged s""")
def live_slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = staged_items(spark, sf_dir)
    one = staged.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, "xx").otherwise(F.col("locale")).alias("locale"), F.concat("slug", F.lit("-live")).alias("slug"))
    two = staged.filter("id % 4 = 0").select("id", F.lit("yy").alias("locale"), F.concat("slug", F.lit("-y")).alias("slug"))
    return live_slugs(staged, one.unionByName(two))


@query("""WITH RECURSIVE e AS (SELECT user_id AS file_id, event_id AS seq, (regexp_extract(props, '"k": ([0-9]+)', 1))::INT AS k, CASE event_type WHEN 'click' THEN 'claim' WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'retry' ELSE 'resume' END AS kind FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS i, ['running', 'awaiting-metadata', 'failed', 'unknown', 'other'][k % 5 + 1] AS told FROM e),
f AS (SELECT file_id, 0::BIGINT AS i, 0::BIGINT AS seq, 'planned' AS status, 0::BIGINT AS attempt, 'applied' AS outcome FROM (SELECT DISTINCT file_id FROM o)
UNION ALL SELECT file_id, i, seq, CASE WHEN NOT ok THEN status WHEN kind = 'claim' THEN 'submitting' WHEN kind = 'submit' THEN CASE WHEN k % 7 = 0 OR told = 'other' THEN 'unknown' ELSE told END WHEN kind = 'status' THEN told
    WHEN kind = 'retry' THEN 'retry-authorized' ELSE 'unknown' END, CASE WHEN ok AND kind = 'retry' THEN attempt + 1 ELSE attempt END, CASE WHEN ok THEN 'applied' ELSE 'refused' END
FROM (SELECT o.*, f.status, f.attempt, CASE kind WHEN 'claim' THEN f.status IN ('planned', 'retry-authorized') WHEN 'submit' THEN f.status = 'submitting' WHEN 'resume' THEN f.status = 'submitting' WHEN 'retry' THEN f.status = 'failed'
  ELSE f.status NOT IN ('planned', 'retry-authorized', 'submitting') AND told <> 'other' END AS ok FROM o JOIN f ON o.file_id = f.file_id AND o.i = f.i + 1))
SELECT file_id, seq, status, attempt, outcome FROM f WHERE i > 0""")
def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an asset's upload has come to after each of its events."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "claim", "signup", "submit", "view", "status", "purchase", "retry")]), F.col("event_type"))
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("resume")).alias("kind"),
                                                      pick(("running", "completed", "failed", "unknown", "other"), k).alias("status"), F.when(k % 7 != 0, F.concat(F.lit("op"), k)).alias("operation"))
    return upload_states(rows)


@query("""WITH n AS (SELECT greatest(1, ceil(count(*) / 6.0))::BIGINT AS total FROM part), r AS (SELECT event_id, (regexp_extract(props, '"k": ([0-9]+)', 1))::BIGINT AS k FROM events)
SELECT event_id, least(greatest(k, 1), total) AS page, least(greatest(k, 1), total) > 1 AS previous, least(greatest(k, 1), total) < total AS next FROM r, n""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a request gets: the nearest one there is, and whether there are others before and after it."""
    total = read_table(spark, sf_dir, "part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 6)).alias("total")).scalar()
    k = F.get_json_object("props", "$.k").try_cast("long")
    page = F.least(F.greatest(F.coalesce(k, F.lit(1)), F.lit(1)), F.col("total"))
    rows = read_table(spark, sf_dir, "events").select("event_id", "props", total.alias("total")).select("event_id", page.alias("page"), "total")
    return rows.select("event_id", "page", (F.col("page") > 1).alias("previous"), (F.col("page") < F.col("total")).alias("next"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text) <> '' ORDER BY conv_id, turn LIMIT 10""")
def first_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten quotes that a page shows: usable ones, first by their ids."""
    rows = read_table(spark, sf_dir, "conversations").filter("role = 'user'").filter(F.trim("text") != "")
    return rows.select("conv_id", "turn", "text").orderBy("conv_id", "turn").limit(10)
