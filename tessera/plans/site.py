"""Route, sitemap and page-contract queries over the raw pages and conversations."""

from __future__ import annotations

from collections.abc import Iterable
from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import url_host, url_path, xml_escape
from tessera.operators.ordinals import runs
from tessera.operators.pagecontract import contracts, link_differences, links
from tessera.sources.io import read_table

from .registry import query

_PATH = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\.html$', ''), '/+$', ''), ''), '/')"""
ANCHOR = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)'


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", url_path(F.col("url")).alias("path"), url_host(F.col("url")).alias("host"))


@query(f"""WITH b AS (SELECT DISTINCT {_PATH} AS route FROM pages WHERE page_id % 10 <> 0), e AS (SELECT DISTINCT {_PATH} AS route FROM pages WHERE page_id % 10 <> 1)
SELECT coalesce(b.route, e.route) AS route, CASE WHEN b.route IS NULL THEN 'missing' ELSE 'unlisted' END AS verdict FROM b FULL JOIN e ON b.route = e.route WHERE b.route IS NULL OR e.route IS NULL""")
def route_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected routes that are not built, and built ones that no one expects."""
    paths = page_paths(spark, sf_dir)
    built = paths.filter("page_id % 10 <> 0").select("path").distinct()
    expected = paths.filter("page_id % 10 <> 1").select("path").distinct()
    missing = expected.join(built, "path", "left_anti").withColumn("verdict", F.lit("missing"))
    unlisted = built.join(expected, "path", "left_anti").withColumn("verdict", F.lit("unlisted"))
    return missing.unionByName(unlisted).withColumnRenamed("path", "route")


@query(f"""WITH u AS (SELECT page_id, 'https://www.example.org' || {_PATH} AS loc FROM pages)
SELECT loc, min(page_id) AS place, max(page_id) AS last_page, '<url><loc>' || replace(loc, '&', '&amp;') || '</loc></url>' AS xml FROM u GROUP BY loc""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a canonical URL: the last page wins, the first one's place stays."""
    rows = page_paths(spark, sf_dir).select("page_id", F.concat(F.lit("https://www.example.org"), "path").alias("loc"))
    entries = rows.groupBy("loc").agg(F.min("page_id").alias("place"), F.max("page_id").alias("last_page"))
    return entries.withColumn("xml", F.concat(F.lit("<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc></url>")))


def page_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promises of the raw pages."""
    return contracts(read_table(spark, sf_dir, "pages"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pos, href, label`` of every visible link; scripts and in-page anchors are left out."""
    rows = page_contract(spark, sf_dir).filter((F.col("kind") == "link") & F.col("visible") & ~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("javascript:")))
    return rows.select("page_id", "pos", F.col("value").alias("href"), "label")


_ANCHORS = rf"""a AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(l) AS label FROM
  (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS h, regexp_extract_all(html, '{ANCHOR}', 2) AS l FROM pages)),
links AS (SELECT page_id, href, min_by(label, pos) AS label FROM a WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') GROUP BY 1, 2)"""


@query(rf"WITH {_ANCHORS} SELECT page_id, href, trim(regexp_replace(label, '[ \t\n\r\f\x0b\x{{00a0}}]+', ' ', 'g')) AS label FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(page_contract(spark, sf_dir)).select("page_id", "href", "label")


@query(f"""WITH {_ANCHORS} SELECT coalesce(s.page_id, t.page_id - 1) AS page_id, coalesce(s.href, t.href) AS href, CASE WHEN t.href IS NULL THEN 'source-only' ELSE 'target-only' END AS side
FROM (SELECT * FROM links WHERE page_id % 2 = 0) s FULL JOIN (SELECT * FROM links WHERE page_id % 2 = 1) t ON t.page_id = s.page_id + 1 AND s.href = t.href WHERE s.href IS NULL OR t.href IS NULL""")
def page_link_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every even page against the page after it."""
    found = links(page_contract(spark, sf_dir))
    target = found.filter("page_id % 2 = 1").withColumn("page_id", F.col("page_id") - 1)
    return link_differences(found.filter("page_id % 2 = 0"), target).select("page_id", "href", "side")


TAGS = ("p", "h1", "h2", "li", "b", "a")


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]'))::INT AS n_{t}" for t in TAGS) + " FROM pages")
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_contract(spark, sf_dir).filter("kind = 'tag'")
    n = lambda t: F.coalesce(F.max(F.when(F.col("name") == t, F.col("value").cast("int"))), F.lit(0)).alias(f"n_{t}")
    return rows.groupBy("page_id").agg(*map(n, TAGS))


def _values(pairs: Iterable[tuple[int | str, str]]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ")"


#: SQL of HTML's character references: the names of the standard, which may end without their semicolon, and the numbers that stand for another text than their own.
_OTHERS = (*range(160), *range(0xFDD0, 0xFDF0), *(plane * 0x10000 + low for plane in range(17) for low in (0xFFFE, 0xFFFF)))
_NAMES, _NUMBERS = _values(html5.items()), _values((n, t) for n in _OTHERS if (t := unescape(f"&#{n};")) != chr(n))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TITLES = rf"""raw AS (SELECT page_id, regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1) AS text FROM pages),
refs AS (SELECT page_id, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS ref FROM (SELECT page_id, regexp_extract_all(text, '{_REFERENCE}') AS r FROM raw)),
digits AS (SELECT *, ltrim(regexp_extract(ref, '^&#([0-9]+)', 1), '0') AS dec, lower(ltrim(regexp_extract(ref, '^&#[xX]([0-9a-fA-F]+)', 1), '0')) AS hex FROM refs WHERE starts_with(ref, '&#')),
numbers AS (SELECT page_id, i, CASE WHEN length(dec) > 7 OR length(hex) > 6 THEN 1114112 WHEN dec <> '' THEN dec::BIGINT
  ELSE list_sum([0] || list_transform(range(1, length(hex) + 1), lambda k: ((instr('0123456789abcdef', hex[k]) - 1) * pow(16, length(hex) - k))::BIGINT))::BIGINT END AS n FROM digits),
names AS (SELECT page_id, i, max_by(value || substr(ref, length(name) + 2), length(name)) AS got FROM (SELECT *, unnest(range(2, length(ref))) AS k FROM refs WHERE NOT starts_with(ref, '&#'))
  JOIN {_NAMES} names(name, value) ON substr(ref, 2, k) = name GROUP BY ALL),
got AS (SELECT page_id, i, coalesce(names.got, CASE WHEN numbers.n IS NULL THEN ref WHEN other.value IS NOT NULL THEN other.value WHEN numbers.n > 1114111 OR numbers.n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(numbers.n::INT) END) AS got
  FROM refs LEFT JOIN names USING (page_id, i) LEFT JOIN numbers USING (page_id, i) LEFT JOIN {_NUMBERS} other(code, value) ON other.code = numbers.n),
plain AS (SELECT page_id, unnest(range(len(s))) AS i, unnest(s) AS between FROM (SELECT page_id, string_split_regex(text, '{_REFERENCE}') AS s FROM raw)),
titles AS (SELECT page_id, nullif(trim(regexp_replace(regexp_replace(string_agg(coalesce(got, '') || between, '' ORDER BY i), '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '{_SPACES}', ' ', 'g')), '') AS title
  FROM plain LEFT JOIN got USING (page_id, i) GROUP BY page_id)"""


@query(f"""WITH {_TITLES} SELECT page_id, title, coalesce(len(regexp_extract_all(html, '<a [^>]*href=')), 0)::BIGINT AS n_links,
coalesce(len(regexp_extract_all(html, '<form[ >]')), 0)::BIGINT AS n_forms FROM pages LEFT JOIN titles USING (page_id)""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title (character references read, null where it is empty), links and forms of each page, also of those that promise nothing."""
    kind = F.col("kind")
    rows = page_contract(spark, sf_dir).select("page_id", "kind", "name", "value")
    every = read_table(spark, sf_dir, "pages").select("page_id", *[F.lit(None).cast("string").alias(c) for c in ("kind", "name", "value")])
    title = F.max(F.when((kind == "meta") & (F.col("name") == "title"), F.col("value"))).alias("title")
    return rows.unionByName(every).groupBy("page_id").agg(title, F.count_if(kind == "link").alias("n_links"), F.count_if(kind == "form").alias("n_forms"))


_RUNS = """r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM
(SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations))"""


@query(f"WITH {_RUNS} SELECT conv_id, turn, role, run::BIGINT AS run FROM r")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").withColumn("run", F.col("run").cast("long"))


@query(f"WITH {_RUNS} SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1, 2")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    merged = runs(rows, "conv_id", "turn", "role").groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum("chars").cast("long").alias("chars"))
    return merged.withColumn("run", F.col("run").cast("long"))


@query("""SELECT CASE WHEN h LIKE '%spam%' OR h LIKE '%cheap%' THEN 'suspect' WHEN h LIKE 'www.%' THEN 'www' WHEN h LIKE 'm.%' OR h LIKE 'blog.%' THEN 'sub' ELSE 'bare' END AS provider, count(*) AS n,
count(*) FILTER (url LIKE 'https:%') AS secure, max(length(url)) AS longest FROM (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages) GROUP BY 1""")
def media_link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = url_host(F.col("url"))
    provider = F.when(h.contains("spam") | h.contains("cheap"), "suspect").when(h.startswith("www."), "www").when(h.startswith("m.") | h.startswith("blog."), "sub").otherwise("bare")
    rows = read_table(spark, sf_dir, "pages").select(provider.alias("provider"), "url")
    return rows.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(F.startswith("url", F.lit("https:"))).alias("secure"), F.max(F.length("url")).cast("long").alias("longest"))
