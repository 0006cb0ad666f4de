"""Mapping queries: orders stand for properties, documents for articles, customers for testimonials, parts for offers, suppliers for pre-listings, events for steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.mappings import CODES, mapped
from tessera.sources.io import read_table

from .registry import query

_CODE = {table: {label: code for code, label in codes.items()} for table, codes in CODES.items()}
#: Codes that the tables' values stand for; other values are no codes, so their items fail.
STATUS = {"O": _CODE["status"]["active"], "F": _CODE["status"]["sold"]}
PLACES = {"view": _CODE["placement"]["home"], "click": _CODE["placement"]["buy"]}


def _coded(name: str, codes: dict[str, str]) -> str:
    return f"CASE {name} " + "".join(f"WHEN '{k}' THEN '{v}' " for k, v in codes.items()) + f"ELSE {name} END"


#: Kind, table, key, time of creation, and fields. Customers are the images: known by file where they owe nothing, by URL where they build.
_ITEMS = (
    ("property", "orders", "o_orderkey", "cast(null as string)", {
        "id-kw": "o_orderpriority", "name": "concat('R', o_orderkey)", "estado-da-angariacao": _coded("o_orderstatus", STATUS), "quartos": "o_custkey",
        "outras-fotografias": "array(named_struct('fileId', concat('f', o_custkey), 'url', concat('u', o_custkey)), named_struct('fileId', concat('f', o_custkey + 1), 'url', concat('u', o_custkey + 1)))",
    }),
    ("article", "documents", "doc_id", "if(lang = 'en', '2024-01-01T00:00:00Z', lang)", {"name": "source", "artigo": "concat('<p>', lang, '</p>')", "tempo-de-leitura": "n_chars", "cta-copy": "lang"}),
    ("testimonial", "customer", "c_custkey", "cast(null as string)", {"name": "c_name", "testemunho-3": "c_mktsegment"}),
    ("offer", "part", "p_partkey", "cast(null as string)", {"name": "p_name", "copy": "p_type", "heading-copy": "p_brand"}),
    ("preListing", "supplier", "s_suppkey", "cast(null as string)", {"name": "s_name", "morada": "concat('No ', s_suppkey)", "freguesia": "concat('N', s_nationkey)", "galeria-2": "if(s_acctbal < 0, array('x'), array())"}),
    ("processStep", "events", "event_id", "cast(null as string)", {"name": "event_type", "copy": "props", "page": _coded("event_type", PLACES)}),
)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = None
    for kind, table, key, created, fields in _ITEMS:
        fields = {"slug": f"concat('s', {key})"} | fields
        body = F.to_json(F.struct(*[F.expr(x).alias(name) for name, x in fields.items()]))
        rows = read_table(spark, sf_dir, table).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit("pt").alias("locale"), F.expr(created).alias("created"), F.parse_json(body).alias("fields"))
        items = rows if items is None else items.unionByName(rows)
    c = read_table(spark, sf_dir, "customer")
    ref = F.concat(F.lit("image-"), F.col("c_custkey").cast("string"))
    files = c.filter("c_acctbal >= 0").select(F.concat(F.lit("f"), "c_custkey").alias("key"), ref.alias("ref"))
    urls = c.filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("u"), "c_custkey").alias("key"), F.concat(ref, F.lit("-u")).alias("ref"))
    return mapped(items, files.unionByName(urls))


def _json(kind: str, key: str, *parts: str) -> str:
    """SQL of a document: ``parts`` are SQL texts of members, null where there is none."""
    head = f"""'"_type":"{kind}","legacyId":"' || {key} || '","locale":"pt","sourceSlug":"s' || {key} || '","slug":{{"_type":"slug","current":"s' || {key} || '"}}'"""
    return f"'{{' || concat_ws(',', {head}, {', '.join(parts)}) || '}}'"


def _text(name: str, value: str) -> str:
    return f"""'"{name}":' || to_json({value})::VARCHAR"""


def _faults(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{told}' END" for told, condition in rules) + ")"


_IMAGE = """'{"_key":"source-' || %d || '-f' || %s || '","_type":"image","asset":{"_type":"reference","_ref":"' || %s || '"}}'"""
_MAPPED = f"""
assets AS (SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN 'image-' || c_custkey WHEN c_mktsegment = 'BUILDING' THEN 'image-' || c_custkey || '-u' END AS ref FROM customer),
properties AS (SELECT o.*, a.ref AS one, b.ref AS two, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'sold' END AS status
  FROM orders o LEFT JOIN assets a ON a.k = o_custkey LEFT JOIN assets b ON b.k = o_custkey + 1),
m AS (
  SELECT 'property' AS kind, o_orderkey::VARCHAR AS id, {_json("property", "o_orderkey", _text("title", "o_orderpriority"), _text("referenceCode", "'R' || o_orderkey"), _text("listingStatus", "status"),
    '''\'"bedrooms":\' || o_custkey''', f"""'"gallery":[' || {_IMAGE % (0, "o_custkey", "one")} || ',' || {_IMAGE % (1, "(o_custkey + 1)", "two")} || ']'""")} AS document,
    {_faults(("title=missing", "o_orderpriority IS NULL"), ("listingStatus=unknown option", "o_orderstatus IS NOT NULL AND status IS NULL"), ("gallery=no asset", "one IS NULL OR two IS NULL"))} AS faults FROM properties
  UNION ALL SELECT 'article', doc_id::VARCHAR, {_json("article", "doc_id", '''\'"publishedAt":"2024-01-01T00:00:00Z"\'''', _text("title", "source"),
    """'"body":[{"tag":"p","runs":[{"text":' || to_json(lang)::VARCHAR || ',"marks":[],"blank":false}]}]'""", '''\'"readingMinutes":\' || n_chars''', """'"cta":{"copy":' || to_json(lang)::VARCHAR || '}'""")},
    {_faults(("publishedAt=missing", "lang IS NULL"), ("publishedAt=no time", "lang <> ''en''".replace("''", "'")), ("title=missing", "source IS NULL"), ("body=missing", "lang IS NULL"))} FROM documents
  UNION ALL SELECT 'testimonial', c_custkey::VARCHAR, {_json("testimonial", "c_custkey", _text("clientName", "c_name"), _text("quote", "c_mktsegment"))},
    {_faults(("clientName=missing", "c_name IS NULL"), ("quote=missing", "c_mktsegment IS NULL"))} FROM customer
  UNION ALL SELECT 'offer', p_partkey::VARCHAR, {_json("offer", "p_partkey", _text("title", "p_name"), _text("heading", "p_brand"), _text("body", "p_type"))}, {_faults(("title=missing", "p_name IS NULL"))} FROM part
  UNION ALL SELECT 'preListing', s_suppkey::VARCHAR, {_json("preListing", "s_suppkey", _text("clientName", "s_name"), _text("address", "'No ' || s_suppkey"), _text("parish", "'N' || s_nationkey"))},
    {_faults(("galeria-2=unexpected", "s_acctbal < 0"), ("clientName=missing", "s_name IS NULL"))} FROM supplier
  UNION ALL SELECT 'processStep', event_id::VARCHAR, {_json("processStep", "event_id", _text("title", "event_type"), _text("body", "props"), _text("placement", "CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'buy' END"))},
    {_faults(("title=missing", "event_type IS NULL"), ("body=missing", "props IS NULL"), ("placement=unknown option", "event_type NOT IN ('view', 'click')"))} FROM events)"""


@query(f"""WITH {_MAPPED} SELECT kind, id, CASE WHEN faults = '' THEN document END AS document, faults FROM m""")
def mapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each item, or its faults as ``field=fault``; the code itself is left out of a fault."""
    told = F.transform("faults", lambda f: F.concat_ws("=", f["field"], F.regexp_replace(f["fault"], "^(unknown option).*$", "$1")))
    return _mapped(spark, sf_dir).select("kind", "id", "document", F.concat_ws(",", told).alias("faults"))


@query(f"""WITH {_MAPPED}, f AS (SELECT kind, unnest(string_split(faults, ',')) AS told FROM m WHERE faults <> '')
SELECT kind, split_part(told, '=', 1) AS field, split_part(told, '=', 2) AS fault, count(*) AS n FROM f GROUP BY ALL""")
def mapping_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: how many items of each kind fail at which field, and why."""
    # Of a plain column the optimiser would first filter by its size, and work out every fault twice for it.
    told = F.filter("faults", lambda f: f.isNotNull())
    faults = _mapped(spark, sf_dir).select("kind", F.explode(told).alias("f")).select("kind", "f.field", F.regexp_replace("f.fault", "^(unknown option).*$", "$1").alias("fault"))
    return faults.groupBy("kind", "field", "fault").agg(F.count("*").alias("n"))
