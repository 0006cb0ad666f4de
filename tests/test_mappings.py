"""Items of six kinds against documents written by hand."""

import json
import re

from pyspark.sql import functions as F

from tessera.operators.mappings import CODES, RULES, cut, mapped
from tessera.plans.mapping import mapped_documents, mapping_faults

CODE = {table: {label: code for code, label in codes.items()} for table, codes in CODES.items()}
ASSETS = [("f1", "image-1"), ("u2", "image-2"), ("f2", None), ("f3", "file-3"), ("f1", "image-9"), ("f4", "image-4"), ("u4", "image-u4")]


def run(spark, rows):
    """(document, faults) of each (kind, id, locale, created, fields)."""
    given = [(k, i, loc, c, f if f is None or isinstance(f, str) else json.dumps(f)) for k, i, loc, c, f in rows]
    items = spark.createDataFrame(given, "kind string, id string, locale string, created string, j string").withColumn("fields", F.try_parse_json("j"))
    clash = items.withColumns({c: F.lit(1) for c in ("_key", "parts", "document", "ref", "target")})
    got = mapped(clash, spark.createDataFrame(ASSETS, "key string, ref string")).collect()
    return {r.id: (json.loads(r.document) if r.document else None, [tuple(f) for f in r.faults]) for r in got}, len(got)


def head(kind, i):
    return {"_type": kind, "legacyId": i, "locale": "pt", "sourceSlug": "s", "slug": {"_type": "slug", "current": "s"}}


def test_six_kinds(spark):
    blocks = [{"tag": "p", "runs": [{"text": "a", "marks": ["em"], "blank": False}]}]
    image = lambda ref, **more: {"_type": "image", "asset": {"_type": "reference", "_ref": ref}, **more}
    rows = [
        ("property", "p", "pt", None, {
            "slug": " s ", "id-kw": " T ", "name": "R1", "descricao-completa": "<p><em>a</em></p>", "estado-da-angariacao": CODE["status"]["sold"], "preco": 12.5, "preco-sob-consulta": False,
            "natureza-do-imovel": "", "principais-concelhos": CODE["municipality"]["Maia"], "quartos": 3, "casas-de-banho": "2", "certificado-energetico": CODE["energy"]["B-"], "elevador": True, "piscina": None,
            "fotografia-de-destaque": {"fileId": "f1", "url": "x", "alt": " A "}, "outras-fotografias": [{"fileId": "f2", "url": "u2", "alt": ""}, {"fileId": "f4", "url": "u4"}, {"fileId": "f1", "url": "u2"}],
            "link-video": {"url": "v"}, "matterport": 5,
        }),
        ("article", "a", "pt", "2024-01-02T03:04:05Z", {"slug": "s", "name": "N", "artigo": "<p><em>a</em></p>", "tempo-de-leitura": 4, "cta-copy": "c", "galeria": []}),
        ("testimonial", "t", "pt", None, {"slug": "s", "name": "N", "testemunho-3": "Q"}),
        ("offer", "o", "pt", None, {"slug": "s", "name": "N", "copy": " "}),
        ("preListing", "l", "pt", None, {"slug": "s", "name": "N", "morada": "M", "freguesia": "F", "galeria-2": []}),
        ("processStep", "s", "pt", None, {"slug": "s", "name": "N", "copy": "C", "page": CODE["placement"]["buy"]}),
    ]
    got, n = run(spark, [*rows, rows[0]])
    assert n == 7 and all(not faults for _, faults in got.values()), got
    assert got["p"][0] == head("property", "p") | {
        "title": "T", "referenceCode": "R1", "description": blocks, "listingStatus": "sold", "price": 12.5, "priceOnRequest": False, "municipality": "Maia", "bedrooms": 3, "energyCertificate": "B-",
        "amenities": {"elevator": True}, "featuredImage": image("image-1", alt="A"), "videoUrl": "v",
        "gallery": [{"_key": "source-0-f2", **image("image-2")}, {"_key": "source-1-f4", **image("image-4")}, {"_key": "source-2-f1", **image("image-1")}],
    }
    assert got["a"][0] == head("article", "a") | {"publishedAt": "2024-01-02T03:04:05Z", "title": "N", "body": blocks, "readingMinutes": 4, "cta": {"copy": "c"}}
    assert got["t"][0] == head("testimonial", "t") | {"clientName": "N", "quote": "Q"}
    assert got["o"][0] == head("offer", "o") | {"title": "N"}
    assert got["l"][0] == head("preListing", "l") | {"clientName": "N", "address": "M", "parish": "F"}
    assert got["s"][0] == head("processStep", "s") | {"title": "N", "body": "C", "placement": "buy"}


def test_faults_are_told_by_field(spark):
    ok = {"slug": "s", "name": "N"}
    rows = [
        ("property", "code", "pt", None, ok | {"id-kw": "T", "estado-da-angariacao": "zz", "banner-de-mercado": {"a": 1}, "principais-concelhos": "zz"}),
        ("property", "image", "pt", None, ok | {"id-kw": "T", "fotografia-de-destaque": {"fileId": "f3", "url": "x"}, "outras-fotografias": [{"fileId": "f1", "url": "u"}, None]}),
        ("property", "url", "pt", None, ok | {"id-kw": "T", "fotografia-de-destaque": {"fileId": "f1"}, "descricao-completa": "<table></table>"}),
        ("article", "time", " ", "soon", ok | {"artigo": None}),
        ("preListing", "gallery", "pt", None, ok | {"morada": "M", "freguesia": 5, "galeria-2": [{}]}),
        ("processStep", "page", "pt", None, ok | {"copy": "C"}),
        ("offer", "null", "pt", None, None),
        ("offer", "text", "pt", None, '"s"'),
        ("offer", None, None, None, ok),
        ("house", "kind", "pt", None, ok),
        (None, "none", "pt", None, ok),
    ]
    got, n = run(spark, rows)
    assert n == len(rows) and all(document is None for document, _ in got.values())
    assert {i: faults for i, (_, faults) in got.items()} == {
        "code": [("listingStatus", "unknown option zz"), ("marketBanner", 'unknown option {"a":1}')],
        "image": [("featuredImage", "no asset"), ("gallery", "missing file id")],
        "url": [("description", "unsupported <table>"), ("featuredImage", "missing url")],
        "time": [("locale", "missing"), ("publishedAt", "no time"), ("body", "missing")],
        "gallery": [("galeria-2", "unexpected"), ("parish", "missing")],
        "page": [("placement", "missing")],
        "null": [("sourceSlug", "missing"), ("title", "missing")],
        "text": [("sourceSlug", "missing"), ("title", "missing")],
        None: [("legacyId", "missing"), ("locale", "missing")],
        "kind": [("kind", "unknown")],
        "none": [("kind", "unknown")],
    }


def test_empty_tables_and_names_of_rules(spark):
    items = spark.createDataFrame([], "kind string, id string, locale string, created string").withColumn("fields", F.try_parse_json("id"))
    assert mapped(items, spark.createDataFrame([], "key string, ref string")).count() == 0
    assert all(r.codes in CODES for r in RULES if r.codes)


def test_fields_are_taken_apart_once(spark):
    """No filter repeats what the projections work out, and what items ask is resolved once for all that ask the same."""
    for query in (mapped_documents, mapping_faults):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        nodes = re.split(r"\n(?=[ :]*[+:]- )", plan)
        assert not [n[:200] for n in nodes if n.lstrip(" :+-").startswith("Filter") and "try_variant_get" in n]
        assert any("Aggregate [_key" in n and "_asks" in n for n in nodes)


def test_no_space_is_cut_within_a_text(spark):
    rows = spark.createDataFrame([(" a\u3000",), ("a \u0085",), ("\ufeff\v",)], "t string")
    assert [r[0] for r in rows.select(cut(F.col("t"))).collect()] == ["a", "a \u0085", None]
