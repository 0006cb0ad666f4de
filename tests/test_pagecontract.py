"""Page contracts from HTML as people write it."""

import duckdb
from pyspark.sql import functions as F

from tessera.operators.pagecontract import contracts, link_differences, links
from tessera.plans.registry import ORACLES, QUERIES

PAGE = """<!doctype html><TITLE>  A &amp; B </TITLE><meta name=description content='x'><meta property="og:url" content="/u"><link rel="alternate Canonical" href=/c>
<a href='/one'><b>One</b> <i>more</i></a><A HREF="/one">again</A><a href="/one" target=_blank>new</a><a href="/aria" aria-label="Aria">text</a><a href="/t" title="T"></a>
<div class="x w-hidden"><p><a href="/hidden">h</a></div><div aria-hidden="true"><a href="/popup">p</a></div><div class="navbar2_component imoveis"><a href="/nav">n</a></div>
<div class="navbar2_component"><a href="/shown">s</a></div><p hidden>gone<div><a href="/after">after the hidden paragraph</a></div>
<a href="javascript:void(0)">js</a><a href="#top">top</a><!-- <a href="/comment">c</a> --><script>var x = '<a href="/script">s</a>';</script>
<form name="wf-form-Form-Contact Us" method=post action="/send"><label for=m>Mail <em>address</em></label><input id=m type=EMAIL name=mail required>
<label>Name <input name=name></label><input type=hidden name=h><input type=submit><textarea placeholder="Text"></textarea>
<select name=s><option value=1>One<option>Two</select><input type=checkbox name=ok aria-label="I agree" required></form><a href="/open">never closed"""


def test_one_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tags"), (5, "</p></a><a href='/x'")], "page_id long, html string").withColumn("kind", F.lit("clash"))
    rows = [r.asDict() for r in contracts(df).collect()]
    of = lambda kind: [r for r in sorted(rows, key=lambda r: r["pos"]) if r["kind"] == kind and r["page_id"] == 1]
    assert [(r["name"], r["value"]) for r in of("meta")] == [("title", "A & B"), ("name:description", "x"), ("property:og:url", "/u"), ("canonical", "/c")]
    assert [(r["form"], r["name"], r["value"]) for r in of("form")] == [("contact-us", "POST", "/send")]
    assert [(r["name"], r["value"], r["required"], r["label"], r["options"]) for r in of("field")] == [
        ("mail", "email", True, "Mail address", None), ("name", "text", False, "Name", None), (None, "textarea", False, "Text", None), ("s", "select", False, None, ["1=One", "Two=Two"]), ("ok", "checkbox", True, "I agree", None),
    ]
    assert {r["name"]: r["value"] for r in of("tag")}["a"] == "13"
    assert {r["page_id"] for r in rows} == {1}
    seen = {(r.href, r.target): r.label for r in links(contracts(df)).collect()}
    assert seen == {("/one", None): "One more", ("/one", "_blank"): "new", ("/aria", None): "Aria", ("/t", None): "T", ("/shown", None): "s", ("/after", None): "after the hidden paragraph", ("/open", None): "never closed"}
    assert ("/popup", None) in {(r.href, r.target) for r in links(contracts(df), always=["/popup"]).collect()}
    assert contracts(df.limit(0)).count() == 0


def test_links_differ_by_target(spark):
    schema = "page_id long, href string, target string"
    a = spark.createDataFrame([(1, "/a", None), (1, "/b", "_blank"), (2, "/c", None), (2, "/c", None)], schema)
    b = spark.createDataFrame([(1, "/a", None), (1, "/b", None), (3, "/c", None)], schema)
    got = {tuple(r) for r in link_differences(a, b).collect()}
    assert got == {(1, "/b", "_blank", "source-only"), (1, "/b", None, "target-only"), (2, "/c", None, "source-only"), (3, "/c", None, "target-only")}


def test_titles_have_their_character_references_read_by_query_and_sql(spark, tmp_path):
    titles = {
        "a&quot;b &amp;lt; &lt;": 'a"b &lt; <', "x&amp": "x&", "&ampersand &notit; &notin; &unknown; &": "&ersand ¬it; ∉ &unknown; &", "&#65;&#x41;&#X0042&#0;&#128;&#xD800;&#1114112;&#99999999999;": "AAB\ufffd€\ufffd\ufffd\ufffd",
        "&#1;a&#xFFFE;b&apos;": "ab'", "&nbsp; a&nbsp;\n b\u200b&ZeroWidthSpace; ": "a b", "": None, "&nbsp;": None, "&NotEqualTilde;": "≂̸",
    }
    rows = [(i, f"<html><title>{t}</title><a href='/x'>x</a>") for i, t in enumerate(titles)]
    want = {i: (t, 1, 0) for i, t in enumerate(titles.values())}
    rows, want = [*rows, (90, "<p>no title</p>"), (91, None), (92, "")], want | dict.fromkeys((90, 91, 92), (None, 0, 0))
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["page_summaries"](spark, str(tmp_path)).select("page_id", "title", "n_links", "n_forms").collect()}
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(f"SELECT page_id, title, n_links, n_forms FROM ({ORACLES['page_summaries']})").fetchall()} == want
