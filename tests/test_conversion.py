"""Rich text, galleries, receipts and form contracts on small invented tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.convert import audit_receipts, contract_diff, galleries, stable_id
from tessera.operators.richtext import Unsupported, rich_text, to_blocks, to_html


def runs(html):
    return [(b["tag"], b["list_kind"], [(r["text"], tuple(r["marks"]), r["href"], r["blank"]) for r in b["runs"]]) for b in to_blocks(html)]


def test_blocks_keep_marks_breaks_and_spaces():
    assert runs("<p> a\n b <strong>c<br>d</strong></p>") == [("p", None, [("a b ", (), None, False), ("c\nd", ("strong",), None, False)])]
    assert runs("<p>x </p><h3>T</h3>") == [("p", None, [("x ", (), None, False)]), ("h3", None, [("T", (), None, False)])]
    assert runs('<ul><li>1</li></ul><ol><li><a href="/x" target="_blank">2</a></li></ol>') == [("li", "ul", [("1", (), None, False)]), ("li", "ol", [("2", (), "/x", True)])]
    assert runs("<p>a<p>b") == [("p", None, [("a", (), None, False)]), ("p", None, [("b", (), None, False)])]


@pytest.mark.parametrize("html", [
    '<p>x</p><img src="a">', '<a href="/a" target="frame">x</a>', "<ul><li>a<ul><li>b</li></ul></li></ul>", "<table></table>", "<li>a</li>",
    '<ol start="3"><li>a</li></ol>', "<ol reversed><li>a</li></ol>", '<ul><li value="2">a</li></ul>', '<a href="javascript:x">a</a>', "<a>a</a>",
])
def test_what_blocks_cannot_carry_is_refused(html):
    with pytest.raises(Unsupported):
        to_blocks(html)


def test_html_of_blocks_says_the_same():
    for html in ("<p>a &lt; b &amp; c</p>", '<ul><li>1</li><li><em>2</em><strong><em>3</em></strong></li></ul><p><a href="/?a=1&amp;b=2">l</a><br>m</p>', "<p></p>"):
        assert to_blocks(to_html(to_blocks(html))) == to_blocks(html)


def test_rich_text_of_null_and_faulty_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a</p>"), (4, "<div>a</div>")], "k long, html string")
    got = {r["k"]: (r["error"], r["rendered"]) for r in rich_text(rows, "k", "html").collect()}
    assert got == {1: ("empty", None), 2: ("empty", None), 3: (None, "<p>a</p>"), 4: ("unsupported <div>", None)}


def test_galleries_keep_order_and_repeats(spark):
    slots = spark.createDataFrame([(1, 2, "a", "u"), (1, 1, "b", "v"), (1, 3, "a", "u"), (2, 1, None, "w")], "item_id long, pos int, file_id string, url string")
    by_file, by_url = spark.createDataFrame([("a", "A")], "file_id string, ref string"), spark.createDataFrame([("v", "V")], "url string, ref string")
    got = {r["item_id"]: (r["refs"], r["n_slots"], r["unmatched"]) for r in galleries(slots, by_file, by_url).collect()}
    assert got == {1: (["V", "A", "A"], 3, 0), 2: ([], 1, 1)}


def test_ids_and_receipts(spark):
    ids = spark.createDataFrame([("a", "b"), ("a", None), ("a b", "c"), ("x" * 130, "c")], "x string, y string").select(stable_id(F.col("x"), F.col("y")))
    assert [r[0] for r in ids.collect()] == ["a-b", None, None, None]
    have = spark.createDataFrame([("a", "aa", 1), ("b", "bb", 2), ("c", "cc", 3), ("d", "dd", 4)], "file_id string, sha1 string, bytes long")
    told = spark.createDataFrame([("a", "AA", 1), ("b", "b0", 2), ("c", "cc", 9)], "file_id string, sha1 string, bytes long")
    assert dict(audit_receipts(have, told).collect()) == {"a": "verified", "b": "digest-mismatch", "c": "size-mismatch", "d": "no-receipt"}


def test_forms_are_compared_by_what_visitors_see(spark):
    schema = "form string, pos long, name string, type string, required boolean, label string"
    source = [("form-Contact", 1, "n", "text", True, "Name"), ("form-Contact", 2, "m", "email", True, "Mail"), ("Old one", 1, "a", "text", None, None), ("b", 1, "x", "text", True, "L")]
    target = [("contact", 1, "name", "text", True, "Name"), ("contact", 2, "m", "email", True, "Mail"), ("New", 1, "a", "text", None, None), ("b", 1, "x", "tel", True, "L")]
    got = {r["form"]: (r["issue"], r["renamed"]) for r in contract_diff(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)).collect()}
    assert got == {"contact": ("field-name-mapping", 1), "old-one": ("missing-target-form", 0), "new": ("unexpected-target-form", 0), "b": ("form-contract-diff", 0)}
