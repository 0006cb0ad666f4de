"""Contracts of published data on fixtures of their own."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import web
from tessera.operators.publish import ancestors, live_slugs, offer_violations, reconciled_batches, route_verdicts, search_field_deltas, snapshot_violations, upload_states


def values(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


VIDEO = "abcDEF_-123"
CASES = {
    web.video_embed: {
        f"https://youtu.be/{VIDEO}": f"https://www.youtube.com/embed/{VIDEO}", f"https://www.youtube.com/watch?a=1&v={VIDEO}&t=75#x": f"https://www.youtube.com/embed/{VIDEO}?start=75",
        f"https://youtu.be/{VIDEO}?t=1h1s": f"https://www.youtube.com/embed/{VIDEO}?start=3601", f"https://youtu.be/{VIDEO}?t=soon": f"https://www.youtube.com/embed/{VIDEO}",
        f"https://youtube.com/embed/{VIDEO}?x=1": f"https://youtube.com/embed/{VIDEO}?x=1", f"https://M.YouTube.com/live/{VIDEO}": f"https://www.youtube.com/embed/{VIDEO}",
        "https://youtu.be/short": None, "https://youtube.com/": None, "https://vimeo.com/1": "https://vimeo.com/1", " <iframe src='https://vimeo.com/2 '> ": "https://vimeo.com/2",
        "javascript:alert(1)": None, "": None, "plain": None, '<iframe src="">': None, None: None,
    },
    web.file_name: {
        "https://x.pt/a/b%20c.jpg?d#e": "b c.jpg", "https://x.pt/a/b+c.jpg": "b+c.jpg", "https://x.pt/a%zz": "a%zz", "https://x.pt/": "original-image", "https://x.pt": "original-image", "https://x.pt/a/": "a", None: None,
    },
    lambda t: F.to_json(web.image_ref(t)): {
        "image-a1B-10x20-jpg": '{"hash":"a1B","width":10,"height":20,"ext":"jpg"}', "image-a1-0x20-jpg": None, "image-a1-1x2-svg": None, "image-a_1-1x2-png": None, "": None, None: None,
    },
    lambda t: F.concat_ws(" ", web.shared_link(t)["slug"], web.shared_link(t)["token"]): {
        "https://x.pt/vouvender/casa/?t=k1": "casa k1", "https://x.pt/casa?a=1&t=k2#x": "casa k2", "https://x.pt/casa?t=": "", "https://x.pt/?t=k": "", "https://x.pt/casa?at=k": "", None: "",
    },
    lambda t: web.site_url(t, F.lit("https://www.x.pt/a/b?q=1"), ("x.pt",)): {
        "/c?d#e": "/c?d#e", "c": "/a/c", "?z": "/a/b?z", "#f": "/a/b?q=1#f", "": "/a/b?q=1", "https://X.pt": "/", "//y.pt/z": "https://y.pt/z", "https://y.pt": "https://y.pt/", "mailto:a@b": "mailto:a@b", "tel:1": "tel:1",
    },
    lambda t: web.robots_policy(t, ["/", "/blog"], production=True): {
        "/": "index, follow", "/post/a-b": "index, follow", "/post/a-": "noindex, nofollow", "/post/a/b": "noindex, nofollow", "/lp/x": "noindex, nofollow", None: "noindex, nofollow",
    },
    lambda t: F.concat_ws(" ", ancestors(t)): {"/a/b/c": "/a /a/b /a/b/c", "/a": "/a", "/": "/"},
}


@pytest.mark.parametrize("fn", CASES, ids=range(len(CASES)))
def test_columns(spark, fn):
    assert dict(zip(CASES[fn], values(spark, fn, CASES[fn]), strict=True)) == CASES[fn]


def test_name_uuid(spark):
    names = ["", "a", "é", "x" * 1000]
    assert values(spark, lambda t: web.name_uuid(uuid.NAMESPACE_URL.hex, t), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_previews(spark):
    word, long = "palavra ", "x" * 100
    texts = {
        "": "", None: None, "one": "one", "one\ntwo": "one\ntwo", "one\r\ntwo\rthree": "one\ntwo…", " one \n\n": "one\n…", long: "x" * 78 + "\n" + "x" * 22, "x" * 200: "x" * 78 + "\n" + "x" * 77 + "…",
        word * 12: (word * 9).strip() + "\n" + (word * 3).strip(), word * 40: (word * 9).strip() + "\n" + (word * 9).strip() + "…", "a " + long: "a\n" + "x" * 77 + "…", "é" * 78: "é" * 78,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.preview for r in web.with_preview(rows, "t").orderBy("i").collect()] == list(texts.values())


def test_snapshots(spark):
    schema = "page long, pos long, id string, type string, slug string, source_slug string"
    good = [(0, 0, "a", "offer", None, None), (0, 1, "b", "article", "x", "x"), (1, 0, "c", "property", "x", None)]
    assert snapshot_violations(spark.createDataFrame(good, schema), 2).collect() == []
    bad = [(0, 0, "b", "article", "X", None), (1, 0, "b", "article", "y", "z"), (1, 1, "versions.1", None, None, None), (2, 0, None, "article", "y", None), (2, 1, "z", "article", None, None)]
    got = {(r.page, r.pos, r.violation) for r in snapshot_violations(spark.createDataFrame(bad, schema), 2).collect()}
    assert got == {
        (0, None, "page-size"), (0, 0, "invalid-slug"), (1, 0, "unordered"), (1, 0, "changed-slug"), (1, 0, "duplicate-slug"), (1, 1, "unpublished"), (1, 1, "unknown-type"),
        (2, 0, "missing-id"), (2, 0, "duplicate-slug"), (2, 1, "invalid-slug"),
    }
    assert snapshot_violations(spark.createDataFrame([], schema), 2).count() == 0


def test_offers(spark):
    schema = "slug string, source_slug string, title string, heading string, confirmation string, start_date string, end_date string, image string, og_image string"
    image = "image-a-1x1-png"
    rows = [("a-b", "a-b", "t", "h", "c", "2024-02-29", "2024-02-29", image, image), ("obrigado", None, "t\nu", "h" * 2001, None, "2023-02-29", "2024-01-01", "x", None), (None, "a", " ", "h", "c", "2024-01-02", "2024-01-01", image, image)]
    got = [r.violations for r in offer_violations(spark.createDataFrame(rows, schema), ("r",)).collect()]
    assert got == [[], ["slug", "heading", "confirmation", "title-lines", "dates", "image", "og-image"], ["slug", "changed-slug", "title", "dates"]]


def test_routes(spark):
    inventory = spark.createDataFrame([("/", False, None), ("/old", True, None), ("/gone", False, None), ("/post/", False, "p"), ("/x?y", False, None), ("/z", None, None), ("rel", False, None)], "path string, draft boolean, collection string")
    items = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("p", "d/e"), ("q", "a")], "collection string, slug string")
    routes = lambda *r: spark.createDataFrame([(x,) for x in r], "route string")
    got = route_verdicts(inventory, items, routes("/", "/old", "/gone", "/post/a", "/post/z", "/post/c", "/post/a/deep", "/poster", "/post"), routes("/new"), routes("/gone", "/post/c"))
    assert sorted((r.route, r.verdict) for r in got.collect()) == [
        ("/gone", "excluded-built"), ("/new", "missing"), ("/old", "draft-built"), ("/post", "unlisted"), ("/post/a/deep", "unlisted"), ("/post/b", "missing"), ("/post/c", "excluded-built"), ("/post/c", "unlisted"),
        ("/post/z", "unlisted"), ("/x?y", "invalid-page"), ("/z", "invalid-page"), ("rel", "invalid-page"),
    ]


def test_search_fields(spark):
    of = lambda **f: spark.createDataFrame([("/", k, v) for k, v in f.items()], "route string, field string, value string")
    delta = lambda s, t: [(r.field, r.source, r.target) for r in search_field_deltas(of(**s), of(**t)).collect()]
    assert delta({"title": "a", "robots": "nofollow"}, {"title": "a", "robots": "noindex, nofollow"}) == []
    assert delta({"robots": "noindex"}, {"robots": "nofollow"}) == [("robots", None, "nofollow")]
    assert delta({"robots": "nofollow, max-snippet:5"}, {"robots": "NoIndex"}) == [("robots", "max-snippet:5", None)]
    assert sorted(delta({"title": "a", "x": "1"}, {"title": "b", "y": "2"})) == [("title", "a", "b"), ("x", "1", None), ("y", None, "2")]


def test_batches(spark):
    schema = "batch long, id string, type string, legacy_id string, locale string, slug string, content string, bytes int"
    expected = [(b, f"{b}{i}", "t", f"{b}{i}", None, "s", "c", 10) for b in range(7) for i in "ab"]
    observed = [("0a", "t", "0a", None, "s", "c"), ("0b", "t", "0b", None, "s", "c"), ("1a", "t", "1a", None, "s", "c"), ("2a", "t", "2a", None, "s", "c"), ("other", "t", "2a", None, "s", "c"),
                ("3a", "t", "3a", None, "other", "x"), ("4a", "t", "4a", None, "s", "x"), ("5a", "t", "else", None, "s", "c"), ("5b", "t", "5b", None, "s", "x")]
    o = spark.createDataFrame(observed, "id string, type string, legacy_id string, locale string, slug string, content string")
    got = {r.batch: (r.status, r.reason, r.complete, r.missing) for r in reconciled_batches(spark.createDataFrame(expected, schema), o, 20, 5).collect()}
    assert got == {0: ("complete", None, 2, 0), 1: ("retry-missing-only", None, 1, 1), 2: ("blocked", "duplicate", 0, 0), 3: ("blocked", "identity-mismatch", 0, 0), 4: ("blocked", "content-mismatch", 0, 0),
                   5: ("blocked", "foreign-id", 0, 0), 6: ("blocked", "retry-too-large", 0, 2)}


def test_live_slugs(spark):
    schema = "id int, locale string, slug string"
    staged = spark.createDataFrame([(1, "pt", "a"), (2, "pt", "b"), (3, "pt", "c"), (4, "pt", "d")], schema)
    live = spark.createDataFrame([(1, "pt", "a1"), (1, "en", "a2"), (2, "en", "b2"), (3, "en", "c2"), (3, "fr", "c3")], schema)
    assert {r.id: r.live_slug for r in live_slugs(staged, live).collect()} == {1: "a1", 2: "b2", 3: "c", 4: "d"}


def test_uploads(spark):
    events = [("submit", "running", "o"), ("claim", None, None), ("claim", None, None), ("submit", "failed", "o"), ("retry", None, None), ("status", "completed", "o"), ("claim", None, None), ("resume", None, None), ("status", "completed", "o"),
              ("retry", None, None), ("status", "odd", "o")]
    rows = spark.createDataFrame([(f, i, *e) for f in (1, 2) for i, e in enumerate(events)], "file_id long, seq long, kind string, status string, operation string")
    got = sorted((r.file_id, r.seq, r.status, r.attempt, r.outcome) for r in upload_states(rows).collect())
    want = ["planned", "submitting", "submitting", "failed", "retry-authorized", "retry-authorized", "submitting", "unknown", "awaiting-metadata", "awaiting-metadata", "awaiting-metadata"]
    told = ["refused", "applied", "refused", "applied", "applied", "refused", "applied", "applied", "applied", "refused", "refused"]
    assert got == [(f, i, s, int(i > 3), t) for f in (1, 2) for i, (s, t) in enumerate(zip(want, told, strict=True))]
