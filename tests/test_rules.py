"""Rules and operators on fixtures of their own."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import plausible_phone
from tessera.operators.ordinals import with_ordinals
from tessera.operators.reconcile import content_digest, eligibility

#: Numbers that are placeholders or malformed, and plausible ones.
REFUSED = ["000000000", "111111111", "999 999 999", "+351 000 000 000", "00351 111111111", "+44 0000000000", "123456789", "987654321", "+351 123456789", "00351 987654321", "+ 351 123456789", "00 351 123456789", "+35 1 987654321", "12345", "+1234567890123456", "abc912345678", "912+345678", "9/12345678", "", None, "+351"]
ACCEPTED = ["912345678", "212345678", "900000000", "+351 912 345 678", "00351 912 345 678", "+ 351 912 345 678", "00 351 912 345 678", "+351 900000000", "+44 20 7946 0958", "+1 (415) 555-2671", "+33 6 12 34 56 78", "020 7946 0958", "912.345.678"]


@pytest.mark.parametrize(("numbers", "want"), [(REFUSED, False), (ACCEPTED, True)])
def test_phones(spark, numbers, want):
    rows = spark.createDataFrame([(x,) for x in numbers], "p string").select("p", plausible_phone(F.col("p")).alias("ok")).collect()
    assert [r.p for r in rows if r.ok != want] == []


def test_ordinals_with_further_columns(spark):
    """At a size whose borders are sampled, with a column besides group and order: every ordinal once."""
    rows = spark.range(600_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"), F.col("id").cast("string").alias("extra"))
    got = with_ordinals(rows, "g", [F.col("o")]).groupBy("g").agg(F.count_distinct("ordinal").alias("n"), F.max("ordinal").alias("top"), F.count("*").alias("c")).collect()
    assert {(r.n, r.top, r.c) for r in got} == {(200_000, 200_000, 200_000)}


def test_eligibility_by_id_and_locale(spark):
    """An id that is eligible in one locale and a draft in another counts once."""
    staged = spark.createDataFrame([(1, "pt", "a", False, False, "x"), (1, "en", "a", True, False, "y"), (2, "pt", "b", None, False, "x"), (3, "pt", "c", False, False, "x")], "id int, locale string, slug string, is_draft boolean, is_archived boolean, status string")
    live = spark.createDataFrame([(1, "pt", "a"), (1, "en", "a"), (2, "pt", "b"), (3, "pt", "c-old")], "id int, locale string, slug string")
    got = {(r.id, r.locale): (r.eligible, r.reasons, r.status) for r in eligibility(staged, live, keep=("status",)).collect()}
    assert got == {(1, "pt"): (True, [], "x"), (1, "en"): (False, ["draft"], "y"), (2, "pt"): (False, ["unknown-draft"], "x"), (3, "pt"): (False, ["slug-mismatch"], "x")}


def test_digest_tells_rows_apart(spark):
    """Separators and nulls in values don't make different rows equal; the order of rows doesn't matter."""
    digest = lambda *rows: tuple(content_digest(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first())
    assert len({digest(r) for r in [("a|b", "c"), ("a", "b|c"), ("~", "c"), (None, "c"), ('a","b', "c"), ("null", "c")]}) == 6
    assert digest(("a", "b"), ("c", None)) == digest(("c", None), ("a", "b"))
