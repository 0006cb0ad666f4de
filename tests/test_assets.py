"""Assets, samples and service answers on fixtures of their own."""

import json

from pyspark.sql import functions as F

from tessera.operators.assets import allowed_source, metadata_conflicts, same_files, sample_parity
from tessera.sources.io import read_answers


def test_sources(spark):
    urls = {"https://x.pt/a": True, "https://a.X.pt": True, "http://x.pt": False, "https://notx.pt": False, "https://x.pt.evil.com": False, "": False, None: False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", allowed_source(F.col("u"), ("x.pt",)).alias("ok"))
    assert {r.u: r.ok for r in rows.collect()} == urls


def test_files_and_metadata(spark):
    schema = "file_id int, digest string, bytes int"
    rows = [(3, "AB", 1), (1, "ab", 1), (2, "ab", 2), (4, None, 1), (5, None, 1), (6, "ab", None)]
    assert sorted(map(tuple, same_files(spark.createDataFrame(rows, schema)).collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
    metadata = spark.createDataFrame([("r", "AB", 1), ("r", "ab", 1), ("s", "ab", 1), ("s", "ab", 2)], "ref string, digest string, bytes int")
    assert [tuple(r) for r in metadata_conflicts(metadata).collect()] == [("s", 2)]


def test_samples(spark):
    of = lambda *ids: spark.createDataFrame([("t", i) for i in ids], "type string, id int")
    assert sorted((r.id, r.verdict) for r in sample_parity(of(1, 1, 2, 3), of(1, 2), of(1, 3, 4)).collect()) == [(2, "not-planned"), (3, "not-in-payload"), (4, "not-taken")]


def test_answers(spark, tmp_path):
    answers = [[{"id": 1}, {"id": 2}], {"result": [{"id": 3}]}, {"assets": [{"id": 4}], "x": 1}, {"id": 5}, {"result": []}]
    for i, a in enumerate(answers):
        (tmp_path / f"{i}.json").write_text(json.dumps(a, indent=1))
    (tmp_path / "bad.json").write_text("{")
    rows = read_answers(spark, str(tmp_path), ("result", "documents", "assets")).select(F.try_variant_get("row", "$.id", "int").alias("id"))
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5]
