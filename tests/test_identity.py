"""Tiers of identity: merged receipts, evidence, pairs of images, hashes in references; and what is read of the originals."""

import hashlib
import re

from pyspark.sql import functions as F

from tessera.operators.identity import digests_of, embedded_hashes, image_identity, media_evidence, merged_receipts, shard_of

RECEIPT = "file_id string, url string, sha1 string, bytes long, trusted boolean, pos long"
sha1 = lambda b: hashlib.sha1(b).hexdigest()


def test_later_sources_win_if_they_are_trusted(spark):
    validated = spark.createDataFrame([
        ("a", "u1", "x", 1, True, 0), ("a", "u2", "y", 2, True, 1), ("b", "u", "x", 1, True, 0), ("b", "u", "x", 1, False, 1),
        ("c", "", "x", 1, True, 0), ("d", "old", "x", 1, True, 0), ("e", "e", "x", 1, None, 0), (None, "n", "x", 1, True, 0),
    ], RECEIPT)
    state = spark.createDataFrame([("a", "u3", "z", 3, False, 0), ("c", "c", "w", 4, True, 0), ("d", "new", "w", 5, True, 0)], RECEIPT).withColumn("extra", F.lit(1))
    got = {r.file_id: (r.url, r.sha1, r.bytes) for r in merged_receipts(validated, state).collect()}
    # The state's row for a isn't trusted, so the validated one holds; b's last row isn't trusted.
    assert got == {"a": ("u2", "y", 2), "c": ("c", "w", 4), "d": ("new", "w", 5)}
    assert merged_receipts(validated.limit(0), state.limit(0)).count() == 0


def test_evidence(spark):
    files = {"same": b"abc", "other": b"abcd", "moved": b"m", "torn": b"t", "empty": b""}
    originals = spark.createDataFrame(list(files.items()), "file_id string, content binary")
    slots = spark.createDataFrame(
        [("same", "u"), ("same", "u"), ("other", "u"), ("moved", "new"), ("torn", "u"), ("torn", "v"), ("lost", "u"), ("bad", "u"), ("empty", "u"), ("none", None), (None, "u")], "file_id string, url string"
    )
    receipts = spark.createDataFrame(
        [("same", "u", sha1(b"abc").upper(), 3), ("other", "u", sha1(b"abc"), 3), ("moved", "old", sha1(b"m"), 1), ("torn", "u", sha1(b"t"), 1), ("lost", "u", sha1(b"l"), 1), ("bad", "u", "12", 3), ("empty", "u", sha1(b""), 0)],
        "file_id string, url string, sha1 string, bytes long",
    )
    got = {r.file_id: (r.status, r.occurrences, r.sha1, r.bytes) for r in media_evidence(slots, receipts, originals).collect()}
    assert got == {
        "same": ("reused", 2, sha1(b"abc"), 3), "other": ("differs", 1, None, None), "moved": ("no-receipt", 1, None, None), "torn": ("several-urls", 2, None, None),
        "lost": ("not-kept", 1, None, None), "bad": ("no-receipt", 1, None, None), "empty": ("no-receipt", 1, None, None), "none": ("no-receipt", 1, None, None),
    }


def test_image_pairs(spark, monkeypatch):
    kept = [("s1", b"one"), ("t1", b"one"), ("t2", b"two"), ("z1", b""), ("z2", b""), ("l1", b"12345678"), ("l2", b"12345678"), ("r", b"r"), (None, b"q"), ("nil", None)]
    originals = spark.createDataFrame(kept, "url string, content binary")
    h = "AB" * 20
    at = f"https://x/Production/{h}-1.png"
    pairs = [("s1", "s1"), ("s1", "t1"), ("s1", "t1"), ("s1", "t2"), ("z1", "z2"), ("s1", "gone"), ("r", at), ("f", at), ("old", at), (None, None), (None, "t1"), ("nil", "nil2")]
    recorded = spark.createDataFrame([("r", h.lower(), True, 0), ("f", h, False, 0), ("old", h, True, 0), ("old", "00", True, 1), (None, h, True, 0)], "url string, target_sha1 string, matches boolean, pos int")
    frame = spark.createDataFrame(pairs, "source_url string, target_url string").withColumn("n", F.lit(9))
    got = {(r.source_url, r.target_url): (r.n, r.status, r.evidence) for r in image_identity(frame, recorded, originals).collect()}
    open_ = (1, "content-identity-unverified", None)
    assert got == {
        ("s1", "s1"): (1, "same-url", "url"), (None, None): (1, "same-url", "url"), ("s1", "t1"): (2, "same-original-content", "bytes"), ("r", at): (1, "same-original-content", "recorded"),
        ("s1", "t2"): open_, ("z1", "z2"): open_, ("s1", "gone"): open_, ("f", at): open_, ("old", at): open_, (None, "t1"): open_, ("nil", "nil2"): open_,
    }
    monkeypatch.setattr("tessera.operators.identity.MOST_BYTES", 7)
    large = spark.createDataFrame([("l1", "l2")], "source_url string, target_url string")
    assert [r.status for r in image_identity(large, recorded, originals).collect()] == ["content-identity-unverified"]


def test_hashes_in_references(spark):
    originals = spark.createDataFrame([(1, b"one"), (2, b"two")], "file_id long, content binary")
    good, wrong = f"image-{sha1(b'one')}-1x1-png", f"image-{sha1(b'other')}-1x1-png"
    mapping = spark.createDataFrame([(3, good), (1, good), (2, wrong), (7, "image-ab-lost"), (2, "image-"), (None, "image-ff-null")], "file_id long, ref string")
    refs = spark.createDataFrame([(r,) for r in (good, good, wrong, "image-ab-lost", "image-", "image-cd-new", "image-ff-null", None)], "ref string")
    got = {r.ref: (r.file_id, r.status) for r in embedded_hashes(refs, mapping, originals).collect()}
    assert got == {
        good: (1, "matches"), wrong: (2, "differs"), "image-ab-lost": (7, "missing-original-file"), "image-": (2, "differs"),
        "image-cd-new": (None, "missing-map"), "image-ff-null": (None, "missing-map"),
    }


def test_only_shards_that_are_asked_for_are_read(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("file_id"), F.concat(F.lit("content "), "id").cast("binary").alias("content"))
    rows.withColumn("shard", shard_of(F.col("file_id"), 16)).repartition(1).write.partitionBy("shard").parquet(str(tmp_path / "kept"))
    originals = spark.read.parquet(str(tmp_path / "kept"))
    wanted = spark.createDataFrame([(5,), (5,), (None,), (1000,)], "file_id long")
    found = digests_of(originals, wanted, "file_id", 16)
    assert [(r.file_id, r.sha1, r.bytes) for r in found.collect()] == [(5, sha1(b"content 5"), 9)]
    assert len(found.inputFiles()) == 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    asked = wanted.filter("file_id is not null").select(shard_of(F.col("file_id"), 16).alias("s")).distinct().collect()
    told = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert {int(n) for n in re.findall(r"\b(\d+)\b", re.sub(r"#\d+", "", told))} >= {r.s for r in asked}
    # The files themselves: every other shard's can be gone.
    keep = {f"shard={r.s}" for r in asked}
    for folder in (tmp_path / "kept").glob("shard=*"):
        if folder.name not in keep:
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not parquet")
    fresh = digests_of(spark.read.schema(originals.schema).parquet(str(tmp_path / "kept")), wanted, "file_id", 16)
    assert fresh.count() == 1
    assert digests_of(originals, wanted.limit(0), "file_id", 16).count() == 0
