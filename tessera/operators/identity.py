"""Identity of media in tiers: by URL, then by recorded digest, and only what is left by the bytes themselves.

Digests of bytes are asked of a table of originals, ``url`` or ``file_id`` beside ``content``. Where it is partitioned by
``shard`` (see ``shard_of``), only the shards in which a file is asked for are read: their numbers, at most ``SHARDS``,
go to the driver and become a partition filter. Contents are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions of a table of originals.
SHARDS = 1024
#: Digest in a target's URL, form of a SHA-1, digest in an image reference, and the most bytes that are compared.
TARGET_HASH = "(?i)/production/([a-f0-9]{40})-"
SHA1 = "^[a-fA-F0-9]{40}$"
REF_HASH = "^image-([a-f0-9]+)-"
MOST_BYTES = 20 * 1024 * 1024


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """The partition of an original, by the hash of its URL or id as text."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int")


def digests_of(originals: DataFrame, wanted: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``key, sha1, sha256, bytes`` of the originals that ``wanted`` names; one row a key, the smallest digest of several.

    ``wanted`` is small against the originals, or is what the tiers before have left. Null keys are never found.
    """
    names = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    if "shard" in originals.columns:
        asked = sorted(r.shard for r in names.select(shard_of(F.col(key), shards).alias("shard")).distinct().collect())
        originals = originals.filter(F.col("shard").isin(asked))
    content = F.col("content").cast("binary")
    hashed = originals.filter(F.col(key).isNotNull() & F.col("content").isNotNull()).select(
        key, F.struct(F.sha2(content, 256).alias("sha256"), F.sha1(content).alias("sha1"), F.octet_length(content).cast("long").alias("bytes")).alias("_digest")
    )
    return hashed.join(names, key, "left_semi").groupBy(key).agg(F.min("_digest").alias("_d")).select(key, "_d.sha1", "_d.sha256", "_d.bytes")


def looked_up(rows: DataFrame, key: Column, found: DataFrame, found_key: str) -> DataFrame:
    """A left join in which rows without a key are dealt by a hash of theirs, not all to the task of null; drops ``found_key``."""
    deal = F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string")))
    right = found.withColumn("_found", F.col(found_key).cast("string")).drop(found_key)
    return rows.withColumn("_deal", deal).join(right, (F.col("_deal") == F.col("_found")) & key.isNotNull(), "left").drop("_deal", "_found")


def merged_receipts(*sources: DataFrame) -> DataFrame:
    """``file_id, url, sha1, bytes`` that hold after all sources, of ``file_id, url, sha1, bytes, trusted, pos``; later sources win.

    Within a source the row of the largest ``pos`` (ties: the largest row) stands for its id, trusted or not, and it
    counts if it is trusted and has a URL. One pass: a column of last rows for each source. Null ids are left out.
    """
    columns = ["url", "sha1", "bytes", "trusted"]
    tagged = [s.select("file_id", F.lit(i).alias("_from"), F.struct("pos", *columns).alias("_row")) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    last = [F.max(F.when(F.col("_from") == i, F.col("_row"))).alias(f"_{i}") for i in range(len(sources))]
    kept = [F.when(F.col(f"_{i}.trusted") & (F.coalesce(F.col(f"_{i}.url"), F.lit("")) != ""), F.col(f"_{i}")) for i in reversed(range(len(sources)))]
    found = rows.filter("file_id is not null").groupBy("file_id").agg(*last).select("file_id", F.coalesce(*kept).alias("_r"))
    return found.filter("_r is not null").select("file_id", "_r.url", "_r.sha1", "_r.bytes")


def media_evidence(slots: DataFrame, receipts: DataFrame, originals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each file of ``slots(file_id, url)``: ``file_id, url, occurrences, sha1, bytes, status``.

    ``status`` is ``reused`` where the receipt is of the file's URL and well-formed and the original that was kept has its
    digest and size (``sha1``, ``bytes``), ``no-receipt``, ``not-kept`` or ``differs`` where it has to be fetched (both
    null), and ``several-urls`` where slots disagree, which is an error in the slots. Only files with a usable receipt
    reach the originals. Slots without an id are left out; a file without a URL has no receipt.
    """
    files = slots.filter("file_id is not null").groupBy("file_id").agg(
        F.min("url").alias("url"), F.count("*").alias("occurrences"), F.coalesce(F.min("url") != F.max("url"), F.lit(False)).alias("_torn")
    )
    known = receipts.filter(F.col("sha1").rlike(SHA1) & (F.col("bytes") > 0)).select("file_id", "url", F.lower("sha1").alias("_sha1"), F.col("bytes").cast("long").alias("_bytes"))
    usable = files.filter("not _torn").join(known, ["file_id", "url"], "left_semi").select("file_id")
    found = digests_of(originals, usable, "file_id", shards).select("file_id", "sha1", "bytes")
    rows = files.join(known, ["file_id", "url"], "left").join(found, "file_id", "left")
    status = (
        F.when(F.col("_torn"), "several-urls").when(F.col("_sha1").isNull(), "no-receipt").when(F.col("sha1").isNull(), "not-kept")
        .when((F.col("sha1") == F.col("_sha1")) & (F.col("bytes") == F.col("_bytes")), "reused").otherwise("differs")
    )
    told = rows.withColumn("status", status)
    held = F.col("status") == "reused"
    return told.select("file_id", "url", "occurrences", F.when(held, F.col("sha1")).alias("sha1"), F.when(held, F.col("bytes")).alias("bytes"), "status")


def image_identity(pairs: DataFrame, recorded: DataFrame, originals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each distinct pair of ``pairs(source_url, target_url)``: both, ``n`` (how often), ``status, evidence``.

    ``recorded(url, target_sha1, matches, pos)`` has digests by source URL, of which the largest ``pos`` holds (ties: the
    largest row). ``status`` is ``same-url`` (two nulls among them), ``same-original-content`` by ``evidence`` ``recorded``
    (the record is good and its digest stands in the target's URL) or ``bytes``, else ``content-identity-unverified``: no
    original, an empty one, one of over ``MOST_BYTES``, or different bytes. Only pairs that URLs and records leave open
    reach the originals.
    """
    counted = pairs.groupBy("source_url", "target_url").agg(F.count("*").alias("n"))
    records = recorded.filter("url is not null").groupBy("url").agg(F.max(F.struct("pos", "target_sha1", "matches")).alias("_r"))
    hash_in_url = F.nullif(F.lower(F.regexp_extract("target_url", TARGET_HASH, 1)), F.lit(""))
    good = F.coalesce(F.col("_r.matches") & (F.lower("_r.target_sha1") == hash_in_url), F.lit(False))
    same = F.col("source_url").eqNullSafe(F.col("target_url"))
    tiers = looked_up(counted, F.col("source_url"), records, "url").withColumn("_tier", F.when(same, 1).when(good, 2).otherwise(3)).drop("_r")
    urls = tiers.filter("_tier = 3").select(F.explode(F.array("source_url", "target_url")).alias("url"))
    digest = digests_of(originals, urls, "url", shards).filter(F.col("bytes").between(1, MOST_BYTES)).select("url", F.struct("sha256", "bytes").alias("_d"))
    # Pairs that are settled ask for nothing.
    asked = lambda name: F.when(F.col("_tier") == 3, F.col(name))
    rows = looked_up(tiers, asked("source_url"), digest.withColumnRenamed("_d", "_source"), "url")
    rows = looked_up(rows, asked("target_url"), digest.withColumnRenamed("_d", "_target"), "url")
    equal = F.coalesce(F.col("_source") == F.col("_target"), F.lit(False))
    tier = F.col("_tier")
    status = F.when(tier == 1, "same-url").when((tier == 2) | equal, "same-original-content").otherwise("content-identity-unverified")
    evidence = F.when(tier == 1, "url").when(tier == 2, "recorded").when(equal, "bytes")
    return rows.select("source_url", "target_url", "n", status.alias("status"), evidence.alias("evidence"))


def embedded_hashes(refs: DataFrame, mapping: DataFrame, originals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each distinct ``ref`` of ``refs``: ``ref, file_id, status``, whether its hash is that of the bytes kept.

    ``mapping(file_id, ref)`` names the file; of several the smallest id holds. ``status``: ``missing-map``,
    ``missing-original-file``, ``matches``, ``differs`` (a reference without a hash differs). Null references are left out.
    """
    named = mapping.groupBy("ref").agg(F.min("file_id").alias("file_id"))
    rows = refs.select("ref").filter("ref is not null").distinct().join(named, "ref", "left")
    found = digests_of(originals, rows, "file_id", shards).select("file_id", "sha1")
    status = (
        F.when(F.col("file_id").isNull(), "missing-map").when(F.col("sha1").isNull(), "missing-original-file")
        .when(F.col("sha1") == F.regexp_extract("ref", REF_HASH, 1), "matches").otherwise("differs")
    )
    found = found.withColumnRenamed("file_id", "_id")
    return looked_up(rows, F.col("file_id"), found, "_id").select("ref", "file_id", status.alias("status"))
