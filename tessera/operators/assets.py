"""Assets and samples of a migration: where they come from, which are the same, which are accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import url_host


def allowed_source(url: Column, hosts: tuple[str, ...]) -> Column:
    """True for an https URL of one of the hosts or a host below it; null and anything else: false."""
    host = url_host(url)
    known = F.lit(False)
    for h in hosts:
        known |= (host == h) | F.endswith(host, F.lit(f".{h}"))
    return F.coalesce(F.startswith(url, F.lit("https://")) & known, F.lit(False))


def same_files(assets: DataFrame) -> DataFrame:
    """``file_id, first_id, n`` of ``assets(file_id, digest, bytes)``: the smallest id of the files of equal bytes, and how many they are.

    Digests are compared without case. Files without a digest or a size stand alone.
    """
    keyed = assets.select("file_id", F.lower("digest").alias("_digest"), F.col("bytes").alias("_bytes"))
    groups = keyed.filter("_digest is not null and _bytes is not null").groupBy("_digest", "_bytes").agg(F.min("file_id").alias("first_id"), F.count("*").alias("n"))
    joined = keyed.join(groups, ["_digest", "_bytes"], "left")
    return joined.select("file_id", F.coalesce("first_id", "file_id").alias("first_id"), F.coalesce("n", F.lit(1)).alias("n"))


def metadata_conflicts(metadata: DataFrame) -> DataFrame:
    """``ref, versions`` of references that ``metadata(ref, digest, bytes)`` gives more than one digest or size."""
    return metadata.groupBy("ref").agg(F.count_distinct(F.struct(F.lower("digest"), "bytes")).alias("versions")).filter("versions > 1")


def sample_parity(samples: DataFrame, payload: DataFrame, planned: DataFrame) -> DataFrame:
    """``type, id, verdict`` of samples that aren't in the payload, that no plan names, and of planned ones that weren't taken.

    All three have ``type, id``; repeated rows count once.
    """
    keys = lambda df: df.select("type", "id").distinct()
    samples, payload, planned = keys(samples), keys(payload), keys(planned)
    named = lambda df, verdict: df.withColumn("verdict", F.lit(verdict))
    absent = named(samples.join(payload, ["type", "id"], "left_anti"), "not-in-payload")
    return absent.unionByName(named(samples.join(planned, ["type", "id"], "left_anti"), "not-planned")).unionByName(named(planned.join(samples, ["type", "id"], "left_anti"), "not-taken"))
