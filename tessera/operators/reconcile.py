"""Joining what is expected with what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import reasons


def eligibility(staged: DataFrame, live: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, locale, reasons, eligible`` of staged items against live ones, and the columns of staged items to ``keep``.

    Both have ``id, locale, slug``; staged ones ``is_draft`` and ``is_archived`` too, where null means unknown.
    Live rows are one an id and locale. A slug is compared after the join, so that a change of it has a reason of its own.
    """
    there = live.select(F.col("id").alias("l_id"), F.col("locale").alias("l_locale"), F.col("slug").alias("l_slug"))
    joined = staged.join(there, (F.col("id") == F.col("l_id")) & F.col("locale").eqNullSafe(F.col("l_locale")), "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    found = reasons(
        ("unknown-draft", F.col("is_draft").isNull()), ("draft", F.col("is_draft")),
        ("unknown-archived", F.col("is_archived").isNull()), ("archived", F.col("is_archived")),
        ("blank-id", F.col("id").isNull()), ("blank-locale", blank("locale")), ("blank-slug", blank("slug")),
        ("not-live", F.col("l_id").isNull()), ("slug-mismatch", F.col("l_slug").isNotNull() & (F.col("l_slug") != F.col("slug"))),
    )
    return joined.select("id", "locale", found.alias("reasons"), (F.size(found) == 0).alias("eligible"), *keep)


def only_in_inventory(inventory: DataFrame, staged: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Inventory keys that neither stage has."""
    return inventory.select(key).distinct().join(staged.select(key).unionByName(live.select(key)).distinct(), key, "left_anti")


def differences(expected: DataFrame, observed: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key, verdict`` of every key that is missing, unexpected or changed; the first that holds."""
    left = expected.select(F.col(key), F.struct(*values).alias("_e"))
    right = observed.select(F.col(key).alias("_k"), F.struct(*values).alias("_o"))
    joined = left.join(right, F.col(key) == F.col("_k"), "full")
    verdict = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_o")), "changed")
    return joined.select(F.coalesce(key, "_k").alias(key), verdict.alias("verdict")).filter("verdict is not null")


def classify_matches(assets: DataFrame, metadata: DataFrame) -> DataFrame:
    """``file_id, verdict``: metadata with an asset's digest and size, of which there is one, several or none.

    ``assets(file_id, digest, bytes)``; ``metadata(meta_id, digest, bytes)``.
    """
    m = metadata.select("meta_id", F.col("digest").alias("m_digest"), F.col("bytes").alias("m_bytes"))
    joined = assets.join(m, F.lower("digest") == F.lower("m_digest"), "left")
    counted = joined.groupBy("file_id").agg(F.count_distinct(F.when(F.col("bytes") == F.col("m_bytes"), F.col("meta_id"))).alias("same"), F.count("meta_id").alias("some"))
    verdict = F.when(F.col("same") == 1, "matched").when(F.col("same") > 1, "ambiguous").when(F.col("some") > 0, "size-mismatch").otherwise("missing")
    return counted.select("file_id", verdict.alias("verdict"))


def merge_history(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, conflict``: the union of both, the new value first; true where a key has changed its value."""
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = new.select(key, value).join(o, F.col(key) == F.col("_k"), "full")
    conflict = F.col(value).isNotNull() & F.col("_v").isNotNull() & (F.col(value) != F.col("_v"))
    return joined.select(F.coalesce(key, "_k").alias(key), F.coalesce(value, "_v").alias(value), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``n`` and two sums over the SHA-256 of the rows as JSON arrays, equal for equal multisets of rows in any order."""
    row = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).cast("binary"), 256)
    part: list[Column] = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(name) for at, name in ((1, "digest_a"), (13, "digest_b"))]
    return rows.agg(F.count("*").alias("n"), *part)


def gate(entries: DataFrame, passed: str, precedence: str, reason: str) -> DataFrame:
    """One row: whether every entry passed, and the first failing reason."""
    failing = F.when(~F.col(passed), F.col(precedence))
    return entries.agg(F.coalesce(F.bool_and(passed), F.lit(False)).alias("passed"), F.count_if(~F.col(passed)).alias("n_failed"), F.min_by(F.when(~F.col(passed), F.col(reason)), failing).alias("reason"))


def three_way(target: DataFrame, expected: DataFrame, approved: DataFrame) -> DataFrame:
    """``key, verdict`` of every key of three relations ``(key, digest)``: what a target holds, what the source expects, what was approved.

    One grouped pass over all rows, each tagged by its relation, in place of two full joins. A key that a relation has twice is that
    relation's duplicate (target first); then come ``unexpected`` (not in the source), ``not-approved``, ``missing`` (approved, not in the
    target), ``approved-differs`` (approved is not what the source expects), ``target-differs`` (the target is not what was approved)
    and ``equal``. Null keys are one key; a null digest equals a null one only.
    """
    sides = {"target": target, "expected": expected, "approved": approved}
    rows = [df.select("key", "digest", F.lit(side).alias("side")) for side, df in sides.items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    at = lambda side: F.col("side") == side
    keys = both.groupBy("key").agg(*[F.count_if(at(s)).alias(f"n_{s}") for s in sides], *[F.max(F.when(at(s), F.col("digest"))).alias(f"d_{s}") for s in sides])
    verdict = F.when(F.lit(False), "")
    for s in sides:
        verdict = verdict.when(F.col(f"n_{s}") > 1, f"duplicate-{s}")
    verdict = verdict.when(F.col("n_expected") == 0, "unexpected").when(F.col("n_approved") == 0, "not-approved").when(F.col("n_target") == 0, "missing")
    verdict = verdict.when(~F.col("d_approved").eqNullSafe(F.col("d_expected")), "approved-differs").when(~F.col("d_target").eqNullSafe(F.col("d_approved")), "target-differs")
    return keys.select("key", verdict.otherwise("equal").alias("verdict"))
