"""Source items to documents: strict codes, galleries resolved through asset maps, and reasons for those that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document id is at most this long and of these characters.
ID_LENGTH, ID_FORM = 128, r"^[A-Za-z0-9._-]+$"


def decoded(code: Column, codes: dict[str, str]) -> Column:
    """The label of a code, null for one that is not in the table (the caller counts that as a fault)."""
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[code]


def stable_id(*parts: Column) -> Column:
    """The parts joined by hyphens; null where one is missing or the whole isn't an id."""
    whole = F.concat(*[p for part in parts for p in (F.lit("-"), part.cast("string"))][1:])
    return F.when((F.length(whole) <= ID_LENGTH) & whole.rlike(ID_FORM), whole)


def galleries(slots: DataFrame, by_file: DataFrame, by_url: DataFrame) -> DataFrame:
    """``item_id, refs, n_slots, unmatched``: an item's references in the order of its slots, repeats kept.

    ``slots(item_id, pos, file_id, url)``; the maps ``(file_id, ref)`` and ``(url, ref)`` hold a row a key. A slot
    takes its file's reference, else its URL's; a slot with neither is counted and left out of ``refs``.
    """
    f = by_file.select(F.col("file_id").alias("_f"), F.col("ref").alias("_fr"))
    u = by_url.select(F.col("url").alias("_u"), F.col("ref").alias("_ur"))
    joined = slots.join(f, F.col("file_id") == F.col("_f"), "left").join(u, F.col("url") == F.col("_u"), "left").withColumn("ref", F.coalesce("_fr", "_ur"))
    placed = F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("pos", "file_id", "ref"))))
    return joined.groupBy("item_id").agg(F.transform(placed, lambda x: x["ref"]).alias("refs"), F.count("*").alias("n_slots"), F.count_if(F.col("ref").isNull()).alias("unmatched"))


def first_fault(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition holds, null if none does."""
    fault = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        fault = F.when(condition, name).otherwise(fault)
    return fault


def audit_receipts(originals: DataFrame, receipts: DataFrame) -> DataFrame:
    """``file_id, verdict`` of each original against its recorded receipt; both have ``file_id, sha1, bytes``."""
    r = receipts.select(F.col("file_id").alias("_k"), F.lower("sha1").alias("_sha1"), F.col("bytes").alias("_bytes"))
    joined = originals.join(r, F.col("file_id") == F.col("_k"), "left")
    fault = first_fault(("no-receipt", F.col("_k").isNull()), ("digest-mismatch", ~F.col("_sha1").eqNullSafe(F.lower("sha1"))), ("size-mismatch", ~F.col("_bytes").eqNullSafe(F.col("bytes"))))
    return joined.select("file_id", F.coalesce(fault, F.lit("verified")).alias("verdict"))


def contract_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """``form, issue, renamed``: forms of both sides by normalised key, fields compared in order.

    Both have ``form, pos, name, type, required, label``. What a visitor sees (type, required, label) must be the
    same; names that differ are only told, with how many there are.
    """

    def forms(rows: DataFrame, suffix: str) -> DataFrame:
        key = F.lower(F.regexp_replace(F.regexp_replace("form", "^form-", ""), "[^A-Za-z0-9]+", "-"))
        fields = F.array_sort(F.collect_list(F.struct("pos", "label", "type", "required", "name")))
        return rows.groupBy(key.alias(f"_k{suffix}")).agg(fields.alias(f"_f{suffix}"))

    shape = lambda c: F.transform(c, lambda x: F.struct(x["type"], x["required"], x["label"]))
    names = lambda c: F.transform(c, lambda x: x["name"])
    joined = forms(source, "s").join(forms(target, "t"), F.col("_ks") == F.col("_kt"), "full")
    renamed = F.size(F.filter(F.zip_with(names("_fs"), names("_ft"), lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    issue = first_fault(
        ("missing-target-form", F.col("_kt").isNull()), ("unexpected-target-form", F.col("_ks").isNull()),
        ("form-contract-diff", ~shape("_fs").eqNullSafe(shape("_ft"))), ("field-name-mapping", renamed > 0),
    )
    both = F.col("_ks").isNotNull() & F.col("_kt").isNotNull()
    return joined.select(F.coalesce("_ks", "_kt").alias("form"), issue.alias("issue"), F.when(both, renamed).otherwise(0).alias("renamed")).filter("issue is not null")
