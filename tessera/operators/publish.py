"""Contracts of published data: snapshots, offers, routes, search fields, request batches and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions.expr import SLUG, is_published, reasons, trimmed, valid_iso_date
from tessera.functions.web import image_ref, robots_left
from tessera.operators.folds import sorted_fold

#: Types of documents, of those with a public route, and the greatest lengths of an offer's texts.
TYPES = ("property", "article", "testimonial", "offer", "preListing", "processStep")
ROUTED = ("property", "article", "preListing")
OFFER_CHARS = {"title": 200, "heading": 2000, "confirmation": 4000}
OFFER_SLUG_CHARS = 160


def snapshot_violations(rows: DataFrame, page_size: int) -> DataFrame:
    """``page, pos, id, violation`` of a landed export ``page, pos, id, type, slug, source_slug``, a row for each rule broken.

    Ids rise within a page and from the last of a page to the first of the next; every page but the last is full.
    A routed document has a well-formed slug that is its source's, and no other one of its type has it.
    """
    pages = rows.groupBy("page").agg(F.max_by("id", "pos").alias("last_id"), F.count("*").alias("n"))
    before = pages.select((F.col("page") + 1).alias("page"), F.col("last_id").alias("_page_before"))
    routed = F.col("type").isin(*ROUTED)
    repeated = rows.filter(routed & F.col("slug").isNotNull()).groupBy("type", "slug").agg((F.count("*") > 1).alias("_repeated"))
    lag = F.lag("id").over(Window.partitionBy("page").orderBy("pos"))
    seen = rows.withColumn("_lag", lag).join(before, "page", "left").join(repeated, ["type", "slug"], "left").withColumn("_before", F.coalesce("_lag", "_page_before"))
    found = reasons(
        ("missing-id", F.col("id").isNull()), ("unordered", F.col("id") <= F.col("_before")), ("unpublished", ~is_published(F.col("id"))),
        ("unknown-type", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))), ("invalid-slug", routed & ~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False))),
        ("changed-slug", routed & (F.coalesce("source_slug", F.lit("")) != "") & ~F.col("source_slug").eqNullSafe(F.col("slug"))), ("duplicate-slug", routed & F.col("_repeated")),
    )
    by_row = seen.select("page", "pos", "id", F.explode(found).alias("violation"))
    following = pages.select((F.col("page") - 1).alias("page"), F.lit(True).alias("_more"))
    sizes = pages.join(following, "page", "left")
    wrong = sizes.filter((F.col("n") > page_size) | (F.col("n") < page_size) & F.col("_more"))
    return by_row.unionByName(wrong.select("page", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("page-size").alias("violation")))


def offer_violations(offers: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """``offers`` with ``violations``: slug, protected slug, texts, date window and images; null fields are missing ones."""
    slug = F.col("slug")
    text = lambda c: ~F.coalesce((trimmed(F.col(c)) != "") & (F.length(c) <= OFFER_CHARS[c]), F.lit(False))
    dates = valid_iso_date(F.col("start_date")) & valid_iso_date(F.col("end_date")) & (F.col("start_date") <= F.col("end_date"))
    good = F.coalesce(slug.rlike(SLUG) & (F.length(slug) <= OFFER_SLUG_CHARS) & ~slug.isin(*reserved) & ~F.startswith(slug, F.lit("obrigado")), F.lit(False))
    found = reasons(
        ("slug", ~good), ("changed-slug", (F.coalesce("source_slug", F.lit("")) != "") & ~F.col("source_slug").eqNullSafe(slug)),
        *[(c, text(c)) for c in OFFER_CHARS], ("title-lines", F.col("title").rlike("[\r\n]")), ("dates", ~F.coalesce(dates, F.lit(False))),
        ("image", image_ref(F.col("image")).isNull()), ("og-image", image_ref(F.col("og_image")).isNull()),
    )
    return offers.withColumn("violations", found)


def ancestors(route: Column) -> Column:
    """A route and every route above it, the root left out: ``/a/b`` gives ``/a`` and ``/a/b``."""
    parts = F.split(route, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def route_verdicts(inventory: DataFrame, items: DataFrame, built: DataFrame, added: DataFrame, excluded: DataFrame) -> DataFrame:
    """``route, verdict`` of every route that is not as planned, a row for each verdict.

    ``inventory(path, draft, collection)``: a page with a collection is a template, expanded by the slugs of
    ``items(collection, slug)``; the others tables have a ``route``. Expected are published pages and expanded templates but
    for the excluded, and the added ones. A built route below a template that no item accounts for is found by joining
    its ancestors to the templates' bases, so that no prefix is compared with every route.
    """
    good = F.coalesce(F.col("path").rlike(r"^/[^?#]*$"), F.lit(False)) & F.col("draft").isNotNull() & (F.col("collection").isNull() | (trimmed(F.col("collection")) != ""))
    invalid = inventory.filter(~good).select(F.col("path").alias("route"), F.lit("invalid-page").alias("verdict"))
    pages = inventory.filter(good)
    static = pages.filter("collection is null")
    bases = pages.filter("collection is not null and not draft").select(F.regexp_replace("path", "/$", "").alias("base"), "collection").distinct()
    expanded = bases.join(items.filter((trimmed(F.col("slug")) != "") & ~F.contains("slug", F.lit("/"))), "collection").select(F.concat_ws("/", "base", "slug").alias("route"))
    cms = expanded.join(excluded, "route", "left_anti").distinct()
    published = static.filter("not draft").select(F.col("path").alias("route")).join(excluded, "route", "left_anti")
    expected = published.unionByName(cms).unionByName(added).distinct()
    built = built.distinct()
    below = built.withColumn("base", F.explode(ancestors(F.col("route")))).join(bases, "base", "left_semi").select("route").distinct()
    drafts = static.filter("draft").select(F.col("path").alias("route")).distinct()
    verdicts = {
        "missing": expected.join(built, "route", "left_anti"),
        "draft-built": drafts.join(built, "route", "left_semi").join(added, "route", "left_anti"),
        "excluded-built": excluded.distinct().join(built, "route", "left_semi"),
        "unlisted": below.join(cms, "route", "left_anti").join(added, "route", "left_anti"),
    }
    for name, rows in verdicts.items():
        invalid = invalid.unionByName(rows.select("route", F.lit(name).alias("verdict")))
    return invalid


def search_field_deltas(source: DataFrame, target: DataFrame) -> DataFrame:
    """``route, field, source, target`` where two pages' search fields differ; ``route, field, value``, one value a field.

    Robots are compared without ``noindex``, which only hides a page that is not yet public.
    """
    s = source.select("route", "field", F.col("value").alias("_s"))
    t = target.select(F.col("route").alias("_route"), F.col("field").alias("_field"), F.col("value").alias("_t"))
    joined = s.join(t, (F.col("route") == F.col("_route")) & (F.col("field") == F.col("_field")), "full")
    field = F.coalesce("field", "_field")
    of = lambda c: F.when(field == "robots", robots_left(F.col(c), F.col("_t"))).otherwise(F.col(c))
    return joined.select(F.coalesce("route", "_route").alias("route"), field.alias("field"), of("_s").alias("source"), of("_t").alias("target")).filter("not source <=> target")


def reconciled_batches(expected: DataFrame, observed: DataFrame, limit: int, envelope: int) -> DataFrame:
    """``batch, status, reason, complete, missing`` of requests of which it isn't known whether they arrived.

    ``expected(batch, id, type, legacy_id, locale, slug, content, bytes)``, ``observed`` without batch and bytes. A batch is
    blocked if one of its ids belongs to another identity, an identity is there twice, its id or slug differs, or its content;
    the first of these that any of its documents shows is the reason. Else the missing ones are sent again, if a request
    can hold them.
    """
    identity = ["type", "legacy_id", "locale"]
    o = observed.select(*[F.col(c).alias(f"_{c}") for c in ("id", *identity, "slug", "content")])
    key = F.col("type").eqNullSafe(F.col("_type")) & F.col("legacy_id").eqNullSafe(F.col("_legacy_id")) & F.col("locale").eqNullSafe(F.col("_locale"))
    foreign = expected.join(o, (F.col("id") == F.col("_id")) & ~key).select("batch").distinct().withColumn("_foreign", F.lit(True))
    found = o.groupBy("_type", "_legacy_id", "_locale").agg(F.count("*").alias("_n"), F.min_by(F.struct("_id", "_slug", "_content"), F.struct("_id", "_slug")).alias("_o"))
    rows = expected.join(found, key, "left")
    there = F.col("_n").isNotNull()
    other = there & ~(F.col("_o._id").eqNullSafe(F.col("id")) & F.col("_o._slug").eqNullSafe(F.col("slug")))
    by_batch = rows.groupBy("batch").agg(
        F.count_if(there).alias("_there"), F.count_if(~there).alias("_missing"), F.sum(F.when(~there, F.col("bytes"))).alias("_bytes"), F.bool_or(F.coalesce(F.col("_n") > 1, F.lit(False))).alias("_twice"),
        F.bool_or(other).alias("_other"), F.bool_or(there & ~F.col("_o._content").eqNullSafe(F.col("content"))).alias("_changed"),
    ).join(foreign, "batch", "left")
    size = F.col("_bytes") + envelope + F.col("_missing") - 1
    reason = F.coalesce(*[F.when(c, F.lit(n)) for n, c in (("foreign-id", F.col("_foreign")), ("duplicate", F.col("_twice")), ("identity-mismatch", F.col("_other")), ("content-mismatch", F.col("_changed")), ("retry-too-large", size > limit))])
    blocked = reason.isNotNull() & (reason != "retry-too-large")
    status = F.when(reason.isNotNull(), "blocked").when(F.col("_missing") == 0, "complete").otherwise("retry-missing-only")
    return by_batch.select("batch", status.alias("status"), reason.alias("reason"), F.when(blocked, 0).otherwise(F.col("_there")).cast("long").alias("complete"), F.when(blocked, 0).otherwise(F.col("_missing")).cast("long").alias("missing"))


def live_slugs(staged: DataFrame, live: DataFrame) -> DataFrame:
    """``id, locale, slug, live_slug``: the live slug of the same locale, else of the id's only live row, else the item's own."""
    same = live.select("id", "locale", F.col("slug").alias("_same"))
    only = live.groupBy("id").agg(F.count("*").alias("_n"), F.min("slug").alias("_only")).filter("_n = 1").select("id", "_only")
    joined = staged.select("id", "locale", "slug").join(same, ["id", "locale"], "left").join(only, "id", "left")
    return joined.select("id", "locale", "slug", F.coalesce("_same", "_only", "slug").alias("live_slug"))


#: What a service's answer makes of an upload.
REPORTED = {"running": "running", "completed": "awaiting-metadata", "failed": "failed", "unknown": "unknown"}


def upload_step(state: tuple[str, int] | None, kind: str, status: str | None, operation: str | None) -> tuple[tuple[str, int], str]:
    """The next (status, attempt) of an asset and whether the event was ``applied`` or ``refused``."""
    now, attempt = state or ("planned", 0)
    if kind == "claim" and now in ("planned", "retry-authorized"):
        return ("submitting", attempt), "applied"
    if kind == "submit" and now == "submitting":
        return (REPORTED.get(status, "unknown") if operation else "unknown", attempt), "applied"
    if kind == "status" and now not in ("planned", "retry-authorized", "submitting") and status in REPORTED:
        return (REPORTED[status], attempt), "applied"
    if kind == "retry" and now == "failed":
        return ("retry-authorized", attempt + 1), "applied"
    if kind == "resume" and now == "submitting":
        return ("unknown", attempt), "applied"
    return (now, attempt), "refused"


def upload_states(events: DataFrame) -> DataFrame:
    """``file_id, seq, status, attempt, outcome`` after each event of ``events(file_id, seq, kind, status, operation)``."""

    def told(state: tuple[str, int] | None, row: tuple) -> tuple[tuple[str, int], tuple]:
        file_id, seq, *event = row
        state, outcome = upload_step(state, *event)
        return state, (file_id, seq, *state, outcome)

    names = (("file_id", LongType()), ("seq", LongType()), ("status", StringType()), ("attempt", LongType()), ("outcome", StringType()))
    rows = events.select("file_id", "seq", "kind", "status", "operation")
    return sorted_fold(rows, "file_id", ["seq"], told, StructType([StructField(*n) for n in names]))
