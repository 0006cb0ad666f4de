"""Column helpers for URLs, media references, search-engine fields and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import trimmed

#: Kinds of images, hosts of the video site, lengths of a preview's line.
IMAGE_REF = r"^image-([a-zA-Z0-9]+)-(\d+)x(\d+)-(jpg|jpeg|png|webp|gif|avif)$"
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
PREVIEW_CHARS = 78
#: Route prefixes whose documents may be indexed.
INDEXED_PREFIXES = ("imoveis", "post", "vouvender")


def image_ref(ref: Column) -> Column:
    """``hash, width, height, ext`` of an image's reference; null if it is malformed or has no extent."""
    part = lambda i: F.regexp_extract(ref, IMAGE_REF, i)
    width, height = part(2).try_cast("int"), part(3).try_cast("int")
    return F.when((width > 0) & (height > 0), F.struct(part(1).alias("hash"), width.alias("width"), height.alias("height"), part(4).alias("ext")))


def media_source(text: Column) -> Column:
    """The ``src`` of an embed snippet or the text itself, if it is an http(s) URL with a host; else null."""
    embedded = F.regexp_extract(text, r"""(?i)src=["']([^"']*)["']""", 1)
    source = trimmed(F.when(embedded != "", embedded).otherwise(text))
    return F.when(source.rlike(r"(?i)^https?://[^/?#\s]+\S*$"), source)


def _parameter(url: Column, name: str) -> Column:
    found = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    return F.nullif(found, F.lit(""))


def video_embed(text: Column) -> Column:
    """The player's URL of a video's sharing link, with its start in seconds; other sources as they are; null if unusable."""
    source = media_source(text)
    host = F.lower(F.regexp_extract(source, r"(?i)^https?://(?:[^@/?#]*@)?([^/?#:]+)", 1))
    parts = F.filter(F.split(F.regexp_extract(source, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    short = host.isin(*SHORT_HOSTS)
    video = F.when(short, first).when(first == "watch", _parameter(source, "v")).when(first.isin("embed", "shorts", "live"), second)
    time = F.coalesce(_parameter(source, "start"), _parameter(source, "t"))
    unit = lambda u: F.coalesce(F.regexp_extract(time, rf"(\d+){u}", 1).try_cast("long"), F.lit(0))
    spelled = F.when(time.rlike(r"^(\d+h)?(\d+m)?(\d+s)?$"), unit("h") * 3600 + unit("m") * 60 + unit("s"))
    seconds = F.coalesce(time.try_cast("long"), spelled, F.lit(0))
    player = F.concat(F.lit("https://www.youtube.com/embed/"), video, F.when(seconds > 0, F.concat(F.lit("?start="), seconds.cast("string"))).otherwise(""))
    return (
        F.when(~(short | host.isin(*VIDEO_HOSTS)), source)
        .when(~F.coalesce(video.rlike(r"^[A-Za-z0-9_-]{11}$"), F.lit(False)), F.lit(None))
        .when((first == "embed") & ~short, source)
        .otherwise(player)
    )


def file_name(url: Column) -> Column:
    """The last part of a URL's path, percent-decoded unless that fails; a name of its own where the path is empty."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    last = F.element_at(F.when(F.size(parts) > 0, parts), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last, F.when(url.isNotNull(), "original-image"))


def name_uuid(namespace: str, name: Column) -> Column:
    """UUID of version 5 of a name in a namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
                       F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def robots_left(values: Column, target: Column) -> Column:
    """Comma-joined robots tokens without ``noindex``, and without the ``nofollow`` that comes with it where ``target`` has it."""
    tokens = lambda c: F.transform(F.split(c, ","), lambda t: F.trim(t))
    hidden = F.coalesce(F.exists(tokens(target), lambda t: F.lower(t) == "noindex"), F.lit(False))
    left = F.filter(tokens(values), lambda t: (F.lower(t) != "noindex") & ~(hidden & (F.lower(t) == "nofollow")))
    return F.nullif(F.array_join(left, ","), F.lit(""))


def robots_policy(path: Column, static_paths: list[str], production: bool) -> Column:
    """What a page tells crawlers: static paths and the documents of some prefixes may be indexed, in production alone."""
    documents = path.rlike(rf"^/(?:{'|'.join(INDEXED_PREFIXES)})/[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$")
    return F.when(F.lit(production) & F.coalesce(path.isin(*static_paths) | documents, F.lit(False)), "index, follow").otherwise("noindex, nofollow")


def site_url(href: Column, base: Column, own_hosts: tuple[str, ...]) -> Column:
    """A link as seen from the page ``base``: own hosts become path, query and fragment; others keep their origin.

    Dot segments stay as they are; what is neither relative nor http(s) is left alone.
    """
    origin, path = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    whole = (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), F.concat(origin, path, query, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, folder, href))
    )
    host = F.lower(F.regexp_extract(whole, r"^[A-Za-z]+://([^/?#]*)", 1))
    rest = F.regexp_extract(whole, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))
    own = (host == F.lower(F.regexp_extract(base, r"^[A-Za-z]+://([^/?#]*)", 1))) | host.isin(*own_hosts)
    return F.coalesce(F.when(own, rest).when(host != "", F.concat(F.lower(F.regexp_extract(whole, r"^([A-Za-z]+://[^/?#]*)", 1)), rest)), href)


def shared_link(url: Column) -> Column:
    """``slug, token`` of a link that was shared with a token; null without one or without a slug."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    slug = F.element_at(F.when(F.size(parts) > 0, parts), -1)
    return F.when(slug.isNotNull() & _parameter(url, "t").isNotNull(), F.struct(slug.alias("slug"), _parameter(url, "t").alias("token")))


def with_preview(rows: DataFrame, text: str, name: str = "preview") -> DataFrame:
    """``rows`` with the first two lines of a text, wrapped at spaces; an ellipsis where there would be a third.

    Lines are trimmed; one without a space to break at is cut. Null stays null, the empty text is an empty line.
    """
    rows = rows.withColumn("_rest", F.regexp_replace(text, "\r\n?", "\n"))
    for i in (1, 2):
        rows = rows.withColumn("_line", trimmed(F.substring_index("_rest", "\n", 1)))
        after = F.when(F.contains("_rest", F.lit("\n")), F.substr("_rest", F.instr("_rest", "\n") + 1))
        head = F.substring("_line", 1, PREVIEW_CHARS)
        space = F.when(F.contains(head, F.lit(" ")), F.length(head) - F.instr(F.reverse(head), " ")).otherwise(0)
        rows = rows.withColumn("_end", F.when(F.length("_line") <= PREVIEW_CHARS, F.length("_line")).when(space > 0, space).otherwise(PREVIEW_CHARS))
        left = F.substr("_line", F.col("_end") + 1)
        rows = rows.withColumn("_rest", F.when(left == "", after).otherwise(F.concat(left, F.coalesce(F.concat(F.lit("\n"), after), F.lit("")))))
        rows = rows.withColumn(f"_line{i}", F.substr("_line", F.lit(1), F.col("_end")))
    shortened = F.concat(F.regexp_replace(F.substring("_line2", 1, PREVIEW_CHARS - 1), r"(?U)\s+$", ""), F.lit("…"))
    second = F.when(F.col("_rest").isNotNull(), shortened).otherwise(F.col("_line2"))
    preview = F.when(F.col(text).isNotNull(), F.concat_ws("\n", "_line1", second))
    return rows.withColumn(name, preview).drop("_rest", "_line", "_end", "_line1", "_line2")
