"""Source items to documents of six kinds, by tables of rules that are compiled into one projection.

A rule says where a value of a document comes from, how it is taken, and whether it must be there. ``mapped`` turns
all rules into one select: a document and a ledger of its faults, in the order of the rules. An item's fields are taken
apart once, into a struct of those that rules name. What items ask of images and rich texts is told apart by its digest:
each distinct one is exploded to narrow rows, resolved by joins and by the parser, and joined to the items that ask it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convert import decoded
from .richtext import BLOCK, rich_text


class Rule(NamedTuple):
    """``take``: text, number, flag, any, code, lenient, html, image, images, time or absent; with ``!`` it must be there.

    ``target`` and ``source`` have dots between levels. ``codes`` names a code table. Where two rules have one target, the
    second is asked where the first finds nothing.
    """

    kind: str
    target: str
    source: str
    take: str
    codes: str | None = None


# Names of source fields and their documents' fields, and the codes of the source's options.
RULES = (
    Rule("property", "title", "id-kw", "text!"),
    Rule("property", "referenceCode", "name", "text!"),
    Rule("property", "summary", "descricao-resumo", "text"),
    Rule("property", "description", "descricao-completa", "html"),
    Rule("property", "listingStatus", "estado-da-angariacao", "code", "status"),
    Rule("property", "marketBanner", "banner-de-mercado", "code", "banner"),
    Rule("property", "price", "preco", "number"),
    Rule("property", "priceOnRequest", "preco-sob-consulta", "flag"),
    Rule("property", "propertyType", "natureza-do-imovel", "code", "type"),
    Rule("property", "municipality", "concelho", "any"),
    Rule("property", "municipality", "principais-concelhos", "lenient", "municipality"),
    Rule("property", "parish", "freguesia", "text"),
    Rule("property", "bedrooms", "quartos", "number"),
    Rule("property", "bathrooms", "casas-de-banho", "number"),
    Rule("property", "parkingSpaces", "estacionamento", "number"),
    Rule("property", "usableArea", "area-util", "number"),
    Rule("property", "grossArea", "area-bruta", "number"),
    Rule("property", "energyCertificate", "certificado-energetico", "code", "energy"),
    Rule("property", "amenities.elevator", "elevador", "any"),
    Rule("property", "amenities.storage", "arrecadacao", "any"),
    Rule("property", "amenities.balcony", "varanda", "any"),
    Rule("property", "amenities.terrace", "terraco", "any"),
    Rule("property", "amenities.garden", "jardim", "any"),
    Rule("property", "amenities.pool", "piscina", "any"),
    Rule("property", "featuredImage", "fotografia-de-destaque", "image"),
    Rule("property", "gallery", "outras-fotografias", "images"),
    Rule("property", "videoUrl", "link-video.url", "text"),
    Rule("property", "matterportUrl", "matterport", "text"),
    Rule("property", "mapEmbed", "google-maps", "text"),
    Rule("article", "publishedAt", "@created", "time!"),
    Rule("article", "title", "name", "text!"),
    Rule("article", "subtitle", "subtitulo", "text"),
    Rule("article", "summary", "resumo", "text"),
    Rule("article", "body", "artigo", "html!"),
    Rule("article", "readingMinutes", "tempo-de-leitura", "number"),
    Rule("article", "cta.eyebrow", "cta-sub-heading", "text"),
    Rule("article", "cta.heading", "cta-heading", "text"),
    Rule("article", "cta.copy", "cta-copy", "text"),
    Rule("article", "cta.label", "cta-buton-text", "text"),
    Rule("article", "mainImage", "imagem-principal", "image"),
    Rule("article", "thumbnailImage", "imagem-miniatura", "image"),
    Rule("article", "openGraphImage", "opengraph-image", "image"),
    Rule("article", "videoUrl", "video.url", "text"),
    Rule("article", "gallery", "galeria", "images"),
    Rule("testimonial", "clientName", "name", "text!"),
    Rule("testimonial", "quote", "testemunho-3", "text!"),
    Rule("testimonial", "portrait", "foto-de-perfil", "image"),
    Rule("offer", "title", "name", "text!"),
    Rule("offer", "heading", "heading-copy", "text"),
    Rule("offer", "body", "copy", "text"),
    Rule("offer", "image", "imagem", "image"),
    Rule("preListing", "", "galeria-2", "absent"),
    Rule("preListing", "clientName", "name", "text!"),
    Rule("preListing", "address", "morada", "text!"),
    Rule("preListing", "parish", "freguesia", "text!"),
    Rule("preListing", "municipality", "concelho", "text"),
    Rule("preListing", "heroImage", "hero-image-2", "image"),
    Rule("processStep", "title", "name", "text!"),
    Rule("processStep", "body", "copy", "text!"),
    Rule("processStep", "placement", "page", "code!", "placement"),
    Rule("processStep", "ctaLabel", "link-label", "text"),
    Rule("processStep", "ctaUrl", "link-url", "text"),
    Rule("processStep", "videoUrl", "video.url", "text"),
    Rule("processStep", "thumbnail", "thumbnail", "image"),
    Rule("processStep", "image", "image", "image"),
)
CODES = {
    "placement": {"663132020846a392d304a25e78392a84": "home", "61e1b999e018031966a98c78f8548d5d": "buy", "1d2e3b2ba040ba7d01a627b6f2c9396d": "marketing"},
    "status": {
        "77306c0e91f8838c07881d84ef30e1ae": "active", "b769cf6a216be5e71de8463250c064f1": "sold",
        "f26b8d13f3de271a54c84b3dbc7106ba": "reserved", "45794da0a6a7fb94fa45a5421cfa4267": "expiredCancelled",
    },
    "banner": {
        "53979b2f329c93a57999e82942298aa9": "new", "ff323f575f6c60fa8ececf78f36417f3": "newPrice",
        "4ac9c303f1f49c1a4fde70f037cb367b": "openHouse", "7b249ccd749d622cb728ef0f846c2811": "reserved",
    },
    "type": {
        "86ba35ed1a378e7de62d0088292a93ad": "apartment", "1ad24d4a6a313ac31a0b60001ce773b4": "house",
        "bfd26e85ffd939b9814073defbd58a37": "building", "3126804b84a70e2eb4ef7e15c1ecd928": "other",
    },
    "municipality": {
        "e26f92e10e59a19ca974ad7cbaafbd06": "Porto", "1737fcdf9af2508858970387f4c0995b": "Vila Nova de Gaia",
        "4350ced3542bbb3b9b019ca1da4f36d1": "Gondomar", "53ef20ad0e053c1e104844b4f92866a0": "Maia",
        "deee0ae1954896eb17df03a578188185": "Matosinhos", "7127fc67f4303e2653c845f5565b7714": "Póvoa de Varzim",
        "a40f7871429e22060fcff6a1c2d2242e": "Valongo", "2b29497923f7334b1e8d64f26b833a62": "Vila do Conde",
    },
    "energy": {
        "df389ea8b93ff88afa45e89e1ca81640": "A+", "485fd88dbfa970a7f1b3bffa59a73031": "A", "e37d1cbcb784db755a27fb407492ea1e": "B",
        "af03baf9fcbb32da4efb5900fbfb7048": "B-", "f53543c16a57e70c2f85bf9c0d608d4d": "C", "165eb2939c53a4887bd2ce600a8831e2": "D",
        "2187fb78e6f73ccdfa75dcda2fac992a": "E", "b8eae98974506257d489eb9038361300": "F", "82804a7cfc13347aa0b5dc4bef6c6449": "G",
        "f669308ada6ccfe21735403988a558c2": "Exempt",
    },
}
#: White space that is cut from both ends of a text.
BLANK = "\t\n\v\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"


def cut(text: Column) -> Column:
    """The text without white space at its ends; null where nothing is left."""
    return F.nullif(F.btrim(text, F.lit(BLANK)), F.lit(""))


def taken_apart(sources: Sequence[str]) -> Column:
    """``_fields`` as a struct of the fields that stand first in ``sources``, each a variant; null if it is no object."""
    names = dict.fromkeys(s.split(".")[0] for s in sources if not s.startswith("@"))
    return F.try_variant_get(F.col("_fields"), "$", ", ".join(f"`{n}`: variant" for n in names).join(("struct<", ">")))


def at(source: str, as_type: str = "variant") -> Column:
    """What is found in ``_top``, the fields taken apart, at a path of names."""
    top, *below = source.split(".")
    found = F.col("_top").getField(top)
    path = "$" + "".join(f'["{name}"]' for name in below)
    return found if path == "$" and as_type == "variant" else F.try_variant_get(found, path, as_type)


def shape(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<...> and so on; null where there is nothing or a JSON null."""
    return F.nullif(F.schema_of_variant(value), F.lit("VOID"))


def text_at(source: str) -> Column:
    return F.when(shape(at(source)) == "STRING", cut(at(source, "string")))


def given(source: str) -> Column:
    """Whether there is a value other than null, false, zero and the empty text."""
    kind = shape(at(source))
    return kind.isNotNull() & ~F.coalesce(at(source, "string").isin("", "false") | (at(source, "double") == 0) & (kind != "STRING"), F.lit(False))


_PARTS = f"array<struct<target: string, pos: int, file_id: string, alt: string, ref: string, blocks: array<{BLOCK}>, fault: string>>"


def _slots(rule: Rule) -> Column:
    """What one rule asks: ``target, pos, file_id, url, alt, rich, html`` of each image or of a rich text; null if nothing."""
    if rule.take.startswith("html"):
        none = F.lit(None).cast("string")
        html = F.struct(F.lit(rule.target).alias("target"), F.lit(0).alias("pos"), none.alias("file_id"), none.alias("url"), none.alias("alt"), F.lit(True).alias("rich"), text_at(rule.source).alias("html"))
        return F.when(given(rule.source), F.array(html))
    found = F.array(at(rule.source)) if rule.take == "image" else at(rule.source, "array<variant>")
    asked = given(rule.source) if rule.take == "image" else shape(at(rule.source)).startswith("ARRAY")
    text = lambda v, name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", cut(F.try_variant_get(v, f"$.{name}", "string")))
    slot = lambda v, i: F.struct(F.lit(rule.target).alias("target"), i.alias("pos"), text(v, "fileId").alias("file_id"), text(v, "url").alias("url"), text(v, "alt").alias("alt"), F.lit(False).alias("rich"), F.lit(None).cast("string").alias("html"))
    return F.when(asked, F.transform(found, slot))


def _asks(rules: Sequence[Rule]) -> Column:
    """All that an item asks, by its kind; of two rules with one target the second where the first asks nothing."""
    out = F.lit(None).cast("array<struct<target: string, pos: int, file_id: string, url: string, alt: string, rich: boolean, html: string>>")
    for kind in dict.fromkeys(r.kind for r in rules):
        by_target: dict[str, list[Column]] = {}
        for r in rules:
            if r.kind == kind and r.take.rstrip("!") in ("image", "images", "html"):
                by_target.setdefault(r.target, []).append(_slots(r))
        if by_target:
            all_ = F.flatten(F.filter(F.array(*[F.coalesce(*x) for x in by_target.values()]), lambda x: x.isNotNull()))
            out = F.when(F.col("_kind") == kind, all_).otherwise(out)
    return out


def _parts(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """``_key, parts``: images resolved and texts parsed of each row of ``_key, _asks``, whose keys differ."""
    known = assets.select(F.col("key").alias("_asset"), F.col("ref").alias("_ref")).filter("_asset is not null and _ref is not null").groupBy("_asset").agg(F.min("_ref").alias("_ref"))
    each = lambda rich: asked.select("_key", F.explode(F.filter("_asks", lambda x: x["rich"] == rich)).alias("s")).select("_key", "s.*")
    by_url = known.select(F.col("_asset").alias("_by_url"), F.col("_ref").alias("_url_ref"))
    # The URL is asked only for slots whose file is unknown. What is not asked has a key of the item's own, as nulls would all meet in one task.
    alone = F.concat(F.lit("\0"), "_key")
    tried = each(False).withColumn("_file", F.coalesce("file_id", alone)).join(known, F.col("_file") == F.col("_asset"), "left")
    tried = tried.withColumn("_ask", F.coalesce(F.when(F.col("_ref").isNull(), F.col("url")), alone))
    named = tried.join(by_url, F.col("_ask") == F.col("_by_url"), "left").withColumn("ref", F.coalesce("_ref", "_url_ref"))
    fault = F.when(F.col("file_id").isNull(), "missing file id").when(F.col("url").isNull(), "missing url").when(~F.coalesce(F.startswith("ref", F.lit("image-")), F.lit(False)), "no asset")
    images = named.select("_key", "target", "pos", "file_id", "alt", "ref", F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"), fault.alias("fault"))
    read = rich_text(each(True).select(F.concat_ws("#", "_key", "target").alias("place"), "html"), "place", "html")
    none = F.lit(None).cast("string")
    place = F.split("place", "#", 2)
    texts = read.select(place[0].alias("_key"), place[1].alias("target"), F.lit(0).alias("pos"), none.alias("file_id"), none.alias("alt"), none.alias("ref"), "blocks", F.col("error").alias("fault"))
    return images.unionByName(texts).groupBy("_key").agg(F.collect_list(F.struct("target", "pos", "file_id", "alt", "ref", "blocks", "fault")).alias("parts"))


def _taken(rule: Rule, codes: dict[str, dict[str, str]]) -> tuple[Column, Column]:
    """The value of a rule and its fault; either is null."""
    take, needed = rule.take.rstrip("!"), rule.take.endswith("!")
    none, label = F.lit(None).cast("string"), at(rule.source, "string") if not rule.source.startswith("@") else F.col("_created")
    fault = none
    if take == "text":
        value = text_at(rule.source)
    elif take == "number":
        number = at(rule.source, "double")
        usable = shape(at(rule.source)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & ~F.isnan(number) & (F.abs(number) < float("inf"))
        value = F.when(usable, at(rule.source))
    elif take == "flag":
        value = at(rule.source, "boolean")
        value = F.when(shape(at(rule.source)) == "BOOLEAN", value)
    elif take == "any":
        value = F.when(shape(at(rule.source)).isNotNull(), at(rule.source))
    elif take == "time":
        value = cut(label)
        fault = F.when(F.try_to_timestamp(value).isNull() & value.isNotNull(), "no time")
    elif take in ("code", "lenient"):
        value = decoded(label, codes[rule.codes])
        if take == "code":
            fault = F.when(given(rule.source) & value.isNull(), F.concat(F.lit("unknown option "), F.coalesce(label, F.lit("of no text"))))
    elif take == "absent":
        return none, F.when(shape(at(rule.source)).startswith("ARRAY") & (F.size(at(rule.source, "array<variant>")) > 0), "unexpected")
    else:
        mine = F.array_sort(F.filter("parts", lambda p: p["target"] == rule.target), lambda a, b: a["pos"] - b["pos"])
        fault = F.get(F.filter(F.transform(mine, lambda p: p["fault"]), lambda x: x.isNotNull()), F.lit(0))
        image = lambda p: (F.lit("image").alias("_type"), F.struct(F.lit("reference").alias("_type"), p["ref"].alias("_ref")).alias("asset"), p["alt"].alias("alt"))
        if take == "image":
            value = F.get(F.transform(mine, lambda p: F.struct(*image(p))), F.lit(0))
        elif take == "images":
            keyed = lambda p: F.struct(F.concat(F.lit("source-"), p["pos"].cast("string"), F.lit("-"), p["file_id"]).alias("_key"), *image(p))
            value = F.when(F.size(mine) > 0, F.transform(mine, keyed))
        else:
            value = F.get(mine, F.lit(0))["blocks"]
    if needed:
        fault = F.coalesce(fault, F.when(value.isNull(), "missing"))
    return value, fault


def _document(kind: str, rules: Sequence[Rule], codes: dict[str, dict[str, str]]) -> tuple[Column, list[Column]]:
    """The JSON of one kind's document, and a fault or null for each rule."""
    tell = lambda field, fault: F.when(fault.isNotNull(), F.struct(F.lit(field).alias("field"), fault.alias("fault")))
    identity = {"legacyId": cut(F.col("_id")), "locale": cut(F.col("_locale")), "sourceSlug": text_at("slug")}
    faults = [tell(name, F.when(value.isNull(), "missing")) for name, value in identity.items()]
    values: dict[str, Column] = {"_type": F.lit(kind), **identity, "slug._type": F.lit("slug"), "slug.current": identity["sourceSlug"]}
    for rule in rules:
        value, fault = _taken(rule, codes)
        faults.append(tell(rule.target or rule.source, fault))
        if rule.target in values:
            # One field has one type: what two rules may give is written as a variant.
            value = F.coalesce(values[rule.target], value.cast("variant"))
        if rule.target:
            values[rule.target] = value
    columns: dict[str, Column] = {}
    for name, value in values.items():
        top = name.split(".")[0]
        if "." not in name:
            columns[top] = value
        elif top not in columns:
            below = {n.split(".", 1)[1]: v for n, v in values.items() if n.startswith(top + ".")}
            full = functools.reduce(operator.or_, [v.isNotNull() for v in below.values()])
            columns[top] = F.when(full, F.struct(*[v.alias(n) for n, v in below.items()]))
    return F.to_json(F.struct(*[v.alias(n) for n, v in columns.items()])), faults


def mapped(items: DataFrame, assets: DataFrame, rules: Sequence[Rule] = RULES, codes: dict[str, dict[str, str]] = CODES) -> DataFrame:
    """``kind, id, locale, document, faults``: a row for each of ``items``, with ``document`` null where ``faults`` has any.

    ``items`` has ``kind, id, locale, created`` and ``fields`` (variant); other columns are left out. ``assets`` has ``key, ref``: keys are
    file ids or URLs, a key's smallest reference counts, and a file's own goes before its URL's. ``faults`` is an array of
    ``field, fault`` in the order of the rules. A kind without rules is a fault of the field ``kind``; fields that are null, no object or absent
    count as empty. In the document nothing is null, and no object is empty. Equal items have equal rows, as many as there are.
    """
    keyed = items.select(F.col("kind").alias("_kind"), F.col("id").cast("string").alias("_id"), F.col("locale").alias("_locale"), F.col("created").alias("_created"), F.col("fields").alias("_fields"))
    media = [r.source for r in rules if r.take.rstrip("!") in ("image", "images", "html")]
    if media:
        asking = keyed.withColumn("_top", taken_apart(media)).withColumn("_asks", _asks(rules)).drop("_top")
        # Items that ask the same share a digest, and with it the parts. What asks nothing has a key of its own, as nulls would all meet in one task.
        # No filter and no null here: the optimiser would push these below all that takes the fields apart, which then is done once a reference.
        asking = asking.withColumn("_key", F.coalesce(F.when(F.size("_asks") > 0, F.sha2(F.to_json("_asks").cast("binary"), 256)), F.lit("")))
        parts = _parts(asking.select("_key", "_asks").distinct(), assets).withColumnRenamed("_key", "_part_key")
        alone = F.concat(F.lit("\0"), F.coalesce("_id", F.lit("")))
        whole = asking.drop("_asks").withColumn("_key", F.when(F.col("_key") == "", alone).otherwise(F.col("_key"))).join(parts, F.col("_key") == F.col("_part_key"), "left")
        whole = whole.withColumn("parts", F.coalesce("parts", F.array().cast(_PARTS)))
    else:
        whole = keyed.withColumn("parts", F.array().cast(_PARTS))
    whole = whole.withColumn("_top", taken_apart(["slug", *(r.source for r in rules if r.source not in media)]))
    document, faults = F.lit(None).cast("string"), F.array(F.struct(F.lit("kind").alias("field"), F.lit("unknown").alias("fault")))
    for kind in dict.fromkeys(r.kind for r in rules):
        text, told = _document(kind, [r for r in rules if r.kind == kind], codes)
        document = F.when(F.col("_kind") == kind, text).otherwise(document)
        faults = F.when(F.col("_kind") == kind, F.filter(F.array(*told), lambda x: x.isNotNull())).otherwise(faults)
    out = whole.select(F.col("_kind").alias("kind"), F.col("_id").alias("id"), F.col("_locale").alias("locale"), document.alias("document"), faults.alias("faults"))
    return out.withColumn("document", F.when(F.size("faults") == 0, F.col("document")))
