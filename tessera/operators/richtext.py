"""Rich text: HTML to blocks of marked runs, back to HTML, and an audit that both say the same."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags a text may hold, schemes its links may have, and the marks.
HEADINGS = ("h2", "h3", "h4", "h5")
BLOCKS = ("p", *HEADINGS, "li")
LISTS = ("ul", "ol")
MARKS = ("strong", "em")
ALLOWED = (*BLOCKS, *LISTS, *MARKS, "a", "br")
SAFE_LINK = re.compile(r"https?:|mailto:|tel:|/")

RUN = "struct<text: string, marks: array<string>, href: string, blank: boolean>"
BLOCK = f"struct<tag: string, list_kind: string, runs: array<{RUN}>>"


class Unsupported(ValueError):
    """The text holds something that blocks can't carry."""


class _Reader(HTMLParser):
    """Blocks in document order; a block that starts ends the one before it, and marks stay open across them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.block: dict | None = None
        self.lists: list[str] = []
        self.marks: list[str] = []
        self.links: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag not in ALLOWED:
            raise Unsupported(f"unsupported <{tag}>")
        if tag in LISTS:
            if self.lists:
                raise Unsupported("nested list")
            if tag == "ol" and ("reversed" in given or given.get("start", "1") != "1" or given.get("type", "1") != "1"):
                raise Unsupported("list numbering")
            self.lists.append(tag)
            self.block = None
        elif tag == "li":
            if not self.lists:
                raise Unsupported("list item outside a list")
            if "value" in given:
                raise Unsupported("list numbering")
            self.start("li", self.lists[-1])
        elif tag in BLOCKS:
            if not (self.lists and self.block):
                self.start(tag, None)
        elif tag in MARKS:
            self.marks.append(tag)
        elif tag == "br":
            self.put("\n")
        elif tag == "a":
            href, target = given.get("href") or "", given.get("target") or ""
            if not SAFE_LINK.match(href):
                raise Unsupported("link href")
            if target not in ("", "_blank"):
                raise Unsupported("link target")
            self.links.append((href, target == "_blank"))

    def handle_endtag(self, tag: str) -> None:
        if tag in LISTS and self.lists:
            self.lists.pop()
            self.block = None
        elif tag == "li" or (tag in BLOCKS and not self.lists):
            self.block = None
        elif tag in self.marks:
            del self.marks[len(self.marks) - 1 - self.marks[::-1].index(tag)]
        elif tag == "a" and self.links:
            self.links.pop()

    def handle_data(self, data: str) -> None:
        text = re.sub(r"[\t\r\n ]+", " ", data)
        if self.block is None and not text.strip(" "):
            return
        self.put(text)

    def start(self, tag: str, list_kind: str | None) -> None:
        self.block = {"tag": tag, "list_kind": list_kind, "runs": []}
        self.blocks.append(self.block)

    def put(self, text: str) -> None:
        """Text of one look joins the run before it; text outside a block opens a paragraph."""
        if self.block is None:
            self.start("p", None)
        href, blank = self.links[-1] if self.links else (None, False)
        look = {"marks": list(self.marks), "href": href, "blank": blank}
        runs = self.block["runs"]
        if runs and all(runs[-1][k] == v for k, v in look.items()):
            runs[-1]["text"] += text
        else:
            runs.append({"text": text, **look})


def to_blocks(html: str) -> list[dict]:
    """The blocks of a text; spaces at their edges don't count, line breaks and no-break spaces do."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    for b in reader.blocks:
        if b["runs"]:
            b["runs"][0]["text"] = b["runs"][0]["text"].lstrip(" ")
            b["runs"][-1]["text"] = b["runs"][-1]["text"].rstrip(" ")
        b["runs"] = [r for r in b["runs"] if r["text"]]
    return reader.blocks


def to_html(blocks: list[dict]) -> str:
    """The blocks as HTML; items of one kind of list that follow each other are one list."""
    out, inside = [], None
    for b in blocks:
        if b["list_kind"] != inside:
            out += [f"</{inside}>" if inside else "", f"<{b['list_kind']}>" if b["list_kind"] else ""]
            inside = b["list_kind"]
        body = []
        for r in b["runs"]:
            text = escape(r["text"], quote=False).replace("\n", "<br>")
            for m in reversed(r["marks"]):
                text = f"<{m}>{text}</{m}>"
            if r["href"] is not None:
                text = f'<a href="{escape(r["href"])}"{" target=\"_blank\"" if r["blank"] else ""}>{text}</a>'
            body.append(text)
        out.append(f"<{b['tag']}>{''.join(body)}</{b['tag']}>")
    return "".join([*out, f"</{inside}>" if inside else ""])


def rich_text(rows: DataFrame, key: str, html: str) -> DataFrame:
    """``key, blocks, error, html``: the blocks of each text and these rendered; null for both where error says why not.

    A null or blank text has the error ``empty``. The first fault in document order is told.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, blocks array<{BLOCK}>, error string, rendered string"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, errors, rendered = [], [], []
            for text in b.column(1).to_pylist():
                try:
                    found = to_blocks(text or "")
                    fault = None if found else "empty"
                except Unsupported as e:
                    found, fault = [], str(e)
                blocks.append(None if fault else found)
                errors.append(fault)
                rendered.append(None if fault else to_html(found))
            columns = [b.column(0), blocks, errors, rendered]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.select(key, html).mapInArrow(run, schema)


def block_counts(blocks: Column) -> list[Column]:
    """Paragraphs, headings, items, line breaks and links of an array of blocks."""
    tagged = lambda *tags: F.size(F.filter(blocks, lambda b: b["tag"].isin(*tags)))
    runs = F.flatten(F.transform(blocks, lambda b: b["runs"]))
    breaks = F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r["text"]) - F.length(F.replace(r["text"], F.lit("\n"), F.lit(""))))
    links = F.size(F.filter(runs, lambda r: r["href"].isNotNull()))
    return [tagged("p").alias("paragraphs"), tagged(*HEADINGS).alias("headings"), tagged("li").alias("items"), breaks.alias("breaks"), links.alias("links")]


def rich_text_audit(rows: DataFrame, key: str, html: str) -> DataFrame:
    """``key, error, match``, counts and digest: whether the rendered blocks, read again, are the same blocks."""
    first = rich_text(rows, key, html)
    again = rich_text(first.filter("error is null"), key, "rendered").select(F.col(key).alias("_k"), F.col("blocks").alias("_b"))
    digest = lambda c: F.sha2(F.to_json(c).cast("binary"), 256)
    told = first.select(key, "error", digest("blocks").alias("digest"), *block_counts(F.col("blocks")))
    seen = again.select("_k", digest("_b").alias("_d"))
    joined = told.join(seen, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(*told.columns, (F.col("digest") == F.col("_d")).alias("match"))
