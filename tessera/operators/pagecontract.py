"""What a page promises its readers, from one parse: title and meta values, links, form fields and counts of tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Classes that hide what they hold, and those of bars that repeat links (all classes of one entry).
HIDING = ("w-hidden", "w-dyn-hide")
BARS = (("sticky-bar",), ("navbar2_component", "imoveis"))
#: Elements without an end, and those that a like one or a block ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_LIKE = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "a": {"a"}, "button": {"button"}, "form": {"form"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CONTROLS = frozenset(("input", "select", "textarea"))

ROWS = "page_id long, kind string, pos int, form string, name string, value string, target string, label string, required boolean, visible boolean, options array<string>"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def cleaned(text: str) -> str:
    """Zero-width characters out, white space as one space, trimmed."""
    return " ".join(re.sub("[​‌‍﻿]", "", text).split())


class _Open:
    """An element whose end has not come, with the visibility that its content inherits and the texts it collects."""

    def __init__(self, tag: str, visible: bool, text: list[str] | None):
        self.tag, self.visible, self.text, self.row = tag, visible, text, None


class Contract(HTMLParser):
    """Rows of one page; call ``feed``, then ``rows``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.found: list[dict] = []
        self.counts: Counter = Counter()
        self.form: str | None = None
        self.labels: dict[str, str] = {}
        self.titled = False

    def add(self, kind: str, **values: object) -> dict:
        self.found.append(dict.fromkeys(COLUMNS) | {"kind": kind, "pos": len(self.found)} | values)
        return self.found[-1]

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        a: dict[str, str] = {}
        for name, value in attributes:
            a.setdefault(name, value or "")
        self.counts[tag] += 1
        if tag in BLOCKS:
            self.end_nearest({"p"}, {"button", "table", "td", "th"})
        if tag in ENDS_LIKE:
            self.end_nearest(ENDS_LIKE[tag], {"ul", "ol", "dl", "table", "select"})
        classes = set(a.get("class", "").split())
        hidden = a.get("aria-hidden") == "true" or "hidden" in a or classes & set(HIDING) or any(classes.issuperset(bar) for bar in BARS)
        visible = (not self.open or self.open[-1].visible) and not hidden
        row = None
        if tag == "meta" and ("name" in a or "property" in a) and "content" in a:
            self.add("meta", name=f"name:{a['name']}" if "name" in a else f"property:{a['property']}", value=a["content"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.add("meta", name="canonical", value=a.get("href"))
        elif tag == "title" and not self.titled and not any(o.tag == "svg" for o in self.open):
            self.titled, row = True, self.add("meta", name="title")
        elif tag == "a" and "href" in a:
            row = self.add("link", value=a["href"], target="_blank" if a.get("target") == "_blank" else None, visible=visible, label=cleaned(a.get("aria-label", "")) or None, name=a.get("title") or None)
        elif tag == "form":
            key = a.get("name") or a.get("id") or a.get("data-form-type") or "unnamed"
            self.form = re.sub("[^A-Za-z0-9]+", "-", re.sub("^wf-form-Form-", "", key)).lower()
            self.add("form", form=self.form, value=a.get("action"), name=(a.get("method") or "get").upper(), visible=visible)
        elif tag in CONTROLS and self.form and (kind := a.get("type", "text").lower() if tag == "input" else tag) not in ("hidden", "submit", "button", "image", "reset"):
            row = self.add("field", form=self.form, name=a.get("name") or None, value=kind, required="required" in a, visible=visible, options=[] if tag == "select" else None)
            row["_"] = (a.get("id"), a.get("aria-label") or a.get("placeholder"), [o.row for o in self.open if o.tag == "label"])
        elif tag == "label":
            row = {"for": a.get("for"), "text": ""}
        elif tag == "option":
            select = next((o.row for o in reversed(self.open) if o.tag == "select"), None)
            row = {"of": select, "value": a.get("value")} if select else None
        if tag not in VOID:
            self.open.append(_Open(tag, visible, [] if row is not None else None))
            self.open[-1].row = row

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # the slash has no meaning in HTML

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].tag in ("script", "style"):
            return
        for o in self.open:
            if o.text is not None:
                o.text.append(data)

    def end_nearest(self, tags: set[str], walls: set[str]) -> None:
        """End the nearest of ``tags`` that is open, unless one of ``walls`` stands between."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                self.end_down_to(at)
                return
            if self.open[at].tag in walls:
                return

    def end_down_to(self, at: int) -> None:
        while len(self.open) > at:
            o = self.open.pop()
            if o.tag == "form":
                self.form = None
            if o.row is None or o.text is None:
                continue
            text = cleaned("".join(o.text))
            if o.tag == "title":
                o.row["value"] = text or None
            elif o.tag == "a":
                o.row["label"] = o.row["label"] or text or o.row["name"]
                o.row["name"] = None
            elif o.tag == "label":
                o.row["text"] = text
                if o.row["for"]:
                    self.labels.setdefault(o.row["for"], text)
            elif o.tag == "option" and o.row["of"]["options"] is not None:
                o.row["of"]["options"].append(f"{text if o.row['value'] is None else o.row['value']}={text}")

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), None)
        if at is not None:
            self.end_down_to(at)

    def rows(self) -> list[dict]:
        self.close()
        self.end_down_to(0)
        for row in self.found:
            if "_" in row:
                own, told, around = row.pop("_")
                row["label"] = self.labels.get(own or "") or next((x["text"] for x in around if x["text"]), None) or told
        for tag, n in sorted(self.counts.items()):
            self.add("tag", name=tag, value=str(n))
        return self.found


def contracts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each promise of each page, by ``kind``; the other columns are null where a kind has no use for them.

    ``meta``: name (``title``, ``canonical``, ``name:…``, ``property:…``), value. ``link``: value (href as written), target (``_blank`` or
    null), label (its aria-label, else its text, else its title), visible. ``form``: form (key), value (action), name (method).
    ``field``: form, name, value (type), required, label, options. ``tag``: name, value (count). Null and empty texts promise
    nothing; pages are told apart by their id, and repeated ids repeat rows. Unclosed and wrongly nested elements end where their
    parent does; further columns are left out.
    """
    target = to_arrow_schema(_parse_datatype_string(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part, out = b.slice(start, 256), []
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    parser = Contract()
                    parser.feed(html or "")
                    out += [row | {"page_id": page} for row in parser.rows()]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in COLUMNS} for r in out], schema=target)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, ROWS)


def links(contract: DataFrame, always: Collection[str] = ()) -> DataFrame:
    """``page_id, href, target, label`` of the links that a reader sees, each target once with its first label.

    Links in hidden parts and repeated bars are left out (but for the addresses in ``always``), and so are scripts and places on the page itself.
    """
    href = F.col("value")
    shown = F.col("visible") | href.isin(*always) if always else F.col("visible")
    rows = contract.filter((F.col("kind") == "link") & shown & ~F.lower(F.ltrim(href)).startswith("javascript:") & ~href.startswith("#"))
    return rows.groupBy("page_id", href.alias("href"), "target").agg(F.min_by("label", "pos").alias("label"))


def link_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """``page_id, href, target, side`` of links that only one of two sets has, by page, address and target."""
    both = source.select("page_id", "href", "target", F.lit(1).alias("s")).unionByName(target.select("page_id", "href", "target", F.lit(2).alias("s")))
    sides = both.groupBy("page_id", "href", "target").agg(F.bit_or("s").alias("sides"))
    return sides.filter("sides < 3").select("page_id", "href", "target", F.when(F.col("sides") == 1, "source-only").otherwise("target-only").alias("side"))
