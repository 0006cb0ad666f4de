"""Secret scans: three fixed patterns, and dictionary-primed zstandard novelty for what they miss.

A candidate is a token of 20 or more characters with a digit and a letter, in a sensitive context: a word such
as ``auth`` or ``credential`` within the characters before or after it, or right behind a candidate in such a context,
with only dots, quotes or line breaks between (the lines of a key, the parts of a bearer token). Its novelty is what it
adds to a zstandard frame: the bytes of its surroundings on both sides and the candidate less those of the surroundings
alone, both compressed with a dictionary of identifiers, which are the commonest words of the whole table and a list of
names that code shares. Paths, identifiers and repeated tokens compress well; random strings don't, and those that add
more than ``NOVELTY`` bytes a character are reported with the kind ``novel``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

#: Fixed patterns of the contract, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of a greedy run of these characters, the same as matching all and dropping short ones
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CONTEXT = re.compile(r"auth|bearer|cred|private|signature|session|cookie|login|account|license[_-]?key|access|certificate|pwd|key|salt", re.IGNORECASE | re.ASCII)
#: Characters of the surroundings on each side; bytes a character from which a candidate is novel, and from which one
#: right behind a reported one is (a random neighbour of the same letters makes it cheaper).
SIDE, NOVELTY, NOVELTY_BEHIND = 80, 0.72, 0.6
#: Words of the table in the dictionary, and their form: too short and too plain to be secrets.
LEARNED, PLAIN = 4000, re.compile(rb"[A-Za-z_]{4,19}")
#: What may stand between adjacent candidates; a backslash is that of an escaped line break.
GAP = re.compile(r"""(?:[."'`\\]|\x20*[\r\n][\x20\t]*)+""")
#: The short last part behind a reported one: padded, or before the end line.
TAIL = re.compile(GAP.pattern + r"""([A-Za-z0-9+/_-]{1,19}(?:={1,2}(?![A-Za-z0-9+/_=-])|(?=["'`\\\s]+n?-----END)))""")


#: Names that code and configuration share.
NAMES = """
abstract argument array assert async await boolean break bytes callback case catch char class client column config const
constructor content context continue count create database date debug decode default define delete dict double elif else
encode endpoint enum environment error event except exception export extends false field file final finally float folder
format frame from function global handler hash header host image implements import index input insert instance integer
interface item json key lambda length line list load local logger long main method model module name namespace native node
null number object offset option order output package page param parent parse password path pattern payload port print
private property protected public query queue raise range read record release remove request require reset response result
return route schema scope script select self send server service session set setting short size sort source start state
static status step stop store stream string struct style super switch table tag target task template test text this thread
throw time timeout title token total trace transaction true tuple type undefined union update upload user util value var
version view void volatile where while width window with write yield
""".split()
FRAGMENTS = "https://www.example.com/ http:// localhost 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ user_id content-type application/json charset=utf-8 authorization bearer session_id access_key private_key client_id username self.assert"


def common_words(docs: DataFrame, text_col: str = "text", most: int = LEARNED) -> list[str]:
    """The ``most`` words of a plain form that occur most often in the whole table, the commonest last; ties by name.

    Counted by a partial aggregation; only the result, of bounded size, goes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: Counter = Counter()
        for b in batches:
            for t in utf8(b, "text"):
                found.update(t.split())
            if len(found) > 200_000:
                yield plain(found)
                found = Counter()
        yield plain(found)

    def plain(found: Counter) -> dict:
        kept = [w for w in found if PLAIN.fullmatch(w)]
        return {"word": [w.decode() for w in kept], "n": [found[w] for w in kept]}

    counts = arrow_map(docs.select(F.col(text_col).alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()][::-1]


@lru_cache(4)
def compressor(learned: str) -> zstandard.ZstdCompressor:
    """With a dictionary of the learned words (joined by spaces) and the shared names, the likeliest last."""
    content = " ".join([learned, *NAMES, FRAGMENTS]).encode()
    primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(around: str, candidate: str, learned: str = "") -> float:
    """Bytes that the candidate adds to its surroundings, for each of its characters."""
    press = compressor(learned).compress
    known = around.encode()
    return (len(press(known + candidate.encode())) - len(press(known))) / len(candidate)


def secret_spans(text: str, learned: str = "") -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of all spans in code points, in order; the fixed patterns' spans stay whole."""
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # In order of their ends, which are in order of their starts too within a kind.
    fixed = [[x for x in spans if x[1] == k] for k in range(3)]
    passed = [0, 0, 0]
    # The end of the last candidate in a sensitive context, and whether it was reported.
    last, reported = -1, False
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        token = m.group()
        carried = last >= 0 and GAP.fullmatch(text, last, start) is not None
        mixed = any(c.isdigit() for c in token) or (carried and reported and token != token.lower() and token != token.upper())
        if not (mixed and any(c.isalpha() for c in token)):
            continue
        before, after = text[max(0, start - SIDE) : start], text[end : end + SIDE]
        if not (carried or CONTEXT.search(before) or CONTEXT.search(after)):
            continue
        covered = False
        for k, held in enumerate(fixed):
            while passed[k] < len(held) and held[passed[k]][2] <= start:
                passed[k] += 1
            if passed[k] < len(held):
                a, _, b = held[passed[k]]
                # What is before an assignment's key is the rest of its name.
                covered |= a < end and (k == 0 or (a <= start and end <= b))
        last, reported = end, covered or novelty(before + after, token, learned) > (NOVELTY_BEHIND if carried and reported else NOVELTY)
        if not reported or covered:
            continue
        spans.append((start, 3, end))
        if tail := TAIL.match(text, end):
            spans.append((tail.start(1), 3, tail.end(1)))
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans`` (``kind:start:end``, comma-joined) and counts by kind, for every row.

    Null and empty texts have none. Spans of different kinds may overlap; those at one place are in the order of KINDS.
    Texts are read whole, each candidate once. Repeated rows and null ids keep a row each; an empty table gives none;
    further columns are left out.
    """
    learned = " ".join(common_words(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [secret_spans(t or "", learned) for t in b.column("_text").to_pylist()]
            yield {
                "_id": b.column("_id"), "base": [joined([s for s in x if s[1] < 3]) for x in found], "spans": [joined(x) for x in found],
                **{f"n_{kind}": [sum(s[1] == k for s in x) for x in found] for k, kind in enumerate(KINDS)},
            }

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(rows, run, f"_id {kind}, base string, spans string, {counts}").withColumnRenamed("_id", id_col)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_novel")


def redact(text: str, learned: str = "") -> str:
    """The text with each span (overlapping ones as one) replaced by ``[kind]``; the key of an assignment stays."""
    out, at = [], 0
    for start, k, end in secret_spans(text, learned):
        if end <= at:
            continue
        if k == 0 and start >= at:
            start = ASSIGN.match(text, start).start(2)
        out += [text[at : max(at, start)], f"[{KINDS[k]}]" if start >= at else ""]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the texts replaced; ``n_chars``, where it is there, is set anew. Null texts stay null, repeated rows stay."""
    learned = " ".join(common_words(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            clean = [None if t is None else redact(t, learned) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(clean, b.schema.field(at).type)
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                columns[n] = pa.array([None if t is None else len(t) for t in clean], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
