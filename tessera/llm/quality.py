"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each text, and leaves a bit (set where the text fails it) and the measurement
it went by. Policies are versioned masks over the bits with a number of failures they bear, applied to the
ledger without reading the texts again; what each rule alone decides (ablation) is a bitwise aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

#: Measurements of a text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")
SYMBOLS = "#*$%&|<>"


def rules() -> dict[str, Column]:
    """Name and condition of failure, in the order of their bits; conditions use the measurements alone."""
    m = {name: F.col(name) for name in MEASURES}
    return {
        "few_words": m["n_words"] < 50,
        "many_words": m["n_words"] > 1_000_000,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 15 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "repeated_lines": (m["n_dup_lines"] > 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
        "few_letters": 100 * m["n_letters"] < 60 * m["word_chars"],
    }


@dataclass(frozen=True)
class Policy:
    """Texts that fail more than ``bears`` of the named rules go."""

    version: str
    rules: tuple[str, ...]
    bears: int = 0

    def mask(self) -> int:
        names = list(rules())
        return sum(1 << names.index(r) for r in self.rules)

    def keeps(self, bits: Column) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(self.mask()))) <= self.bears


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", tuple(["few_words", "many_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "few_letters"]))
LENIENT = Policy("v0", STRICT.rules, 1)


def measure(text: bytes) -> list[int]:
    """The measurements in the order of MEASURES; zeros for an empty text."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        # Words, pairs and windows as numbers, so that a very long text takes some bytes a word.
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        window = pair[:-1] * len(number) + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        if same.any():
            twice = np.zeros(n, dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            starts = twice.copy()
            twice[1:] |= starts[:-1]
            twice[2:] |= starts[:-2]
            repeated = int(twice.sum())
    chars = text.decode("utf-8", "replace")
    blank = sum(chars.count(c) for c in " \t\n\r\x0b\x0c")
    letters = sum(map(str.isalpha, chars))
    return [n, len(chars) - blank, sum(chars.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), letters]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``failed`` (bits), a row for each row.

    Null and empty texts have no words, so ``few_words`` fails. Very long texts are measured whole. Repeated rows and null
    ids keep a row each; an empty table gives none; further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [measure(t) for t in utf8(b, "_text")]
            yield {"_id": b.column("_id")} | {name: [r[i] for r in rows] for i, name in enumerate(MEASURES)}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = arrow_map(rows, run, f"_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(rules().values())), F.lit(0))
    return measured.withColumn("failed", bits.cast("long")).withColumnRenamed("_id", id_col)


def ablations(kept_ledger: DataFrame, policy: Policy) -> DataFrame:
    """``rule, n_failed, n_only``: texts that fail a rule of the policy, and those that would stay without that rule.

    One pass of bitwise aggregation over the ledger; one row a rule.
    """
    names = list(rules())
    held = F.col("failed").bitwiseAND(F.lit(policy.mask()))
    sums = []
    for r in policy.rules:
        bit = 1 << names.index(r)
        sums.append(F.sum((held.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f_{r}"))
        sums.append(F.sum(((F.bit_count(held) > policy.bears) & (F.bit_count(held.bitwiseAND(F.lit(~bit))) <= policy.bears)).cast("long")).alias(f"o_{r}"))
    one = kept_ledger.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("n_only")) for r in policy.rules])
    return one.select(F.inline(rows))


def op2_quality_rules(spark: SparkSession, sf_dir: str, policy: Policy = STRICT) -> DataFrame:
    """Measurements, failure bits and the verdicts of two policy versions for every document; ``kept`` is that of ``policy``."""
    kept = ledger(table(spark, sf_dir, "documents"))
    names = [m for m in MEASURES if m not in ("n_lines", "n_letters")]
    return kept.select("doc_id", *names, (~BASE.keeps(F.col("failed"))).alias("base_failed"), (BASE.keeps(F.col("failed")) & policy.keeps(F.col("failed"))).alias("kept"), "n_lines", "n_letters", "failed",
        F.lit(policy.version).alias("policy"), LENIENT.keeps(F.col("failed")).alias(f"kept_{LENIENT.version}"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP2_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS h, w[i : i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines, length(regexp_replace(text, '\PL', '', 'g'))::BIGINT AS n_letters
  FROM t LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (n_words > 1000000)::INT + 4 * (100 * n_repeat_words > 50 * n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
    + 16 * (word_chars > 15 * n_words)::INT + 32 * (10 * n_symbols > n_words)::INT + 64 * (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines)::INT
    + 128 * (100 * n_letters < 60 * word_chars)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 5) <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_letters, failed, 'v1' AS policy, bit_count(failed) <= 1 AS kept_v0 FROM f
"""
