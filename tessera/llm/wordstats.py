"""Counts of words by class, over labelled samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, utf8


def plain_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.lower().split()


def class_words(rows: DataFrame, class_col: str, text_col: str = "text", words: Callable[[bytes], list[bytes]] = plain_words) -> DataFrame:
    """``cls, word (binary), n``: how often each word stands in the texts of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found: Counter = Counter()
            for cls, text in zip(b.column("cls").to_pylist(), utf8(b, "text"), strict=True):
                found.update((cls, w) for w in words(text))
            yield {"cls": [c for c, _ in found], "word": [w for _, w in found], "n": list(found.values())}

    rows = rows.select(F.col(class_col).cast("string").alias("cls"), F.col(text_col).alias("text"))
    return arrow_map(rows, count, "cls string, word binary, n long").groupBy("cls", "word").agg(F.sum("n").alias("n"))


def class_pairs(rows: DataFrame, class_col: str, text_col: str = "text") -> DataFrame:
    """``cls, left, word, n`` for each word with the one before it; the first of a text follows the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found: Counter = Counter()
            for cls, text in zip(b.column("cls").to_pylist(), utf8(b, "text"), strict=True):
                w = plain_words(text)
                found.update((cls, x, y) for x, y in zip([b"", *w], w, strict=False))
            yield {"cls": [k[0] for k in found], "left": [k[1] for k in found], "word": [k[2] for k in found], "n": list(found.values())}

    rows = rows.select(F.col(class_col).cast("string").alias("cls"), F.col(text_col).alias("text"))
    return arrow_map(rows, count, "cls string, left binary, word binary, n long").groupBy("cls", "left", "word").agg(F.sum("n").alias("n"))
