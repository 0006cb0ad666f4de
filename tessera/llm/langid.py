"""Language identification by words first, character n-grams for words not known.

The words of labelled texts give each language a table of log frequencies. A word met in training is scored by
them. Any other word is scored by its characters: at each place the longest n-gram known there (four
characters, else three, two, one) gives its log frequency among the n-grams of that length; the mean over the
places is the word's score. A text gets the language with the highest sum.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, id_fold, table
from .wordstats import class_words

#: Labelled texts of each language used at most.
SAMPLED = 3000
#: A word or n-gram counts as known from so many occurrences on.
LEAST = 3
LONGEST = 4
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000


def letter_words(text: bytes) -> list[bytes]:
    return [w.encode() for w in LETTERS.findall(text.decode("utf-8", "replace").lower())]


def grams(word: str) -> Iterator[str]:
    marked = f"_{word}_"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def log_frequencies(counts: pa.Table, key: str, langs: list[str], by_length: bool = False) -> tuple[dict[str, int], np.ndarray]:
    """Row of each key, and rows of log frequencies by language, add-a-half smoothed; ``counts`` has ``key, cls, n``.

    ``by_length``: frequencies among the keys of the same length.
    """
    rows: dict[str, int] = {}
    at = [rows.setdefault(k, len(rows)) for k in counts.column(key).to_pylist()]
    n = np.zeros((len(rows), len(langs)))
    place = {c: i for i, c in enumerate(langs)}
    n[at, [place[c] for c in counts.column("cls").to_pylist()]] = counts.column("n").to_numpy()
    size = np.array([len(k) if by_length else 0 for k in rows], dtype=np.int64)
    total, kinds = np.zeros((size.max(initial=0) + 1, len(langs))), np.bincount(size, minlength=1)
    np.add.at(total, size, n)
    return rows, np.log((n + 0.5) / (total[size] + 0.5 * kinds[size][:, None]))


class LanguageModel:
    def __init__(self, langs: list[str], words: tuple[dict[str, int], np.ndarray], gram_table: tuple[dict[str, int], np.ndarray]):
        self.langs = langs
        self.known, known_logs = words
        self.grams, self.gram_logs = gram_table
        self.n_known = len(self.known)
        #: Rows of the known words, then of unseen words met lately.
        self.logs = np.vstack([known_logs, np.zeros((REMEMBERED, len(langs)))])

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word by its n-grams; all zero if not even a character is known."""
        marked, get, ids = f"_{word}_", self.grams.get, []
        for i in range(len(marked)):
            for n in range(min(LONGEST, len(marked) - i), 0, -1):
                if (found := get(marked[i : i + n])) is not None:
                    ids.append(found)
                    break
        return self.gram_logs[ids].mean(axis=0) if ids else np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        """The row of a word not known, worked out."""
        at = len(self.known)
        self.logs[at] = self.unseen(word)
        self.known[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; ``und`` with 0 for a null text or one without letters. Ties: first by name."""
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs or not any(ch.isalpha() for w in words for ch in w):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        get, row = self.known.get, self.row
        for at in range(0, len(words), 5000):
            if len(self.known) + 5000 > len(self.logs):  # the rows for unseen words are used anew
                for w in list(self.known)[self.n_known :]:
                    del self.known[w]
            ids = [i if (i := get(w)) is not None else row(w) for w in words[at : at + 5000]]
            total += self.logs[ids].sum(axis=0)
        # Twenty words are as much evidence as any number, or every long text would score one.
        evidence = (total - total.max()) / max(1, len(words) / 20)
        p = np.exp(evidence) / np.exp(evidence).sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """From the rows with a language of folds 1 to 4, up to ``SAMPLED`` of each language (equal texts once).

    Null texts count as empty and teach nothing; without a labelled row the model knows no language.
    """
    rows = docs.select("doc_id", F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & (id_fold(F.col("doc_id"), 5) != 0))
    sample = bounded_sample(rows, "doc_id", "lang", SAMPLED)
    sample = sample.groupBy("lang", F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"))
    counts = class_words(sample, "lang", words=letter_words).withColumn("word", F.col("word").cast("string"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found: Counter = Counter()
            for cls, w, n in zip(*(b.column(c).to_pylist() for c in ("cls", "word", "n")), strict=True):
                for g in grams(w):
                    found[cls, g] += n
            yield {"cls": [k[0] for k in found], "gram": [k[1] for k in found], "n": list(found.values())}

    spelled = arrow_map(counts, spell, "cls string, gram string, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).toArrow()
    frequent = counts.filter(F.col("n") >= LEAST).toArrow()
    langs = sorted(set(spelled.column("cls").to_pylist()) | set(frequent.column("cls").to_pylist()))
    return LanguageModel(langs, log_frequencies(frequent, "word", langs), log_frequencies(spelled, "gram", langs, True))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row. The model's size is bounded by its sample.

    Null and empty texts, those without a letter and all texts of a model without languages give ``und`` and 0. A text is
    read whole, however long, 5,000 words at a time. Repeated rows get equal results each; an empty table gives no rows;
    further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column("_text").to_pylist()]
            yield {"_id": b.column("_id"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow_map(rows, run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit(docs))
    return found.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
