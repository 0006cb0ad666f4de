"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of words: its discounted counts, and for the rest of the mass the shared backoff, the Kneser-Ney continuation probability (in how
many different contexts a word follows, over both classes). Every word counts, those met once too: most of their
probability is the backoff's, which both classes share. The discounts of counts 1, 2 and 3+ are estimated from the counts
of counts. A text is compared by its length-normalised log-likelihood ratio, over the whole, over its best windows of 1,
4, 16 and 64 words, by the next best words, and by the shares of words whose ratio passes 1, 2, 3 and 4, so that a toxic
passage of a long text is not thinned out. A logistic curve over these figures, fitted on labelled texts that the models
have not counted, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, id_fold, table, utf8
from .wordstats import class_pairs, plain_words

#: Labelled texts used of each class: to count words, and to fit the curve.
COUNTED, CURVE = 6000, 6000
WINDOWS = (1, 4, 16, 64)
#: Log-likelihood ratios from which words are counted.
STEPS = (1, 2, 3, 4)
#: Weight of the penalty on the curve's squared weights.
RIDGE = 0.5
#: Figures of a text.
WIDTH = 1 + len(WINDOWS) + 2 + len(STEPS) + 1


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discount of a count of 0, 1, 2 and of 3 or more, from how many words have 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


class KneserNeyPair:
    """Log-likelihood ratios of words, and the curve over a text's figures.

    Words are known by their XXH64 (seed 42), sorted: 16 bytes a word, whatever its length. ``toxic`` and ``other`` are
    its counts in the classes, ``contexts`` the different words that it follows.
    """

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, other: np.ndarray, contexts: np.ndarray):
        shared = (contexts + 0.5) / (contexts.sum() + 0.5 * (len(keys) + 1))
        unseen = 0.5 / (contexts.sum() + 0.5 * (len(keys) + 1))
        logs, log_unseen = [], []
        for n in (toxic, other):
            d = discounts(n)[np.minimum(n, 3)]
            total = max(1, n.sum())
            rest = max(d.sum(), 1e-9) / total
            logs.append(np.log((n - d) / total + rest * shared))
            log_unseen.append(np.log(rest * unseen))
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], (logs[0] - logs[1])[order]
        self.unseen = float(log_unseen[0] - log_unseen[1])
        self.mean = self.spread = self.weights = np.zeros(0)

    def ratios(self, text: bytes) -> np.ndarray:
        """The log-likelihood ratio of each word of a text."""
        words, of = plain_words(text), xxhash.xxh64_intdigest
        h = np.fromiter((of(w, 42) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ratio[at], self.unseen)

    def figures(self, text: bytes) -> list[float]:
        """Zeros for a text without words."""
        r = self.ratios(text)
        if not len(r):
            return [0.0] * WIDTH
        total = np.concatenate([[0.0], r.cumsum()])
        windows = [(total[k:] - total[:-k]).max() / k if len(r) > k else r.mean() for k in WINDOWS]
        top = np.sort(np.partition(r, -min(3, len(r)))[-3:])[::-1].tolist() + [0.0, 0.0]
        return [r.mean(), *windows, top[1], top[2], *(100 * (r > s).mean() for s in STEPS), np.log(len(r) + 1)]

    def fit_curve(self, x: np.ndarray, labels: np.ndarray, odds: float = 1.0) -> None:
        """``x``: the figures of the curve's texts; ``odds``: the sampling rate of toxic texts over that of others, by which the intercept is corrected."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(25):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
            w -= np.linalg.solve(curve, z.T @ (p - labels) + RIDGE * w)
        w[-1] -= np.log(odds)
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = (np.array([self.figures(t) for t in texts]) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of the labelled documents of folds 1 to 4; of several labels of an id the largest holds."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.select("doc_id", "text").filter(id_fold(F.col("doc_id"), 5) != 0).join(known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> KneserNeyPair | float:
    """The models, from bounded samples of the labelled rows (``COUNTED`` and ``CURVE``).

    Fold 1 of five fits the curve, folds 2 to 4 are counted (equal texts of a class once), fold 0 is held out. Both are
    sampled by class, so that rare rows are not thinned out. A class with rows in only one of the two parts has them
    in both. Only without rows of both classes, or without words of both, there is no model but the share of the label.
    """
    known = labelled(docs, labels, label)
    fold = id_fold(F.col("doc_id"), 5)
    ids = known.select("doc_id", "label", F.coalesce(F.col("label") == 1, F.lit(False)).alias("toxic"), (fold == 1).alias("curve"))
    n = {(r["toxic"], r["curve"]): r["n"] for r in ids.groupBy("toxic", "curve").agg(F.count("*").alias("n")).collect()}
    of_curve = {t: n.get((t, True), 0) for t in (True, False)}
    share = of_curve[True] / max(1, sum(of_curve.values()))
    if len({t for t, _ in n}) < 2:
        return share
    both = F.col("toxic").isin([t for t in of_curve if ((t, True) in n) != ((t, False) in n)])
    rate = {t: min(1.0, CURVE / (of_curve[t] or n[t, False])) for t in of_curve}
    counted = bounded_sample(ids.filter(~F.col("curve") | both), "doc_id", "label", COUNTED).select("doc_id", "label")
    curve = bounded_sample(ids.filter(F.col("curve") | both), "doc_id", "toxic", CURVE).select("doc_id", "label")
    # Both id samples are bounded by their parameters, so they may be broadcast to the texts.
    texts = lambda sample: docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    once = texts(counted).groupBy("label", F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"))
    pairs = class_pairs(once, "label")
    words = pairs.groupBy("word").agg(
        F.sum(F.when(F.col("cls") == "1", F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("cls") != "1", F.col("n")).otherwise(0)).alias("other"),
        F.count_distinct("left").alias("contexts"),
    ).select(F.xxhash64("word").alias("key"), "toxic", "other", "contexts").toArrow()
    keys, toxic, other, contexts = (words.column(c).to_numpy() for c in ("key", "toxic", "other", "contexts"))
    if not (toxic.sum() and other.sum()):
        return share
    model = KneserNeyPair(keys.view(np.uint64), toxic, other, contexts)
    x, y = curve_figures(texts(curve), model)
    if not 0 < y.sum() < len(y):
        return share
    model.fit_curve(x, y, rate[True] / rate[False])
    return model


def curve_figures(rows: DataFrame, model: KneserNeyPair) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels (1 or 0) of ``rows(text, label)``; texts are read in tasks, and only their figures come back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"x": [shared.value.figures(t) for t in utf8(b, "text")], "y": [float(v == 1) for v in b.column("label").to_pylist()]}

    held = arrow_map(rows.select("text", "label"), run, "x array<double>, y double").toArrow()
    shared.unpersist()
    return np.array(held.column("x").to_pylist()).reshape(-1, WIDTH), held.column("y").to_numpy()


def score_toxicity(docs: DataFrame, model: KneserNeyPair | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row, repeated ones and null ids too; an empty table gives none, further columns are left out.

    Null texts count as empty; texts without words get the curve's value at zero. Texts are read whole, however long;
    equal texts have equal scores. The model's size is bounded by its sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            score = np.full(b.num_rows, m) if isinstance(m, float) else m.score(utf8(b, "_text"))
            yield {"_id": b.column("_id"), "score": score}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under a half, with all columns; each row, repeated or without an id, is judged by its own text (null as empty), and an empty table stays one."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            keep = np.full(b.num_rows, m < 0.5) if isinstance(m, float) else m.score(utf8(b, "text")) < 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
