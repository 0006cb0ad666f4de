"""Mixing documents to target token weights by soft domain membership.

A naive Bayes classifier, learned from the labelled table, gives each document a posterior over the domains.
A rate for each document, not below zero, is fitted so that the expected tokens of every domain,
``sum(rate * tokens * posterior)``, meet the targets in (weighted) least squares. The fit is an accelerated projected
gradient, run over the whole table: the gradient of a document's rate is its posterior times the residuals of
the domains, so a step needs just one number a domain from all documents together. The rates themselves are
never stored between steps: they follow from the residuals of the steps so far, and are worked out anew in
each pass over the posteriors.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, checkpointed, id_fold, table, utf8
from .wordstats import class_words, plain_words

log = logging.getLogger(__name__)
#: Labelled texts of each domain used at most.
SAMPLED = 3000
#: Words known to the classifier occur so often in the sample.
LEAST = 3
#: Target shares of the tokens by domain. Domains: toxic, else low or high quality by the labels.
TARGETS = {"high": 0.80, "low": 0.13, "toxic": 0.07}
#: A fit ends when the targets are met within ``TOLERANCE`` of all tokens, when the weighted squared residual changed by
#: less than the share ``SETTLED`` in a step, or after ``STEPS`` passes over the table; ``Fit.met`` tells the first.
STEPS, TOLERANCE, SETTLED = 60, 1e-4, 1e-5
#: Where rates have a lower bound above zero, the budget follows what is reached, up to ``MOST_BUDGET`` times the least one.
MOST_BUDGET = 8.0


class DomainModel:
    """Naive Bayes over words, softened: a text counts as ``evidence`` words at most."""

    def __init__(self, domains: list[str], counts: pa.Table, prior: np.ndarray, evidence: int = 40):
        self.domains, self.evidence = domains, evidence
        self.prior = np.log(prior)
        words = sorted({*counts.column("word").to_pylist()})
        self.places = {w: i for i, w in enumerate(words)}
        n = np.zeros((len(words) + 1, len(domains)))
        rows = [self.places[w] for w in counts.column("word").to_pylist()]
        cols = [domains.index(c) for c in counts.column("cls").to_pylist()]
        n[rows, cols] = counts.column("n").to_numpy()
        self.logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * (len(words) + 1)))
        self.logs[-1] = 0  # unknown words say nothing

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and posteriors of each text; a text without words has the prior."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        total = np.zeros((len(texts), len(self.domains)))
        get, unknown = self.places.get, len(self.places)
        for i, t in enumerate(texts):
            ids = [get(w, unknown) for w in plain_words(t)]
            sizes[i] = len(ids)
            if ids:
                total[i] = self.logs[ids].sum(axis=0) * min(1.0, self.evidence / len(ids))
        total += self.prior
        p = np.exp(total - total.max(axis=1, keepdims=True)) if len(texts) else total
        return sizes, p / p.sum(axis=1, keepdims=True) if len(texts) else p


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain. Of several rows of an id the most toxic, then the best quality holds."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return known.select("doc_id", named.alias("domain")).filter("domain is not null")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DomainModel:
    """From labelled texts of folds 1 to 4, at most ``SAMPLED`` of each domain. Without labels: the prior is even."""
    ids = docs.select("doc_id").filter(id_fold(F.col("doc_id"), 5) != 0).join(domain_labels(labels), "doc_id")
    share = {r["domain"]: r["n"] for r in ids.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sample = bounded_sample(ids, "doc_id", "domain", SAMPLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counts = class_words(rows, "domain").filter(F.col("cls").isin(domains) & (F.col("n") >= LEAST)).toArrow()
    prior = np.array([share.get(d, 0) + 1 for d in domains], dtype=float)
    return DomainModel(domains, counts, prior / prior.sum())


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, posterior`` (array, in the order of the model's domains) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sizes, p = shared.value.posteriors(utf8(b, "_text"))
            yield {"_id": b.column("_id"), "n_tokens": sizes, "posterior": p.round(6).tolist()}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow_map(rows, run, f"_id {kind}, n_tokens long, posterior array<double>").withColumnRenamed("_id", id_col)


def rates_after(posterior: np.ndarray, pulls: list[list[float]], floor: float = 0.0) -> np.ndarray:
    """Rates and look-ahead rates of the accelerated projected gradient after the given steps.

    ``pulls``: for each step the weighted domain residuals, and 1 where the momentum is dropped first, else 0. All
    rates start at one and are projected to ``floor`` or more.
    """
    rate = ahead = np.ones(len(posterior))
    t = 1.0
    for *pull, fresh in pulls:
        if fresh:
            ahead, t = rate, 1.0
        new = np.maximum(floor, ahead - posterior @ np.array(pull))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - rate)
        rate, t = new, t_new
    return np.column_stack([rate, ahead])


def _posterior(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


@dataclass
class Fit:
    """``pulls`` lead to the rates; ``met`` tells whether the totals they give reach the targets, or are just the nearest."""

    domains: list[str]
    pulls: list[list[float]]
    have: np.ndarray
    reached: np.ndarray
    target: np.ndarray
    met: bool

    def report(self, spark: SparkSession) -> DataFrame:
        """``domain, tokens, reached, target, met``, a row for each domain."""
        rows = [(d, *map(float, x), self.met) for d, *x in zip(self.domains, self.have, self.reached, self.target, strict=True)]
        return spark.createDataFrame(rows, "domain string, tokens double, reached double, target double, met boolean")


def fit_rates(members: DataFrame, targets: dict[str, float], floor: float = 0.0, steps: int = STEPS) -> Fit:
    """Rates of ``floor`` or more whose expected domain totals are nearest to the targets.

    The budget is the least for which no domain with a target has more tokens than that, so that targets are met by
    repeating documents and not by dropping them. With a floor above zero, where documents of several domains can't be
    turned down, each step takes the budget that is nearest to what is reached so far, if larger. A target of zero is no error: its domain's tokens are then
    pulled to zero as far as the floor lets them. A fit that ends short of its targets says so in ``met`` and in the log.
    """
    domains = sorted(targets)
    weights = np.array([targets[d] for d in domains], dtype=float)
    k = len(domains)
    if weights.min() < 0 or not weights.sum() > 0:
        raise ValueError("target weights must not be negative, nor all zero")

    def totals(pulls: list[list[float]]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            sums, curve = np.zeros((2, k)), np.zeros((k, k))
            for b in batches:
                p, n = _posterior(b, k), b.column("n_tokens").to_numpy()
                r = rates_after(p, pulls, floor)
                sums += (r * n[:, None]).T @ p
                curve += (p * n[:, None]).T @ p
            yield {"s": [np.concatenate([sums.ravel(), curve.ravel()]).tolist()]}

        parts = arrow_map(members, run, "s array<double>")
        flat = parts.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * k + k * k)]).first()
        return np.array([x or 0.0 for x in flat])

    first = totals([])
    have, curve = first[:k], first[2 * k :].reshape(k, k)
    w = weights / weights.sum()
    if not have.sum():
        return Fit(domains, [], have, have, np.zeros(k), True)
    least = target = w * (have[w > 0] / w[w > 0]).max()
    # The residuals are weighted by the inverse of the domains' second moments, and rates moved in the metric of
    # their tokens: there the least squares problem has a largest curvature of one, however alike the domains are.
    weight = np.linalg.inv(curve + 1e-9 * np.trace(curve) * np.eye(k))
    pulls: list[list[float]] = []
    now, ahead, before = have, have, np.inf
    for step in range(steps + 1):
        if floor > 0:
            target = max(target.sum(), float(w @ weight @ now / (w @ weight @ w))) * w
        met = bool(np.abs(now - target).max() <= TOLERANCE * target.sum())
        off = float((now - target) @ weight @ (now - target))
        if met or step == steps or abs(before - off) <= SETTLED * off or target.sum() > MOST_BUDGET * least.sum():
            break
        fresh, before = off > before, off
        pulls.append([*(weight @ ((now if fresh else ahead) - target)).tolist(), float(fresh)])
        got = totals(pulls)
        now, ahead = got[:k], got[k : 2 * k]
    if not met:
        log.warning("targets %s not met: totals %s after %d steps", dict(zip(domains, target.tolist(), strict=True)), now.tolist(), len(pulls))
    return Fit(domains, pulls, have, now, target, met)


def with_rates(members: DataFrame, pulls: list[list[float]], k: int, floor: float = 0.0) -> DataFrame:
    """``members`` with the column rate."""
    schema = f"{members.columns[0]} {members.dtypes[0][1]}, n_tokens long, posterior array<double>, rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rate = rates_after(_posterior(b, k), pulls, floor)[:, 0]
            yield {name: b.column(name) for name in b.schema.names} | {"rate": rate.round(6)}

    return arrow_map(members, run, schema)


def copies(rate: F.Column, doc_id: F.Column) -> F.Column:
    """How often a document is repeated: its rate's whole part, and once more for the share of ids left over."""
    spread = F.coalesce(F.crc32(F.concat(F.lit("copy"), doc_id.cast("string")).cast("binary")) % 1_000_000, F.lit(0)) / 1_000_000
    return (F.floor(rate) + (spread < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 0.0) -> tuple[DataFrame, Fit]:
    """doc_id, n_tokens, posterior, rate, copies for every row; and the fit, with the totals reached.

    Texts without words (null ones among them) have the prior as posterior and no weight in the fit. Repeated
    rows each get their own, equal, rate; a null id gets no copy beyond its rate's whole part by chance. Empty tables
    give no rows. Further columns are left out. Texts are read whole.
    """
    domains = sorted(targets)
    members = checkpointed(memberships(docs, fit_domains(docs, labels, domains), "doc_id"))
    fit = fit_rates(members, targets, floor)
    rated = with_rates(members, fit.pulls, len(domains), floor)
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), fit


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and number of copies of every document; ``met``: whether all domain totals meet their targets."""
    mixed, fit = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    domains = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(fit.domains)]
    return mixed.select("doc_id", "n_tokens", *domains, "rate", "copies", F.lit(fit.met).alias("met"))


#: Targets for documents that a toxicity filter has passed.
CLEAN_TARGETS = {"high": 0.80, "low": 0.20}


def repeat_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = CLEAN_TARGETS) -> DataFrame:
    """The documents, each as often as its rate says, with all columns.

    Here rates are one or more: targets are met by repeating documents, and none is lost. A row's rate follows
    from its text and the fitted steps, so the texts are read again but neither joined nor moved. Null and empty texts
    stay once or as often as the prior says; repeated rows are repeated each; an empty table stays empty.
    """
    domains = sorted(targets)
    model = fit_domains(docs, labels, domains)
    fit = fit_rates(checkpointed(memberships(docs, model, "doc_id")), targets, floor=1.0)
    shared = docs.sparkSession.sparkContext.broadcast((model, fit.pulls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, steps = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                _, p = fitted.posteriors(utf8(b, "text"))
                rate = rates_after(p.round(6), steps, 1.0)[:, 0].round(6)
                spread = np.array([0 if i is None else zlib.crc32(f"copy{i}".encode()) % 1_000_000 for i in b.column("doc_id").to_pylist()]) / 1_000_000
                times = np.floor(rate) + (spread < rate - np.floor(rate))
                yield b.take(pa.array(np.repeat(np.arange(b.num_rows), times.astype(int))))

    return docs.mapInArrow(run, docs.schema)
