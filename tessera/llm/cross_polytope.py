"""Approximate nearest neighbours by largest inner product, with cross-polytope hashing.

A vector x of norm band b (norms within a factor of two; M is the band's largest) becomes the unit vector
(x, sqrt(M² - |x|²)) / M, a query (q, 0) / |q|: within a band their inner product orders rows as q·x does. A hash function
is three rounds of random signs and the fast Hadamard transform, and the nearest signed axis of what comes out; a table's
bucket is the axes of one or two functions, the last of which may use fewer axes. A query probes a table's buckets in the order
of the squares of what its own coordinates lack to the best axis.

How many functions, axes, tables and probes is fitted on a bounded sample of queries whose exact neighbours one pass over all
rows finds: for each layout the share ``RECALL`` of all true pairs must lie within the probes, and the layout that
compares least is taken. Every row is indexed in every table, and every row of a probed bucket is compared: buckets too
large for one task are cut into blocks and their queries into turns, nothing is left out. Scores are exact; a query
that found fewer than k rows is searched once more in all buckets of one table, which together hold all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import FINE, arrow_map, checkpointed, table

#: Queries that the layout is fitted on, the share of their neighbours that must lie within the probes, tables tried, and buckets of a table.
FITTED, RECALL, TABLES, BUCKETS = 128, 0.95, (1, 2, 4, 8), 65_536
#: Bytes of vectors that meet in a task, queries that do, and scores held at a time.
HELD, ASKED, SCORES = 8 << 20, 4096, 4 << 20
#: What rounding may change in an inner product, as a share of both lengths.
SLACK = 1e-12
#: Components past this can't be squared in doubles.
HUGE = 1e150


def usable(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """``id, vec``: vectors as bytes of floats of ``kind`` without trailing zeros, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("vec"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0
                if x.any() and np.isfinite(x).all():
                    if float(np.abs(x).max()) > HUGE:
                        raise OverflowError(f"the components of vector {i} are too large to be squared")
                    ids.append(i)
                    vecs.append(np.trim_zeros(x, "b").tobytes())
            yield {"id": ids, "vec": vecs}

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), run, "id long, vec binary")


def matrix(vecs: list[bytes], width: int, kind: str) -> np.ndarray:
    """Rows of doubles padded with zeros."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, dtype=kind)
        out[i, : len(x)] = x
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, of very small ones too."""
    most = np.abs(x).max(axis=1, initial=0)
    most[most == 0] = 1
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def bands_of(norm: np.ndarray) -> np.ndarray:
    return np.round(np.log2(norm)).astype(int)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hashes:
    """The rotations, the same in every task as they follow from their numbers alone."""

    def __init__(self, width: int):
        self.width = width
        self.d = 1 << max(1, width).bit_length()  # room for one coordinate more

    def axes(self, x: np.ndarray, fn: int, used: int) -> np.ndarray:
        """What each of the 2 * ``used`` signed axes has of each row after rotation ``fn``."""
        signs = np.random.default_rng([7, fn]).integers(0, 2, (3, self.d)) * 2.0 - 1
        for s in signs:
            x = hadamard(x * s)
        return np.concatenate((x[:, :used], -x[:, :used]), axis=1)

    def points(self, x: np.ndarray, tops: dict[int, float]) -> np.ndarray:
        norm, band = norms(x), bands_of(norms(x))
        top = np.array([tops[b] for b in band.tolist()])
        out = np.zeros((len(x), self.d))
        out[:, : self.width] = x / top[:, None]
        out[:, self.width] = np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
        return out

    def asked(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), self.d))
        out[:, : self.width] = q / norms(q)[:, None]
        return out

    def codes(self, points: np.ndarray, t: int, layout: tuple[int, ...]) -> np.ndarray:
        """The bucket of each row in table ``t``."""
        code = np.zeros(len(points), dtype=np.int64)
        for j, used in enumerate(layout):
            code = code * (2 * used) + self.axes(points, 2 * t + j, used).argmax(axis=1)
        return code

    def losses(self, asked: np.ndarray, t: int, layout: tuple[int, ...]) -> np.ndarray:
        """A row for each query: what each bucket of table ``t`` lacks to its best."""
        out = np.zeros((len(asked), 1))
        for j, used in enumerate(layout):
            own = self.axes(asked, 2 * t + j, used)
            out = (out[:, :, None] + ((own.max(axis=1, keepdims=True) - own) ** 2)[:, None, :]).reshape(len(asked), -1)
        return out


def layouts(d: int, n: int) -> list[tuple[int, ...]]:
    """Axes of each function: one function, or all axes and one more; buckets that hold some hundred rows at least."""
    most = min(BUCKETS, max(2, n // 64))
    powers = [1 << i for i in range(d.bit_length())]
    return [x for x in [(p,) for p in powers] + [(d, p) for p in powers] if 2 <= np.prod([2 * y for y in x]) <= most] or [(1,)]


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first component to the last whatever rows there are."""
    return reduce(lambda s, j: s + a[:, j] * b[:, j], range(a.shape[1]), np.zeros(len(a)))


def best_of(q: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of rows that may be among a query's k best of ``rows``, and their rounded scores; widened against rounding."""
    found = []
    few = max(1, SCORES // len(rows))
    size = norms(x[rows]).max()
    for at in range(0, len(q), few):
        part = q[at : at + few]
        s = part @ x[rows].T
        least = np.full(len(part), -np.inf) if len(rows) <= k else np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k] - SLACK * norms(part) * size
        i, j = np.nonzero(s >= least[:, None])
        found.append((i + at, rows[j], s[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def still_best(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of several tables and blocks, each once, that may be among a query's k best of them all."""
    order = np.lexsort((j, i))
    i, j, s = i[order], j[order], s[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[new], j[new], s[new]
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.searchsorted(i, i)
    last = np.minimum(first + k, np.searchsorted(i, i, side="right")) - 1
    keep = s >= s[last] - SLACK * norms(q)[i] * norms(x).max()
    return i[keep], j[keep]


def ranked(q: np.ndarray, q_ids: list[int], x: np.ndarray, ids: list[list[int]], i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query id, id, score)`` of the k best of each query among the pairs (i, j), exact, without the query's own rows."""
    if not len(i):
        return []
    pairs = np.stack((i, j))
    best: dict[int, list[tuple[float, int]]] = {}
    for at in range(0, pairs.shape[1], SCORES // 64):
        a, b = pairs[:, at : at + SCORES // 64]
        for n, m, s in zip(a.tolist(), b.tolist(), fold(q[a], x[b]).tolist(), strict=True):
            best.setdefault(n, []).extend((-s, c) for c in ids[m] if c != q_ids[n])
    return [(q_ids[n], c, -s) for n, found in best.items() for s, c in sorted(found)[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: the k rows of largest inner product that were found for each query, nearest first.

    Rows with the query's own id are no candidates; ties go to the smaller id, and the same id with the same vector counts once. All candidates
    are returned where there are no more than k. Null ids, vectors that are null, zero or hold a null or non-finite component take no
    part; shorter vectors are padded with zeros. A component past 1e150 is an error. An empty table gives no rows; further columns
    are left out, whatever their names.
    """
    single = all(isinstance(t := df.schema[vec_col].dataType, ArrayType) and isinstance(t.elementType, FloatType) for df in (vectors, queries))
    kind = "<f4" if single else "<f8"
    size_of = np.dtype(kind).itemsize
    # Equal vectors are one, with the smallest ids: k + 1 are enough for any query.
    first = Window.partitionBy("vec").orderBy("id")
    merged = usable(vectors, id_col, vec_col, kind).distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    merged = checkpointed(merged.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = checkpointed(usable(queries, id_col, vec_col, kind).distinct())
    n, longest = merged.agg(F.count("*"), F.max(F.length("vec"))).first()
    n_asked, asked_longest = asked.agg(F.count("*"), F.max(F.length("vec"))).first()
    width = max(1, (longest or 0) // size_of, (asked_longest or 0) // size_of)
    hashes = Hashes(width)
    if not n or not n_asked:
        return merged.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")

    # Fitting: norms of the bands (a row for each power of two), then true neighbours of a bounded sample.
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                norm = norms(matrix(b.column("vec").to_pylist(), width, kind))
                band = bands_of(norm)
                own = np.unique(band)
                yield {"band": own, "top": [norm[band == x].max() for x in own]}

    tops = dict(arrow_map(merged, measured, "band int, top double").groupBy("band").agg(F.max("top")).collect())
    bands = sorted(tops)
    share = F.pmod(F.xxhash64("vec", F.lit("fit")), F.lit(FINE))
    sample = asked.filter(share <= int(FINE * min(1.0, FITTED / n_asked))).orderBy(share).limit(2 * FITTED).collect()
    fit_ids, fit = [r["id"] for r in sample], matrix([bytes(r["vec"]) for r in sample], width, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vecs, ids = part.column("vec").to_pylist(), part.column("ids").to_pylist()
                x = matrix(vecs, width, kind)
                i, j, _ = best_of(fit, x, np.arange(len(x)), k + 1)
                keep = [(a, c) for a, c in zip(i.tolist(), j.tolist(), strict=True) if ids[c] != [fit_ids[a]]]
                yield {"q": [a for a, _ in keep], "vec": [vecs[c] for _, c in keep], "score": fold(fit[[a for a, _ in keep]], x[[c for _, c in keep]])}

    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec")
    true = arrow_map(merged, scan, "q int, vec binary, score double").withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k).select("q", "vec").collect()
    near, near_of = matrix([bytes(r["vec"]) for r in true], width, kind), np.array([r["q"] for r in true], dtype=int)
    fit_points, near_points = hashes.asked(fit), hashes.points(near, tops) if len(near) else np.zeros((0, hashes.d))
    choices = []
    for layout in layouts(hashes.d, n):
        ranks = np.zeros((max(TABLES), len(near)), dtype=int)
        for t in range(max(TABLES)):
            order = np.sort(loss := hashes.losses(fit_points, t, layout), axis=1)
            code = hashes.codes(near_points, t, layout)
            for i in range(len(fit)):
                ranks[t, near_of == i] = np.searchsorted(order[i], loss[i, code[near_of == i]])
        buckets = int(np.prod([2 * y for y in layout]))
        for tables in TABLES:
            lie = ranks[:tables].min(axis=0)
            probes = int(np.quantile(lie, RECALL)) + 1 if len(lie) else 1
            # Rows compared, and what a probe and an index row cost beside them.
            choices.append((n_asked * tables * probes * (n / buckets + 64 * len(bands)) + 1000 * tables * n, tables, probes, layout))
    _, tables, probes, layout = min(choices)
    buckets = int(np.prod([2 * y for y in layout]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column("vec").to_pylist(), width, kind)
                points, band = hashes.points(x, tops), np.searchsorted(bands, bands_of(norms(x)))
                for t in range(tables):
                    yield {"t": np.full(len(x), t, np.int32), "code": band * buckets + hashes.codes(points, t, layout), "vec": part.column("vec"), "ids": part.column("ids")}

    index = arrow_map(merged, place, "t int, code long, vec binary, ids array<long>")
    sizes = checkpointed(index.groupBy("t", "code").agg(F.sum(F.length("vec").cast("long") + 8).alias("bytes")))
    partitions = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n * tables * width * size_of // HELD), min(partitions, n * tables // 1024))

    def look(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if asked.num_rows and held.num_rows:
            vecs = held.column("vec").combine_chunks().dictionary_encode()
            x, number = matrix(vecs.dictionary.to_pylist(), width, kind), vecs.indices.to_numpy()
            ids: list[list[int]] = [[]] * len(x)
            for a, i in zip(number.tolist(), held.column("ids").to_pylist(), strict=True):
                ids[a] = i
            unit = held.column("unit").to_numpy()
            order = np.argsort(unit, kind="stable")
            names, starts = np.unique(unit[order], return_index=True)
            rows = dict(zip(names.tolist(), np.split(number[order], starts[1:]), strict=True))
            q, q_ids = matrix(asked.column("vec").to_pylist(), width, kind), asked.column("id").to_pylist()
            wants: dict[int, list[int]] = {}
            for a, units in enumerate(asked.column("units").to_pylist()):
                for u in units:
                    wants.setdefault(u, []).append(a)
            for at in range(0, len(q), ASKED):
                pairs = []
                for u, who in wants.items():
                    who = np.array([a for a in who if at <= a < at + ASKED], dtype=int)
                    if u in rows and len(who):
                        i, j, s = best_of(q[who], x, np.unique(rows[u]), k + 1)
                        pairs.append((who[i], j, s))
                if pairs:
                    found += ranked(q, q_ids, x, ids, *still_best(q, x, *(np.concatenate(c) for c in zip(*pairs, strict=True)), k + 1), k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "found": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    def search(who: DataFrame, tables: int, probes: int) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            few = max(1, SCORES // (buckets * 8))
            for b in batches:
                for at in range(0, b.num_rows, few):
                    part = b.slice(at, few)
                    q = hashes.asked(matrix(part.column("vec").to_pylist(), width, kind))
                    for t in range(tables):
                        codes = np.argsort(hashes.losses(q, t, layout), axis=1, kind="stable")[:, :probes]
                        for band in range(len(bands)):
                            yield {"id": np.repeat(part.column("id").to_numpy(), codes.shape[1]), "t": np.full(codes.size, t, np.int32), "code": band * buckets + codes.ravel()}

        sent = arrow_map(who, probe, "id long, t int, code long").distinct()
        met = sent.groupBy("t", "code").agg(F.count("*").alias("n_asked")).join(sizes, ["t", "code"])
        met = checkpointed(met.select("t", "code", F.ceil(F.col("bytes") / HELD).cast("int").alias("blocks"), F.ceil(F.col("n_asked") / ASKED).cast("int").alias("turns")))
        unit = F.xxhash64("t", "code", "block", "turn")
        shard = F.pmod(F.col("unit"), F.lit(shards)).cast("int")
        to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = index.join(met, ["t", "code"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")).withColumn("turn", to("turns"))
        held = held.withColumn("unit", unit).select(shard.alias("shard"), "unit", "vec", "ids")
        sent = sent.join(met, ["t", "code"]).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int")).withColumn("block", to("blocks"))
        sent = sent.withColumn("unit", unit).groupBy("id", shard.alias("shard")).agg(F.collect_list("unit").alias("units"))
        sent = who.join(sent, "id")
        found = sent.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(look, "query_id long, found long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
        return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    one = checkpointed(search(asked, tables, probes))
    enough = one.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = checkpointed(asked.join(enough, "id", "left_anti"))
    if short.isEmpty():
        whole = one
    else:
        whole = one.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(search(short, 1, buckets))
    return whole.select("query_id", "rank", F.col("found").alias(id_col), "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of all vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
