"""Exact top-k by inner product with an M-tree.

Equal vectors are merged first, each with its smallest ids only (k + 1 are enough for any query). A bounded
sample gives the routing objects of the root; every vector goes to the nearest. What a routing object holds is cut
into pages by the distance to it: a page is a ring, a metric node with its own inner and covering radius and largest
norm. Inside a page, entries are leaves with a routing object, a covering radius and their distance to the page's
routing object; a leaf's entries keep their distance to the leaf's routing object.

With q·x = (|q|² + |x|² - d(q, x)²) / 2, a lower bound of a distance is an upper bound of a score. The triangle
inequality gives such bounds from the stored distances before any new one is worked out. Each query first
searches the page with the best bound, whose k-th score then rules out the others: only pages that can still hold a
better or equal score are searched in a second round. Inside a page each query takes leaves best bound first, until
the best is under its k-th score; queries that are at the same leaf are scored together.

Scores are exact integers: vectors are held as whole doubles, products are summed in doubles where their sum stays
under 2**53 and in Python's integers beyond. A score among a query's best that no long can hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FINE, arrow_map, checkpointed, table

#: Vectors the routing objects are chosen from, and the most routing objects and pages of each. The page table that all
#: tasks get is so bounded (1 MB at most); pages of very large tables hold more, and are dealt to tasks in blocks.
SAMPLE, ROUTES, RINGS = 4096, 256, 64
#: Vectors of a page and of a leaf, about.
PAGE, LEAF = 4096, 128
#: Components past this can't be squared in doubles.
HUGE = 1e150


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """``id, vec``: floor(scale * x) as little-endian doubles, of the rows that take part.

    Left out are null ids, null vectors and those that hold a null, an infinity or no number. Trailing zeros
    are cut, so vectors of different lengths compare as if padded with zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("vec"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    n = np.floor(scale * x) + 0.0  # no negative zero
                    if np.abs(n).max(initial=0) > HUGE:
                        raise OverflowError(f"the components of vector {i} are too large to be squared")
                    ids.append(i)
                    vecs.append(np.trim_zeros(n, "b").astype("<f8").tobytes())
            yield {"id": ids, "vec": vecs}

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), run, "id long, vec binary")


def matrix(vecs: list[bytes], width: int) -> np.ndarray:
    """Rows padded with zeros."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        n = np.frombuffer(v, dtype="<f8")
        out[i, : len(n)] = n
    return out


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Rows of up to ``n`` points, each the farthest from those before it."""
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = np.sqrt(((points - points[chosen[0]]) ** 2).sum(axis=1))
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
    return np.array(chosen)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``."""
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T))


def bound(q_norm2: np.ndarray | float, x_norm2: np.ndarray | float, least: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product given a lower bound of the distance; widened against rounding.

    Rounding errors are in proportion to the squared norms, from which the distances come, not to the bound itself.
    """
    least = np.maximum(0, least)
    size = q_norm2 + x_norm2 + least**2 + 1
    return (q_norm2 + x_norm2 - least**2) / 2 + 1e-6 * size


def scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, a row for each query: doubles where these are exact, else Python's integers."""
    most = np.sqrt((points**2).sum(axis=1).max(initial=0) * (queries**2).sum(axis=1).max(initial=0))
    if most < 2**52:
        return queries @ points.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return whole(queries) @ whole(points).T


class Leaf(NamedTuple):
    rows: np.ndarray
    to_leaf: np.ndarray  # distances of the rows to the leaf's routing object


class Page:
    """A node with its leaves."""

    def __init__(self, points: np.ndarray, ids: list[list[int]], route: np.ndarray):
        self.points, self.ids, self.route = points, ids, route
        self.norm2 = (points**2).sum(axis=1)
        centres = points[spread_out(points, max(1, -(-len(points) // LEAF)))]
        d = distance(points, centres)
        home = d.argmin(axis=1)
        used = np.flatnonzero(np.bincount(home, minlength=len(centres)))
        self.centres = centres[used]
        self.leaves = [Leaf(rows := np.nonzero(home == j)[0], d[rows, j]) for j in used]
        self.radius = np.array([leaf.to_leaf.max() for leaf in self.leaves])
        self.most2 = np.array([self.norm2[leaf.rows].max() for leaf in self.leaves])
        self.to_page = distance(self.centres, route[None])[:, 0]

    def search(self, queries: np.ndarray, q_ids: list[int], k: int, floors: list[float]) -> list[list[tuple[int, int]]]:
        """For each query up to k (-score, id), best first, of those that score its floor or more."""
        q2 = (queries**2).sum(axis=1)
        floor = np.array(floors, dtype=object)
        to_route = np.sqrt(((queries - self.route) ** 2).sum(axis=1))
        # First by the stored parent distances alone; only leaves that pass have their distance worked out.
        tops = bound(q2[:, None], self.most2, np.abs(to_route[:, None] - self.to_page) - self.radius)
        open_ = tops >= floor.astype(float)[:, None]
        asked, wanted = np.nonzero(open_.any(axis=1))[0], np.nonzero(open_.any(axis=0))[0]
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        if not len(asked):
            return best
        d = np.full(tops.shape, np.inf)
        d[np.ix_(asked, wanted)] = distance(queries[asked], self.centres[wanted])
        tops[np.ix_(asked, wanted)] = np.minimum(tops, bound(q2[:, None], self.most2, d - self.radius))[np.ix_(asked, wanted)]
        tops[~open_] = -np.inf
        order = np.argsort(-tops, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf_of = order[asked, turn]
            asked = asked[(tops[asked, leaf_of] >= floor[asked].astype(float)) & np.isfinite(tops[asked, leaf_of])]
            if not len(asked):
                break
            leaf_of = order[asked, turn]
            for j in np.flatnonzero(np.bincount(leaf_of)):
                group, leaf = asked[leaf_of == j], self.leaves[j]
                # Rows that no query of the group can want, by their stored distance to the leaf's routing object.
                near, far = d[group, j].min(), d[group, j].max()
                gap = np.maximum(near - leaf.to_leaf, leaf.to_leaf - far)
                rows = leaf.rows[bound(q2[group].max(), self.norm2[leaf.rows], gap) >= float(min(floor[group]))]
                if not len(rows):
                    continue
                found = scores(self.points[rows], queries[group])
                for at, q in enumerate(group.tolist()):
                    for c in np.nonzero(found[at] >= floor[q])[0].tolist():
                        best[q] += [(-int(found[at, c]), i) for i in self.ids[rows[c]] if i != q_ids[q]]
                    best[q] = sorted(best[q])[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], -best[q][-1][0])
        return best


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: for each query the k best of ``vectors`` by integer inner product.

    Rows with the query's own id are no candidates; ties go to the smaller id. Rows that repeat an id with the
    same vector count once. A query finds fewer than k where there are fewer; an empty table gives no rows. Further
    columns are left out. Vectors of any length and finite size take part; a best score that is no long is an error.
    """
    rows = quantised(vectors, id_col, vec_col)
    first = Window.partitionBy("vec").orderBy("id")
    merged = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    merged = checkpointed(merged.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = checkpointed(quantised(queries, id_col, vec_col).distinct())
    n, width = merged.agg(F.count("*"), F.max(F.length("vec"))).first()
    asked_width = asked.agg(F.max(F.length("vec"))).first()[0]
    width = max(1, (width or 0) // 8, (asked_width or 0) // 8)
    spread = F.pmod(F.xxhash64("vec"), F.lit(FINE))
    sample = merged.filter(spread < max(1, int(FINE * min(1.0, SAMPLE / max(1, n))))).select("vec").toArrow().column("vec").to_pylist()
    points = matrix(sorted(sample) or [b""], width)
    routes = points[spread_out(points, min(ROUTES, max(1, n // 1024)))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = matrix(part.column("vec").to_pylist(), width)
                d = distance(x, routes)
                home = d.argmin(axis=1)
                yield {"vec": part.column("vec"), "ids": part.column("ids"), "route": home, "far": d[np.arange(len(home)), home], "norm2": (x**2).sum(axis=1)}

    routed = checkpointed(arrow_map(merged, route, "vec binary, ids array<long>, route int, far double, norm2 double"))
    # One row for each of at most ROUTES routing objects: its size, and the distances at which its rings are cut.
    cuts = F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000)
    sizes = {r["route"]: (r["n"], r["cuts"]) for r in routed.groupBy("route").agg(F.count("*").alias("n"), cuts.alias("cuts")).collect()}
    borders = {}
    for r, (size, at) in sizes.items():
        rings = min(RINGS, -(-size // PAGE))
        borders[r] = sorted({at[RINGS * i // rings - 1] for i in range(1, rings)})
    # Both tables of this kind are broadcast: one has ROUTES rows of RINGS numbers at most, the other ROUTES * RINGS rows.
    spark = vectors.sparkSession
    rings = F.broadcast(spark.createDataFrame(list(borders.items()), "route int, at array<double>"))
    ring = F.size(F.filter("at", lambda x: F.col("far") > x))
    pages = routed.join(rings, "route").withColumn("page", ring).drop("at")
    # One row for each page, at most ROUTES * RINGS: its own radii and largest norm.
    ball = (F.min("far").alias("inner"), F.max("far").alias("outer"), F.max("norm2").alias("most2"), F.count("*").alias("n"))
    nodes = sorted(tuple(r) for r in pages.groupBy("route", "page").agg(*ball).collect())
    of_route, inner, outer, most2 = (np.array([x[i] for x in nodes]) for i in (0, 2, 3, 4))
    # Pages that outgrow a task, and the queries, are dealt to tasks in blocks.
    blocks = [max(1, -(-x[5] // (4 * PAGE))) for x in nodes]
    sizes_of = F.broadcast(spark.createDataFrame([(x[0], x[1], parts) for x, parts in zip(nodes, blocks, strict=True)], "route int, page int, n_blocks int"))
    held = pages.join(sizes_of, ["route", "page"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("n_blocks")).cast("int"))

    def send(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[dict]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                ids, vecs = (part.column(c).to_pylist() for c in ("id", "vec"))
                if not len(nodes):
                    continue
                q = matrix(vecs, width)
                d = distance(q, routes)[:, of_route]
                tops = bound((q**2).sum(axis=1)[:, None], most2, np.maximum(d - outer, inner - d))
                best = tops.argmax(axis=1)
                floors = part.column("floor").to_pylist() if second else [None] * len(ids)
                out: dict[str, list] = {c: [] for c in ("id", "vec", "route", "page", "block", "floor")}
                for i, floor in enumerate(floors):
                    least = -np.inf if floor is None else float(floor)
                    for j in np.nonzero(tops[i] >= least)[0].tolist() if second else [int(best[i])]:
                        if second and j == best[i]:
                            continue
                        for block in range(blocks[j]):
                            for c, value in zip(out, (ids[i], vecs[i], nodes[j][0], nodes[j][1], block, floor), strict=True):
                                out[c].append(value)
                yield out

    keys = ("route", "page", "block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows sorted by page, its vectors before its queries: one page is held at a time, queries stream past it."""
        at, parts, page = None, [], None
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            asks = b.column("asks").to_pylist()
            start = 0
            while start < b.num_rows:
                end = start
                while end < b.num_rows and end - start < 1024 and places[end] == places[start] and asks[end] == asks[start]:
                    end += 1
                if places[start] != at:
                    at, parts, page = places[start], [], None
                run = b.slice(start, end - start)
                if not asks[start]:
                    parts.append(run.select(["vec", "ids"]))
                elif parts or page is not None:
                    if page is None:
                        rows, parts = pa.Table.from_batches(parts), []
                        page = Page(matrix(rows.column("vec").to_pylist(), width), rows.column("ids").to_pylist(), routes[at[0]])
                    ids, floors = run.column("id").to_pylist(), [-np.inf if x is None else x for x in run.column("floor").to_pylist()]
                    found = page.search(matrix(run.column("vec").to_pylist(), width), ids, k, floors)
                    hits = [(q, i, -s) for q, best in zip(ids, found, strict=True) for s, i in best]
                    yield {c: [x[i] for x in hits] for i, c in enumerate(("query_id", "found", "score"))}
                start = end

    def search(sent: DataFrame) -> DataFrame:
        """What each page finds for the queries sent to it. A vector is shuffled once, whatever the number of queries."""
        none = F.lit(None)
        rows = held.select(*keys, F.lit(False).alias("asks"), "vec", "ids", none.cast("long").alias("id"), none.cast("long").alias("floor"))
        queries = sent.select(*keys, F.lit(True).alias("asks"), "vec", none.cast("array<long>").alias("ids"), "id", "floor")
        dealt = rows.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "asks")
        return arrow_map(dealt, look, "query_id long, found long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    top = lambda rows: rows.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    columns = "id long, vec binary, route int, page int, block int, floor long"
    one = checkpointed(top(search(arrow_map(asked, lambda b: send(b, False), columns))))
    kth = one.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    two = search(arrow_map(asked.join(kth, "id", "left"), lambda b: send(b, True), columns))
    whole = top(one.drop("rank").unionByName(two))
    return whole.select("query_id", "rank", F.col("found").alias(id_col), "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
