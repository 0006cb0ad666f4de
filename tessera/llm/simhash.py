"""SimHash fingerprints, linked within a Hamming distance by vantage-point trees.

The 64 bits are cut in three bands (21, 21 and 22 bits). Two fingerprints within 4 bits are within one bit in
at least one band, so a search within distance 1 for each band, checked over all 64 bits, loses no pair.
For each band a vantage-point tree is fitted on a bounded sample of the fingerprints: a node sends those within
its radius of its vantage point left and the others right. The triangle inequality says which ones can have
partners on the other side of a border: only those at the radius itself, so they alone are sent to both sides.
Every fingerprint is routed to its leaves, which are the shards of a shuffle; inside a shard the same tree goes
on until a leaf is small enough to compare all with all. A shard returns a spanning forest of its links, never
its pairs, and the forests are joined by connected components.

Equal fingerprints are merged before all this, so that copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FINE, arrow_map, checkpointed, table, utf8
from .components import components

#: Bands as masks; together they cover every bit once.
BANDS = np.array([(1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42], dtype=np.uint64)
#: The tree is fitted on so many distinct fingerprints at least and at most; in between, on 16 for each shard. The bound
#: (8 MB at the driver) is that of the fit alone: every fingerprint is routed, and within its shard the tree goes on.
SAMPLE, MOST_SAMPLE = 8192, 1 << 20
#: A shard holds about so many fingerprints, a leaf within it at most so many.
SHARD, LEAF = 6000, 256


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; zero without words.

    The words of the lower-cased text are joined by single spaces once; a shingle is a slice of that.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = set_bits * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col, text_hash, fp`` (the fingerprint's 64 bits as a signed long) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(b, "_text")], dtype=np.uint64)
            yield {"_id": b.column("_id"), "text_hash": b.column("text_hash"), "fp": fps.view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    return arrow_map(rows, run, f"_id {kind}, text_hash long, fp long").withColumnRenamed("_id", id_col)


def distances(points: np.ndarray, to: np.ndarray | np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ to) & mask).astype(np.int16)


def best_split(points: np.ndarray, mask: np.uint64, border: int) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that leave the least in the larger side, border included; None if no split helps."""
    best, chosen = len(points) * 0.9, None
    for at in np.linspace(0, len(points) - 1, 5).astype(int):
        count = np.bincount(distances(points, points[at], mask), minlength=66).cumsum()
        for radius in range(0, 65):
            inside = count[radius]
            outside = len(points) - (count[radius - border] if radius >= border else 0)
            if max(inside, outside) < best:
                best, chosen = max(inside, outside), (points[at], radius)
    return chosen


class VantageTree:
    """A binary tree over one band. ``left``/``right`` below zero are leaves, numbered from -1 downwards."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, leaves: int, border: int = 1):
        self.mask, self.border = mask, border
        self.nodes: list[list] = []  # vantage point, radius, left, right
        self.n_leaves = 0
        least = max(8, len(sample) // max(1, leaves))
        self.root = self._grow(sample, least)

    def _grow(self, points: np.ndarray, least: int) -> int:
        split = best_split(points, self.mask, self.border) if len(points) > least else None
        if split is None:
            self.n_leaves += 1
            return -self.n_leaves
        me = len(self.nodes)
        self.nodes.append([split[0], split[1], 0, 0])
        d = distances(points, split[0], self.mask)
        # Fitted on the halves without the border, or the tree would grow with the copies it makes.
        self.nodes[me][2] = self._grow(points[d <= split[1]], least)
        self.nodes[me][3] = self._grow(points[d > split[1]], least)
        return me

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf number and the positions of the points that belong there, borders in both leaves."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                yield -at - 1, rows
            elif len(rows):
                vantage, radius, left, right = self.nodes[at]
                d = distances(points[rows], vantage, self.mask)
                stack.append((left, rows[d <= radius]))
                stack.append((right, rows[d > radius - self.border]))


def spanning_forest(points: np.ndarray, mask: np.uint64, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (child, parent) of a forest that joins all distinct points linked by at most ``most`` bits.

    Goes on with the band's tree; where a band can't split further (many points alike in it) the tree uses
    all 64 bits, with a border of ``most``. There, all points within ``most`` of the vantage point are linked
    to it at once, so that dense groups are not compared pair by pair.
    """
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)
    parent = np.arange(len(points))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(rows: np.ndarray, to: int) -> None:
        r = root(to)
        for x in rows.tolist():
            if (other := root(x)) != r:
                parent[max(other, r)] = min(other, r)
                r = min(other, r)

    def compare(rows: np.ndarray) -> None:
        """All with all, a block at a time."""
        held = points[rows]
        for at in range(0, len(rows), LEAF):
            near = np.bitwise_count(held[at : at + LEAF, None] ^ held[None, at:]) <= most
            for i in np.nonzero(near.sum(axis=1) > 1)[0]:
                link(rows[at:][near[i]], rows[at + i])

    border = 1
    stack = [(np.arange(len(points)), mask, border)]
    while stack:
        rows, metric, border = stack.pop()
        if len(rows) <= LEAF:
            if len(rows) > 1:
                compare(rows)
            continue
        split = best_split(points[rows], metric, border)
        if split is None and metric != whole:
            stack.append((rows, whole, most))
            continue
        if split is None:
            compare(rows)
            continue
        d = distances(points[rows], split[0], metric)
        if metric == whole:
            close = rows[d <= most]
            link(close, close[0]) if len(close) else None
        stack.append((rows[d <= split[1]], metric, border))
        stack.append((rows[d > split[1] - border], metric, border))
    roots = np.array([root(x) for x in range(len(points))], dtype=np.int64)
    child = np.nonzero(roots != np.arange(len(points)))[0]
    return child, roots[child]


def linked_fingerprints(fps: DataFrame, id_col: str = "doc_id", most: int = 4) -> DataFrame:
    """``fp, root, name`` for each distinct fingerprint: the least fingerprint of its component, and the smallest id there.

    ``fps`` is what ``fingerprints`` gives, checkpointed.
    """
    if not 0 <= most <= 4:
        raise ValueError("three bands find pairs of up to 4 differing bits")
    distinct = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    n = distinct.count()
    size = min(MOST_SAMPLE, max(SAMPLE, 16 * n // SHARD))
    spread = F.pmod(F.xxhash64("fp"), F.lit(FINE))
    sample = distinct.filter(spread < max(1, int(FINE * min(1.0, size / max(1, n))))).select("fp").toArrow().column("fp").to_numpy()
    sample = np.sort(sample).view(np.uint64)
    trees = [VantageTree(sample, m, max(1, min(len(sample) // 16, n // SHARD))) for m in BANDS] if n > 1 else []

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            points = b.column("fp").to_numpy().view(np.uint64)
            for band, tree in enumerate(trees):
                for leaf, rows in tree.route(points):
                    if len(rows):
                        yield {"band": [band] * len(rows), "leaf": [leaf] * len(rows), "fp": points[rows].view(np.int64)}

    def forest(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        child, parent = spanning_forest(points, BANDS[key[0].as_py()], most)
        return pa.table({"a": points[child].view(np.int64), "b": points[parent].view(np.int64)})

    edges = arrow_map(distinct.select("fp"), shards, "band int, leaf int, fp long").groupBy("band", "leaf").applyInArrow(forest, "a long, b long")
    groups = components(edges).select(F.col("node").alias("k"), "component")
    named = distinct.join(groups, distinct.fp == groups.k, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("name"))
    return named.join(names, "root").select("fp", "root", "name")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, shingle: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, a row for each row of ``docs``.

    Two fingerprints are linked if they differ in at most ``most`` (up to 4) bits; the component is named by the
    smallest id that can be reached. Texts without words, null ones among them, have the fingerprint zero and
    link like any other. Rows with a null id get their component too, but never name one: where no id of a
    component is known, component_id is null. Repeated ids keep a row each.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    whole = linked_fingerprints(fps, id_col, most).select(F.col("fp").alias("k"), F.col("name").alias("component_id"))
    return fps.join(whole, fps.fp == whole.k).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id, of these the smallest hash of the text.

    Rows are told apart by id and text, so a repeated id loses no text of a component of its own. Rows with a null id take
    part; they stay only where no row of the component has an id. Of rows equal in both, one stays. A component of empty
    and null texts keeps one row like any other. An empty table gives an empty one; further columns are kept as they are.
    """
    fps = checkpointed(fingerprints(docs))
    rows = fps.join(linked_fingerprints(fps).select(F.col("fp").alias("k"), "root"), F.col("fp") == F.col("k"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    chosen = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    held = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = held.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).select(docs.columns)
