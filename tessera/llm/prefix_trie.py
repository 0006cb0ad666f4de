"""Prefix trie of rebuilt conversations, from fingerprints that compose.

A sequence of turns has the fingerprint (length, V) with V = sum of t_i * B**(n - i) mod P, t_i from the turn's SHA-256.
These form a monoid: V(xy) = V(x) * B**len(y) + V(y). So the fingerprint of a rebuilt conversation (the head of
a base conversation, then what its own turns have after the cut) follows from three stored prefix products,

    V = own[i] + (base head - own[h]) * B**(i - h),

and no rebuilt text is ever put together: texts are read once, to be hashed. Two fingerprints with bases of their own
are kept, over 2**61 - 1. A group of equal fingerprints is one node of the trie; that its members are equal is
checked through the references to their last turns (the rest of the turn's digest), level by level: equal parents
and equal last turns are equal sequences. A group that holds two different turns is an error, never a node.

Sums over subtrees need no walk. Nodes are named by their smallest member; nodes with the same smallest member c lie
one below the other on c's path and reach its end. Another member's own nodes all lie deeper than any node that it
shares, so the subtree of a node holds all nodes of its members but those of its smallest member above it:
one sum over members, less one running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, table

#: The modulus, and a base for each of the two fingerprints.
P, BASES = 2**61 - 1, (1_000_003_000_107, 2_305_843_009_213_693)
#: The longest head, plus one; bases are conversations whose number this many divide.
HEADS, FAMILY = 9, 5
#: Ids that are joined to one piece before their hash.
PIECE = 4096


def scanned(
    rows: DataFrame, key: str, order: list[Column], start: Any, step: Callable[[Any, tuple], tuple[Any, list]], meet: Callable[[Any, Any], Any], schema: str, state: str
) -> DataFrame:
    """Running states along the rows of each key in ``order``, also where a key spans many tasks.

    ``step(state, row)`` gives the next state and the row's outcome; ``meet(a, b)`` joins the state of what stands before with
    that of what follows, and ``start`` is its neutral state. Rows are range-partitioned by key and order and
    stored; each task reports the state of its last key, a row for each task, from which the states at the tasks' starts
    follow. Then each task runs along its rows.
    """
    session, columns, at = rows.sparkSession, rows.columns, rows.columns.index(key)
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first = now = value = part = None
        for b in batches:
            for *row, p in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if part is None:
                    first, now, value, part = row[at], row[at], start, p
                elif row[at] != now:
                    now, value = row[at], start
                value, _ = step(value, tuple(row))
        if part is not None:
            yield {"part": [part], "first": [first], "last": [now], "state": [value]}

    kind = dict(rows.dtypes)[key]
    carried, held = {}, {}
    for r in sorted(arrow_map(dealt, last, f"part int, first {kind}, last {kind}, state {state}").collect()):
        value = r["state"]
        carried[r["part"]] = held
        held = {r["last"]: meet(held[r["last"]], value) if r["first"] == r["last"] and r["last"] in held else value}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        begun, now, value = False, None, None
        for b in batches:
            out: list[list] = []
            for *row, p in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if not begun or row[at] != now:
                    value = start if begun else carried[p].get(row[at], start)
                    begun, now = True, row[at]
                value, told = step(value, tuple(row))
                out.append(told)
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {c: [] for c in names}

    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_map(dealt.select(*columns, "_part"), run, schema)


def stored_turns(conversations: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """``conv, turn, role, t1, t2, r1, r2, bytes``: a narrow row for each turn; its digest in four numbers, and the text's UTF-8 bytes.

    The digest is over the role's length, the role and the text, so it tells where the role ends.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat_ws("", F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    number = lambda at, n: F.conv(F.substring("digest", at, n), 16, 10).cast("long")
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return rows.select("conv", "turn", "digest", number(1, 15).alias("t1"), number(16, 15).alias("t2"), number(31, 15).alias("r1"), number(46, 15).alias("r2"), F.conv(F.substring("digest", 61, 4), 16, 10).cast("long").alias("r3"), "bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, i, v1, v2, t1, t2, r1, r2, r3, bytes``: the fingerprint of the first i turns of each conversation, i from 1."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list]:
        n, v1, v2 = state
        conv, _, _, t1, t2, r1, r2, r3, size = row
        state = (n + 1, (v1 * BASES[0] + t1) % P, (v2 * BASES[1] + t2) % P)
        return state, [conv, *state, t1, t2, r1, r2, r3, size]

    def meet(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], *((x * pow(base, b[0], P) + y) % P for x, y, base in zip(a[1:], b[1:], BASES, strict=True)))

    # The digest orders turns of one number; the states travel as arrays.
    started = lambda s, row: step(tuple(s), row)
    rows = scanned(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], (0, 0, 0), started, meet, "conv long, i long, v1 long, v2 long, t1 long, t2 long, r1 long, r2 long, r3 long, bytes long", "array<long>")
    return rows


def rebuilt(stored: DataFrame) -> DataFrame:
    """``conv, depth, v1, v2, t1, t2, r1, r2, r3, bytes, last``: every prefix of every rebuilt conversation, the empty one included.

    ``last``: it is the whole of the rebuilt conversation. Heads are joined by number; of a conversation's own turns each row is moved
    by the two products at the cut, which are a row for each conversation.
    """
    cut = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("long")
    convs = stored.groupBy("conv").agg(F.max("i").alias("n")).withColumn("h", cut).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(FAMILY)))
    at = stored.filter(F.col("i") < HEADS).select(F.col("conv").alias("of"), F.col("i").alias("at"), "v1", "v2")
    sizes = convs.filter(F.col("conv") == F.col("base")).select(F.col("conv").alias("of"), F.col("n").alias("base_n"))
    plan = convs.join(sizes, F.col("base") == F.col("of"), "left").drop("of").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    head = at.select(F.col("of").alias("head_of"), F.col("at").alias("head_at"), F.col("v1").alias("a1"), F.col("v2").alias("a2"))
    own = at.select(F.col("of").alias("own_of"), F.col("at").alias("own_at"), F.col("v1").alias("b1"), F.col("v2").alias("b2"))
    plan = plan.join(head, (F.col("base") == F.col("head_of")) & (F.col("m") == F.col("head_at")), "left")
    plan = plan.join(own, (F.col("conv") == F.col("own_of")) & (F.col("h") == F.col("own_at")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    whole = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    plan = checkpointed(plan.select("conv", "n", "h", "base", "m", whole.alias("size"), *map(zero, ("a1", "a2", "b1", "b2"))))

    turn = ("v1", "v2", "t1", "t2", "r1", "r2", "r3", "bytes")
    heads = plan.filter("m > 0").select(F.col("conv").alias("of"), "base", "m", "size")
    heads = stored.filter(F.col("i") < HEADS).join(heads, (F.col("conv") == F.col("base")) & (F.col("i") <= F.col("m")))
    heads = heads.select(F.col("of").alias("conv"), F.col("i").alias("depth"), *turn, (F.col("i") == F.col("size")).alias("last"))
    tails = stored.join(plan.select(F.col("conv").alias("of"), "h", "m", "size", "a1", "a2", "b1", "b2"), (F.col("conv") == F.col("of")) & (F.col("i") > F.col("h")))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            c = {name: b.column(name).to_pylist() for name in b.schema.names}
            out = {name: c[name] for name in ("conv", *turn[2:])}
            gone = [i - h for i, h in zip(c["i"], c["h"], strict=True)]
            for v, a, o, base in (("v1", "a1", "b1", BASES[0]), ("v2", "a2", "b2", BASES[1])):
                out[v] = [(x + (y - z) * pow(base, g, P)) % P for x, y, z, g in zip(c[v], c[a], c[o], gone, strict=True)]
            depth = [m + g for m, g in zip(c["m"], gone, strict=True)]
            yield out | {"depth": depth, "last": [d == size for d, size in zip(depth, c["size"], strict=True)]}

    columns = "conv long, depth long, v1 long, v2 long, t1 long, t2 long, r1 long, r2 long, r3 long, bytes long, last boolean"
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", *turn)]
    roots = plan.select("conv", *nothing, (F.col("size") == 0).alias("last"))
    return roots.unionByName(heads).unionByName(arrow_map(tails, move, columns))


def grouped(pairs: DataFrame) -> DataFrame:
    """``depth, v1, v2, conv, n_convs, bytes, t1, t2``: the nodes, each checked to hold one last turn."""
    turn = ("t1", "t2", "r1", "r2", "r3")
    both = [f(c).alias(f"{f.__name__}_{c}") for c in turn for f in (F.min, F.max)]
    nodes = pairs.groupBy("depth", "v1", "v2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), *both)
    one = F.lit(True)
    for c in turn:
        one &= F.col(f"min_{c}") == F.col(f"max_{c}")
    checked = F.when(one, F.col("n_convs")).otherwise(F.raise_error(F.lit("two different turns have one fingerprint: choose other bases")).cast("long"))
    return nodes.select("depth", "v1", "v2", "conv", checked.alias("n_convs"), "bytes", F.col("min_t1").alias("t1"), F.col("min_t2").alias("t2"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``p1, p2``, the parent's fingerprint: the last turn is taken off by the inverse base."""
    inverse = [pow(b, -1, P) for b in BASES]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            c = {name: b.column(name).to_pylist() for name in b.schema.names}
            for p, v, t, back in (("p1", "v1", "t1", inverse[0]), ("p2", "v2", "t2", inverse[1])):
                c[p] = [(x - y) * back % P for x, y in zip(c[v], c[t], strict=True)]
            yield c

    return arrow_map(nodes.select("depth", "v1", "v2", "conv", "n_convs", "bytes", "t1", "t2"), up, "depth long, v1 long, v2 long, conv long, n_convs long, bytes long, p1 long, p2 long")


def joined_hashes(ids: DataFrame) -> DataFrame:
    """``conv, depth, sha``: the SHA-256 of each node's ids, ascending and comma-joined.

    Ids are sorted and joined to pieces in as many tasks as their number asks for; one task then hashes a node's pieces one
    after another, as this digest must be, holding one batch of them.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found: list[list] = []
            for conv, depth, x in zip(*(b.column(c).to_pylist() for c in ("conv", "depth", "id")), strict=True):
                if found and found[-1][:2] == [conv, depth] and len(found[-1][3]) < PIECE:
                    found[-1][3].append(str(x))
                else:
                    found.append([conv, depth, x, [str(x)]])
            yield {"conv": [x[0] for x in found], "depth": [x[1] for x in found], "first": [x[2] for x in found], "ids": [",".join(x[3]) for x in found]}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, digest = None, None
        for b in batches:
            out: list[tuple] = []
            for conv, depth, text in zip(*(b.column(c).to_pylist() for c in ("conv", "depth", "ids")), strict=True):
                if (conv, depth) == now:
                    digest.update(b"," + text.encode())
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (conv, depth), hashlib.sha256(text.encode())
            yield {c: [x[i] for x in out] for i, c in enumerate(("conv", "depth", "sha"))}
        if now:
            yield {"conv": [now[0]], "depth": [now[1]], "sha": [digest.hexdigest()]}

    dealt = ids.repartitionByRange(n, "conv", "depth", "id").sortWithinPartitions("conv", "depth", "id")
    dealt = arrow_map(dealt, pieces, "conv long, depth long, first long, ids string")
    return arrow_map(dealt.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first"), whole, "conv long, depth long, sha string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node of the trie.

    A null or empty role or text is an empty one; an empty text counts no bytes. Null turn numbers come first; turns
    with one number go by the digest of role and text, so repeated rows are turns of their own. Rows without a conversation number take no
    part; bases of negative numbers are rounded down. Conversations of any length and texts of any size do; one that is rebuilt to
    no turns is a member of the root. An empty table has no nodes. Further columns are left out, whatever their names.
    """
    stored = checkpointed(prefixes(stored_turns(conversations, conv_col, turn_col)))
    pairs = checkpointed(rebuilt(stored))
    nodes = checkpointed(with_parents(grouped(pairs)))

    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, (F.col("depth") == F.col("d")) & (F.col("v1") == F.col("c1")) & (F.col("v2") == F.col("c2")), "left")
    value = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = checkpointed(nodes.drop("d", "c1", "c2").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "value": value}))

    # What each conversation owns, summed over the members of a node, less what the node's smallest member owns above it.
    owned = nodes.groupBy("conv").agg(F.sum("value").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shares = pairs.select("conv", "depth", "v1", "v2").join(owned, "conv", "left")
    sums = shares.groupBy("depth", "v1", "v2").agg(F.sum("owned").alias("under"), F.sum("leaf").alias("n_leaves"))

    def step(state: int, row: tuple) -> tuple[int, list]:
        return state + row[2], [row[0], row[1], state]

    above = scanned(nodes.select("conv", "depth", "value"), "conv", [F.col("depth")], 0, step, lambda a, b: a + b, "c long, d long, above long", "long")

    up = nodes.select(F.col("depth").alias("d"), F.col("v1").alias("c1"), F.col("v2").alias("c2"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "v1", "v2"]).withColumnRenamed("conv", "at")
    out = out.join(up, (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")), "left").drop("d", "c1", "c2")
    out = out.join(above, (F.col("at") == F.col("c")) & (F.col("depth") == F.col("d"))).drop("c", "d")

    named = nodes.select(F.col("depth").alias("d"), F.col("v1").alias("c1"), F.col("v2").alias("c2"), F.col("conv").alias("at"))
    ends = pairs.filter("last").join(named, (F.col("depth") == F.col("d")) & (F.col("v1") == F.col("c1")) & (F.col("v2") == F.col("c2")))
    shas = joined_hashes(ends.select(F.col("at").alias("conv"), "depth", F.col("conv").alias("id")))
    out = out.join(shas.select(F.col("conv").alias("c"), F.col("depth").alias("d"), "sha"), (F.col("at") == F.col("c")) & (F.col("depth") == F.col("d")), "left")
    return out.select(
        F.col("at").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("under") - F.col("above")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit over the bytes of a number's digits; the trie by lists of turns.
OP11_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS i, sha256(strlen(r) || ':' || r || x) AS turn, strlen(x) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS part, t.i, t.turn, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.turn, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, sha256(array_to_string(list(turn) OVER w, ',')) AS path, bytes, count(*) OVER (PARTITION BY conv_id) AS size FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
p AS (
  SELECT d.*, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS up FROM d
  UNION ALL SELECT c.conv_id, 0, 'root', 0, coalesce(s.size, 0), NULL FROM c LEFT JOIN (SELECT DISTINCT conv_id, size FROM d) s USING (conv_id)),
n AS (
  SELECT depth, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(CASE WHEN depth = size THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY depth, path),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
a AS (
  SELECT v.path, sum(w.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE w.path NOT IN (SELECT path FROM k)) AS n_leaves
  FROM n w JOIN p v ON v.conv_id = w.conv_id AND v.depth <= w.depth GROUP BY v.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens, n.ends_sha256
FROM n JOIN a USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.up = u.path AND n.depth > 0
"""
