"""Prefix tries, nearest neighbours and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import cross_polytope, prefix_trie, spelling

SF = "/root/testdata/sf0.01"
CLASHES = ("conv", "depth", "v1", "last", "base", "n", "h", "size", "vec", "ids", "id", "score", "rank", "t", "code", "unit", "node", "word", "near")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = Counter(p[:-1] for p in members if p)
    under = {p: [q for q in members if q[: len(p)] == p] for p in members}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in under[p]),
         sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under[p] if q), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def told(df):
    return sorted(tuple(r) for r in df.collect())


CONV = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "ä🙂", "", None])) for c in range(40) for t in range(rng.randint(0, 12))]
    rows += [(50, None, "user", "first"), (50, 0, "user", "tie"), (50, 0, "bot", "tie"), (50, 0, "bot", "tie"), (None, 0, "user", "lost"), (10**12 + 3, 0, "a", "bc"), (10**12 + 4, 0, "ab", "c")]
    rows += [(90 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)] + [(200, t, "user", "x" * 50_000) for t in range(3)]
    rows += [(-3, 0, "user", "negative"), (-5, 0, "user", "negative")]
    df = clashing(spark.createDataFrame(rows, CONV)).repartition(5)
    assert told(prefix_trie.prefix_trie(df)) == brute_trie(rows)
    assert told(prefix_trie.prefix_trie(df.limit(0))) == []


def test_trie_of_one_long_conversation_over_many_tasks(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (5, 6) for t in range(400)] + [(7, t, "user", str(t % 7)) for t in range(390)]
    assert told(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV))) == brute_trie(rows)


def test_equal_fingerprints_of_different_turns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BASES", (0, 0))  # a fingerprint is then the last turn's, by its first numbers
    rows = [(i, 0, 0, 0, 0, i, 0, 0, True) for i in range(2)]
    pairs = spark.createDataFrame(rows, "conv long, depth long, v1 long, v2 long, t1 long, r1 long, bytes long, x long, last boolean").withColumns({c: F.lit(0).cast("long") for c in ("t2", "r2", "r3")})
    with pytest.raises(Exception, match="one fingerprint"):
        prefix_trie.grouped(pairs).collect()


def brute_nearest(rows, asked, k):
    vecs = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            vecs.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in asked:
        for v in vecs.get(q, ()):
            pad = lambda x: np.pad(np.array(x, dtype=float), (0, 16 - len(x)))
            out[q] = sorted((-float((pad(v) * pad(w)).sum()), i) for i, ws in vecs.items() if i != q for w in ws)[:k]
    return out


def test_all_candidates_of_small_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 10.0 ** (i % 4)) for _ in range(3 + i % 3)]) for i in range(18)]
    rows += [(30, None), (31, [0.0, 0.0]), (32, [1.0, None]), (33, [float("nan")]), (34, [float("inf")]), (None, [1.0]), (35, []), (36, [1e-200, 0.0]), (0, rows[0][1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {}
    for r in cross_polytope.nearest(df, df.filter("vec_id % 2 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, range(0, 40, 2), 20)
    assert found.keys() == want.keys()
    for q, best in want.items():
        mine = sorted(found[q])
        assert [x[0] for x in mine] == list(range(1, len(best) + 1))
        assert [x[1] for x in mine] == [i for _, i in best]
        assert np.allclose([x[2] for x in mine], [-s for s, _ in best], rtol=1e-12)
    assert cross_polytope.nearest(df.limit(0), df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        huge = spark.createDataFrame([(1, [1e200])], df.select("vec_id", "embedding").schema)
        cross_polytope.nearest(huge, huge).collect()


def recall(rows, x, ids, k=20):
    found, hits, total = {}, 0, 0
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, near in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(near & set(ids[np.lexsort((ids, -s))[:k]].tolist()))
        total += k
    return hits / total, len(found)


@pytest.mark.parametrize("small", [False, True])
def test_recall(spark, monkeypatch, small):
    if small:  # many blocks and turns
        monkeypatch.setattr(cross_polytope, "HELD", 4096)
        monkeypatch.setattr(cross_polytope, "ASKED", 3)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x, ids = np.array(t.column("embedding").to_pylist(), dtype=float), np.array(t.column("vec_id"))
    share, n = recall(cross_polytope.nearest(df, df.filter("vec_id % 20 = 0")).collect(), x, ids)
    assert share >= 0.9 and n == 25


def test_recall_with_clusters_repeats_and_norms(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 24)) * rng.lognormal(0, 1, (1500, 1)), rng.normal(size=(1, 24)) + 0.01 * rng.normal(size=(700, 24)), np.tile(rng.normal(size=(1, 24)), (800, 1))])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(6)
    rows = cross_polytope.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    share, n = recall(rows, x, ids)
    assert share >= 0.9 and n == 150 and len(rows) == 150 * 20


def brute_pairs(words):
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    gaps = lambda w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}
    return {(a, b) for a in words for b in words if a != b and (b in less(a) or a in less(b) or (len(a) == len(b) and gaps(a) & gaps(b)))}


@pytest.mark.parametrize("page", [3, 16])
def test_spelling_neighbours_of_random_words(spark, monkeypatch, page):
    monkeypatch.setattr(spelling, "SALT", 20)
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(220)} | {"x" * n for n in (1, 2, 3, 9, 10, 11)} | {"x" * 80, "x" * 79 + "y", "y" * 70, "z" + "y" * 70}
    got = [tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), page).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(words)


def test_spelling_variants_of_odd_texts(spark):
    base = "wortform wortförm wortforms Wortform wartform ÄÖÜäöü ×÷abcdef abcdef"
    texts = [base] * 6 + ["wortform " * 40, "Wortform-wortform", None, "", "12 $$", "x" * 5000, "straße STRASSE日本abcdefg"] + ["wortforms wortfo" + "rms" * 3] * 7
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (1, base)] + [(i + 100, "geheimnis " * 3) for i in range(400)]
    counts = Counter()
    for i, t in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "\xc0" <= c <= "\xff" else " " for c in t or "").split():
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [b for a, b in brute_pairs(n) if a == w] for w in n}
    form = {w: best if (best := min(near[w], key=lambda x: (-n[x], x), default=None)) is not None and n[best] >= 5 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in spelling.spelling_variants(df).collect()}
    assert got == {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n} and any(form.values())
    assert spelling.spelling_variants(df.limit(0)).count() == 0
