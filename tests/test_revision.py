"""Canonical JSON, three-way parity and the change gate on fixtures."""

import itertools
import json

from pyspark.sql import functions as F

from tessera.functions.canonical import METADATA, canonical_json
from tessera.operators.reconcile import three_way
from tessera.sources.gate import pointer, publish_changes, snapshot


def test_canonical_json(spark):
    deep = "[" * 1500 + "]" * 1500
    cases = {
        '{"b": 1, "a": {"d": [2, 1], "c": null}}': ('{"a":{"c":null,"d":[2,1]},"b":1}', '{"a":{"d":[2,1]},"b":1}'),
        '{"a":{"d":[2,1],"c":null},"b":1.0}': ('{"a":{"c":null,"d":[2,1]},"b":1}', '{"a":{"d":[2,1]},"b":1}'),
        '{"_id": 1, "x": {"_id": 2}}': ('{"x":{"_id":2}}', '{"x":{"_id":2}}'),
        '{"x": {"y": {"z": null}}, "e": [], "n": [null, {}]}': ('{"e":[],"n":[null,{}],"x":{"y":{"z":null}}}', '{"e":[],"n":[]}'),
        '{"ä": "\\u00e9", "🙂": 1, "\\uff5e": 2}': ('{"ä":"é","🙂":1,"～":2}', '{"ä":"é","🙂":1,"～":2}'),
        "9007199254740993": ("9007199254740993", "9007199254740993"), '{"a":1,"a":2}': ('{"a":2}', '{"a":2}'),
        "null": ("null", None), "{}": ("{}", None), "NaN": (None, None), "{": (None, None), "": (None, None), deep: (deep, deep),
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: (r.a, r.b) for r in rows.select("t", canonical_json(F.col("t"), METADATA).alias("a"), canonical_json(F.col("t"), METADATA, prune=True).alias("b")).collect()}
    assert got == cases | {None: (None, None)}
    orders = [json.dumps(dict(p)) for p in itertools.permutations([("a", 1), ("b", {"y": 1, "x": 2}), ("c", [1])])]
    assert spark.createDataFrame([(t,) for t in orders], "t string").select(canonical_json(F.col("t"))).distinct().count() == 1


def test_three_way_parity(spark):
    """Every combination of presence and change has its verdict."""
    sides: dict[str, list] = {"t": [], "e": [], "a": []}
    want = {}
    for i, (t, e, a) in enumerate(itertools.product((None, "x", "y"), repeat=3)):
        for side, d in zip("tea", (t, e, a), strict=True):
            sides[side] += [(str(i), d)] if d else []
        if t or e or a:
            want[str(i)] = "unexpected" if not e else "not-approved" if not a else "missing" if not t else "approved-differs" if a != e else "target-differs" if t != a else "equal"
    for side in "tea":
        sides[side] += [(f"two-{side}", "x")] * 2
        want[f"two-{side}"] = {"t": "duplicate-target", "e": "duplicate-expected", "a": "duplicate-approved"}[side]
    frames = [spark.createDataFrame(sides[s], "key string, digest string") for s in "tea"]
    assert {r.key: r.verdict for r in three_way(*frames).collect()} == want


def test_change_gate(spark, tmp_path):
    root, schema = str(tmp_path), "id long, name string, n int"
    rows = [(i, f"name {i}", i % 3 or None) for i in range(300)] + [(None, "no id", 1), (7, "second row of 7", 1)]
    publish = lambda rows: {(r.id, r.kind) for r in publish_changes(spark.createDataFrame(rows, schema).repartition(3), root, "id", 16).collect()}
    assert publish(rows) == {(i, "added") for i in [*range(300), None]}
    assert publish(rows[::-1]) == set() and {d.version for d in pointer(spark, root).values()} == {1}
    changed = [(5, "other", 2) if r[0] == 5 else r for r in rows]
    assert publish(changed) == {(5, "changed")}
    assert sorted(d.version for d in pointer(spark, root).values()) == [1] * 15 + [2]
    assert len(list((tmp_path / "rows" / "v=2").glob("_p=*"))) == 1
    assert publish(changed[:-1] + [(1000, None, None)]) == {(7, "changed"), (1000, "added")}
    assert publish([r for r in changed if r[0] is not None]) == {(None, "removed"), (7, "changed"), (1000, "removed")}
    assert sorted(map(str, snapshot(spark, root).select("id", "name", "n").collect())) == sorted(map(str, spark.createDataFrame([r for r in changed if r[0] is not None], schema).collect()))
    assert publish([]) == {(i, "removed") for i in range(300)}
    assert snapshot(spark, root) is None and publish([]) == set()
