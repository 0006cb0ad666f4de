"""Partials of link checks, merged in any order, against exact figures."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.linkhealth import ERROR, partials, replaced, report, within

CHECK = "provider string, day string, status int, error string, seconds double, batch long"


def test_merged_days_equal_all_checks(spark):
    rng = np.random.default_rng(6)
    rows = [("tube", f"2024-01-{1 + i % 9:02}", 200 if i % 10 else 404, None if i % 7 else "x", float(s), i % 4) for i, s in enumerate(rng.lognormal(size=20_000))]
    checks = spark.createDataFrame(rows, CHECK).withColumns({c: F.lit(1) for c in ("n", "fault", "time", "sketch")})
    stored = partials(checks.filter("batch < 3"), F.col("batch"))
    # The last batch comes twice: the second time in place of the first.
    new = partials(checks.filter("batch = 3"), F.col("batch"))
    got = report(replaced(replaced(stored, new), new), "provider").collect()
    times = np.sort([r[4] for r in rows])
    bad = sum(r[2] == 404 or r[3] is not None for r in rows)
    assert len(got) == 1 and (got[0].n, got[0].failures, got[0].ok, got[0].slowest, got[0].first_day, got[0].last_day) == (20_000, bad, 20_000 - bad, times[-1], "2024-01-01", "2024-01-09")
    for value, share in ((got[0].median, 0.5), (got[0].p95, 0.95)):
        assert abs(np.searchsorted(times, value) / len(times) - share) <= ERROR
    assert [tuple(r) for r in within(report(stored, "provider"), checks.filter("batch < 3"), "provider").collect()] == [("tube", True, True)]
    false = report(stored, "provider").withColumn("median", F.col("median") * 2)
    assert [tuple(r) for r in within(false, checks.filter("batch < 3"), "provider").collect()] == [("tube", False, True)]


def test_odd_checks(spark):
    odd = [(None, None, None, None, None, 0), ("map", "d", 200, None, float("nan"), 0), ("map", "d", 204, "", float("inf"), 0), ("map", "d", 301, None, -1.0, None), ("tube", "d", 200, None, 2.0, 0), ("tube", "d", 200, None, 2.0, 0)]
    parts = partials(spark.createDataFrame(odd, CHECK), F.col("batch"))
    got = {r.provider: (r.n, r.ok, r.failures, r.unanswered, r.timed, r.slowest, r.median) for r in report(parts, "provider").collect()}
    assert got == {None: (1, 0, 1, 1, 0, None, None), "map": (3, 1, 2, 0, 0, None, None), "tube": (2, 2, 0, 0, 2, 2.0, 2.0)}
    assert report(parts.limit(0), "provider").count() == 0 and replaced(parts, parts).count() == parts.count()
