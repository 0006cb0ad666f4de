"""Documents that no request can hold are reported."""

import random

import duckdb

from pyspark.sql import functions as F

from tessera.operators.packing import pack_whole
from tessera.plans.registry import ORACLES, QUERIES


def test_every_document_is_in_a_batch_or_an_error(spark, tmp_path):
    rows = [(1, "x" * 92_120, "a"), (2, "x" * 92_121, "a"), (3, "short", "a"), (4, "ä" * 50_000, "b"), (5, None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    errors = QUERIES["request_packing_errors"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in errors.collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(2, 0, 92_121), (4, 0, 100_000)]
    assert got[0][4] == "exceeds request limit (92161 > 92160 bytes)"
    assert sum(r.n for r in QUERIES["request_packing"](spark, str(tmp_path)).collect()) + len(got) == len(rows)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.sql(f"SELECT {', '.join(errors.columns)} FROM ({ORACLES['request_packing_errors']})").fetchall()) == got


def sequential(rows, limit, envelope):
    """Batch of each (group, order, size), one row after another."""
    out, now = {}, {}
    for group, order, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        size = size or 0
        if envelope + size > limit:
            out[group, order] = 0
            continue
        batch, held = now.get(group, (0, limit))
        batch, held = (batch, held + 1 + size) if held + 1 + size <= limit else (batch + 1, envelope + size)
        now[group], out[group, order] = (batch, held), batch
    return out


def test_whole_groups_of_odd_sizes(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), i, rng.choice([0, 1, 5, 40, 59, 60, 61, 100, None])) for i in range(700)] + [("none", i, 0) for i in range(300)] + [("big", 1, 61), ("fits", 1, 60)]
    df = spark.createDataFrame(rows, "g string, o long, s long").withColumn("grp", F.lit("clash")).repartition(5)
    for limit, envelope in ((100, 40), (62, 2)):
        assert {(r.g, r.o): r.batch for r in pack_whole(df, "g", "o", "s", limit, envelope).collect()} == sequential(rows, limit, envelope)
    assert pack_whole(df.limit(0), "g", "o", "s", 100, 40).count() == 0


def test_one_source_of_many_rows(spark):
    """A million rows of one source, equal to the sequential packer's batches."""
    size = F.pmod(F.xxhash64("o"), F.lit(3000))
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("only").alias("g"), F.col("id").alias("o")).withColumn("s", size)
    mine = pack_whole(df, "g", "o", "s", 92_160, 40).groupBy("batch").agg(F.min("o"), F.max("o")).collect()
    batch, held, spans = 0, 10**9, {}
    for o, s in enumerate(df.orderBy("o").toArrow().column("s").to_pylist()):
        batch, held = (batch, held + 1 + s) if held + 1 + s <= 92_160 else (batch + 1, 40 + s)
        spans[batch] = (spans.get(batch, (o,))[0], o)
    assert {r[0]: (r[1], r[2]) for r in mine} == spans
