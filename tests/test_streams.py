"""Stateful streams over several micro-batches, with restarts and cut-off batches."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.leads import RETRIES, lease_outcomes
from tessera.plans.intake import deliveries
from tessera.plans.leads import lead_intake, submissions
from tessera.streaming.stateful import KEEP, committed, in_slices, in_turn, intake, leases, run_once, source

SF = "/root/testdata/sf0.001"
EVENTS = "key string, event_id long, at long, kind string, payload string, token long, receipt string, mode string"


def told(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


def test_lease_stream_with_a_restart(spark, tmp_path):
    """Two micro-batches, a stop, then two more from the stored state."""
    rows, folder = deliveries(spark, SF), str(tmp_path)
    middle = rows.agg(F.expr("percentile(at, 0.5)").cast("long")).first()[0]
    for part in (rows.filter(F.col("at") < middle), rows.filter(F.col("at") >= middle)):
        path = in_slices(part, "at", 2, folder)
        out = leases(source(spark, path, rows.schema))
        run_once(out, folder)
    assert len(list((tmp_path / "commits").iterdir())) >= 4
    assert told(committed(spark, folder, out.schema)) == told(lease_outcomes(rows))


def test_state_of_a_key_is_frozen_then_forgotten(spark, tmp_path):
    big = 2**53
    events = [
        ("a", big + 1, 1000, "claim", "p", None, None, "daily"), ("b", 5, 1001, "reserve", "p", None, None, "daily"), ("c", 7, 1002, "reserve", "p", None, None, None),
        ("a", big + 2, 1003, "accept", "p", big + 1, "r", None), ("b", 6, 1010, "claim", "p", None, None, "individual"), ("c", 8, 1003 + RETRIES, "claim", "p", None, None, None),
        ("z", 9, KEEP + 2000, "reserve", "p", None, None, None), ("z", 10, KEEP + 2010, "reserve", "p", None, None, None), ("a", 11, KEEP + 2020, "claim", "q", None, None, "individual"),
    ]
    for e in events:
        spark.createDataFrame([e], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    out = leases(source(spark, f"{tmp_path}/source", EVENTS), "0 seconds")
    run_once(out, str(tmp_path))
    got = {r.event_id: (r.outcome, r.mode) for r in committed(spark, str(tmp_path), out.schema).collect()}
    assert got == {big + 1: ("claimed", "daily"), big + 2: ("accepted", None), 5: ("reserved", None), 6: ("claimed", "daily"), 7: ("reserved", None), 8: ("manual", None),
                   9: ("reserved", None), 10: ("reserved", None), 11: ("claimed", "individual")}


def test_intake_after_a_batch_that_was_cut_off(spark, tmp_path):
    rows, folder = submissions(spark, SF).select("event_id", "key", "payload"), str(tmp_path)
    out = intake(source(spark, in_slices(rows, "event_id", 3, folder), rows.schema))

    def cut(number):
        if number == 1:
            raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        run_once(out, folder, cut)
    assert 0 < committed(spark, folder, out.schema).count() < rows.count()
    run_once(out, folder)
    assert told(committed(spark, folder, out.schema)) == told(lead_intake(spark, SF))
    run_once(out, folder)
    assert committed(spark, folder, out.schema).count() == rows.count()


def test_empty_stream(spark, tmp_path):
    rows = deliveries(spark, SF).limit(0)
    out = leases(source(spark, in_slices(rows, "at", 2, str(tmp_path)), rows.schema))
    run_once(out, str(tmp_path))
    assert committed(spark, str(tmp_path), out.schema).count() == 0


def test_slices_are_written_by_many_tasks_and_kept_apart(spark, tmp_path):
    """A micro-batch of several files each: one task wrote all of a slice before."""
    rows, folder = submissions(spark, SF).select("event_id", "key", "payload").repartition(3), str(tmp_path)
    got = in_turn(rows, "event_id", 2, folder, intake)
    assert len(list((tmp_path / "source").glob("*.parquet"))) > 2 and len(list((tmp_path / "commits").iterdir())) == 2
    assert told(got) == told(lead_intake(spark, SF))
