"""Running open counts: late and repeated events, and states whose times were dropped."""

import datetime as dt
import os

import pytest

from tallyloom.streaming import events

DDL = "ts timestamp, event_id long, copy_key long, q int, ch string, reviewed boolean"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, delay="1 hour"):
    """Every batch as one file and one micro-batch, in turn; the last state of each copy."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").json(source)
        for name in os.listdir(source):
            path = os.path.join(source, name)
            if name.endswith(".json") and os.path.getmtime(path) > 1_000_000_000:
                os.utime(path, (1000 + i, 1000 + i))
    copies = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "copy_key long, batch string")
    cells = spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (1, 2, "A"), (2, 5, "C"), (3, 1, "A"), (3, 1, "A")], "copy_key long, q int, ch string")
    totals = events.open_totals(copies, cells)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(source)
    events.changes_to(events.running_open_counts(stream, totals, delay), out, state).awaitTermination()
    changes = spark.read.parquet(out)
    last = events.latest_state(changes, ["copy_key"], ["n_decided"])
    counts = events.open_counts_now(totals, last)
    return {r.copy_key: (r.n_total, r.n_open) for r in counts.collect()}, counts, changes


def test_order_of_arrival_and_repeats_change_nothing(spark, tmp_path):
    first = [(at(0), 1, 1, 1, "A", True), (at(9), 5, 1, 1, "B", True), (at(1), 2, 2, 5, "C", True), (at(2), 3, 3, 9, "Z", True), (at(2), 4, 77, 1, "A", True)]
    late = [(at(5), 3, 1, 1, "B", False), (at(0), 1, 1, 1, "A", True), (at(9), 4, 1, 1, "B", False), (at(3), 6, 2, 5, "C", False)]
    want = {1: (3, 0), 2: (1, 1), 3: (1, 1), 4: (0, 0)}
    more = [(at(10), 7, 1, 2, "A", True)]
    got, counts, changes = run(spark, tmp_path / "x", [first, late, more])
    assert got == want
    assert run(spark, tmp_path / "y", [more, late, first])[0] == want
    assert {r.batch: (r.n_copies, r.n_finished, r.n_total, r.n_done) for r in events.progress(counts).collect()} == {
        "a": (2, 1, 4, 3), "b": (2, 1, 1, 0), None: (4, 2, 5, 3)}
    steps = {(r.copy_key, r.batch_id): r.n_open for r in changes.collect()}
    assert steps[1, 0] == 1 and steps[2, 0] == 0 and steps[2, 1] == 1 and (3, 1) not in steps


def test_decisions_outlive_their_times_and_too_late_events_are_dropped(spark, tmp_path):
    first = [(at(0), 1, 1, 1, "A", True), (at(1), 2, 1, 1, "B", True)]
    far = [(at(600), 3, 2, 5, "C", True)]  # the watermark passes all that came before
    mover = [(at(1200), 4, 3, 1, "A", True)]
    after = [(at(1201), 5, 1, 1, "B", False), (at(2), 6, 1, 1, "A", False)]  # the second is far behind the watermark
    got, _, _ = run(spark, tmp_path, [first, far, mover, after], "1 minute")
    assert got == {1: (3, 2), 2: (1, 0), 3: (1, 0), 4: (0, 0)}


def test_no_events_leave_everything_open(spark, tmp_path):
    got, counts, _ = run(spark, tmp_path, [[(at(0), 1, 99, 1, "A", True)], [(at(1), 2, 1, 8, "A", True)]])
    assert got == {1: (3, 3), 2: (1, 1), 3: (1, 1), 4: (0, 0)}
    assert events.progress(counts.limit(0)).filter("batch is not null").count() == 0


@pytest.mark.parametrize("name", ["s2_open_counts", "s2_progress"])
def test_queries_run_over_an_empty_stream(spark, tmp_path, name):
    import shutil

    import __spark_entry__ as entry
    from tallyloom.plans.registry import TABLES

    for table in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{table}.parquet", tmp_path / f"{table}.parquet")
    spark.read.parquet(str(tmp_path / "events.parquet")).limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    os.remove(tmp_path / "events.parquet")
    part, = (tmp_path / "none").glob("*.parquet")
    shutil.copy(part, tmp_path / "events.parquet")
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert rows and all(r.n_open == r.n_total if name == "s2_open_counts" else r.n_done == 0 for r in rows)
