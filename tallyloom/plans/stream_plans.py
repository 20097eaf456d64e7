"""Streaming jobs run to the end over the given tables."""

from pyspark.sql import functions as F

from tallyloom.operators import review
from tallyloom.plans.registry import TWINS, query, view
from tallyloom.plans.review_plans import WHOLE, _cells_text, new_readings, old_copies, state_judged, whole_new, whole_old, whole_text
from tallyloom.schemas import BY_QUESTION
from tallyloom.session import durable, scratch_folder
from tallyloom.streaming import events, ingest


@query("s1_ingest_readings", TWINS["i16_preserve_human_work"])
def s1(t):
    incoming, store, state = (scratch_folder(t.spark, n) for n in ("incoming", "store", "state"))
    ingest.write_store(old_copies(t), store)
    new_readings(t).withColumn("answers", F.transform_keys("answers", lambda k, v: k.cast("string"))).write.option("compression", "gzip").json(incoming)
    ingest.ingest_readings(t.spark, incoming, store, state).awaitTermination()
    return ingest.read_store(t.spark, store).select(
        "page", "student_id", "student_name", _cells_text("answers").alias("answers"), _cells_text("cv_answers").alias("cv_answers"),
        F.array_join("flags", ";").alias("flags"), "student_override", "cv_student_id")


@query("s1_full_copy", WHOLE)
def s1_full(t):
    incoming, store, state = (scratch_folder(t.spark, n) for n in ("incoming", "store", "state"))
    ingest.write_store(whole_old(t), store)
    new = whole_new(t)
    maps = [c for c in BY_QUESTION if c in new.columns]
    new.withColumns({c: F.transform_keys(c, lambda k, v: k.cast("string")) for c in maps}).write.option("compression", "gzip").json(incoming)
    ingest.ingest_readings(t.spark, incoming, store, state).awaitTermination()
    return whole_text(ingest.read_store(t.spark, store))


def _events(t):
    """The event table as a stream."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    instant = F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp")  # whatever the session time zone
    return source.select(instant.alias("ts"), "event_id", F.col("user_id").alias("copy_key"), F.col("event_type").alias("batch"), "value")


@query("s2_activity", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type AS batch, count(*) AS n_events FROM events GROUP BY 1, 2)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, batch, n_events FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def s2_activity(t):
    out, state = scratch_folder(t.spark, "activity"), scratch_folder(t.spark, "state")
    events.append_to(events.activity(_events(t)), out, state).awaitTermination()
    return t.spark.read.parquet(out).select(F.unix_timestamp("window_start").alias("window_start"), "batch", "n_events")


@query("s2_running_toggles", """
SELECT copy_key, q, ch, count(*) AS n_toggles, count(*) % 2 = 1 AS flipped FROM fx_edit GROUP BY 1, 2, 3""")
def s2_toggles(t):
    out, state = scratch_folder(t.spark, "toggles"), scratch_folder(t.spark, "state")
    letter = F.substring(F.lit("ABCD"), (F.floor("value").cast("int") % 4 + 1), F.lit(1))
    edits = _events(t).filter("batch = 'click' AND value >= 0").select(
        "copy_key", (1 + F.col("event_id") % 7).cast("int").alias("q"), letter.alias("ch"))
    events.changes_to(events.running_toggles(edits), out, state).awaitTermination()
    return events.latest_state(t.spark.read.parquet(out), ["copy_key", "q", "ch"], ["n_toggles", "flipped"])


view("fx_decision", "SELECT ts, event_id, copy_key, q, ch, event_id % 3 > 0 AS reviewed FROM {fx_edit}")
view("fx_tw_open", """
WITH c AS (SELECT copy_key, q, ch FROM {fx_tw_judged} WHERE NOT reviewed),
d AS (SELECT copy_key, q, ch FROM (SELECT *, row_number() OVER (PARTITION BY copy_key, q, ch ORDER BY ts DESC, event_id DESC) AS rn FROM {fx_decision}) WHERE rn = 1 AND reviewed)
SELECT k.copy_key, k.batch, count(c.q) AS n_total, count(c.q) - count(d.q) AS n_open
FROM {fx_copy} k LEFT JOIN c ON c.copy_key = k.copy_key LEFT JOIN d ON d.copy_key = c.copy_key AND d.q = c.q AND d.ch = c.ch GROUP BY 1, 2""")


def _open_counts(t):
    """The stream of decisions run to its end over the cells that wait for one."""
    out, state = scratch_folder(t.spark, "open"), scratch_folder(t.spark, "state")
    waiting = durable(events.open_totals(t.fx_copy, review.open_cells(state_judged(t))))
    letter = F.substring(F.lit("ABCD"), (F.floor(F.abs("value")).cast("int") % 4 + 1), F.lit(1))
    decisions = _events(t).filter("batch = 'click'").select(
        "ts", "event_id", "copy_key", (1 + F.col("event_id") % 7).cast("int").alias("q"), letter.alias("ch"), (F.col("event_id") % 3 > 0).alias("reviewed"))
    events.changes_to(events.running_open_counts(decisions, waiting), out, state).awaitTermination()
    schema = t.spark.createDataFrame([], events.OPEN_COUNTS + ", batch_id long").schema
    last = events.latest_state(t.spark.read.schema(schema).parquet(out), ["copy_key"], ["n_decided"])
    return events.open_counts_now(waiting, last)


@query("s2_open_counts", "SELECT copy_key, batch, n_total, n_open FROM fx_tw_open")
def s2_open(t):
    return _open_counts(t)


@query("s2_progress", """
SELECT batch, count(*) AS n_copies, count(*) FILTER (n_open = 0) AS n_finished, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(sum(n_total - n_open) AS BIGINT) AS n_done FROM fx_tw_open GROUP BY ROLLUP (batch)""")
def s2_progress(t):
    return events.progress(_open_counts(t))
