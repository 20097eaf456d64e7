"""Review events: activity per time window, the running state of toggled cells, and what is left to review."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.text import cell_key


def activity(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Edits per window and batch; late events are accepted up to ``delay``.

    Works on a stream and on a table alike. The copy is first collapsed with the window, so that
    the busiest batch is reduced before its rows meet.
    """
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "batch").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "batch", "n_events", "last_ts")


def running_toggles(events: DataFrame) -> DataFrame:
    """Number of toggles and current parity of each edited cell; the state is one small row per cell."""
    counted = events.groupBy("copy_key", "q", "ch").agg(F.count("*").alias("n_toggles"))
    return counted.withColumn("flipped", F.col("n_toggles") % 2 == 1)


#: time of a decision whose order no longer matters
LONG_AGO = -(1 << 62)
OPEN_STATE = "copies array<long>, cells array<string>, times array<long>, ids array<long>, reviewed array<boolean>"
#: states that the copies are spread over by hash; a call to Python serves all copies of one
STATE_PARTS = 1 << 11
OPEN_COUNTS = "copy_key long, batch string, n_total long, n_open long, n_decided long, last_ts timestamp"


def open_totals(copies: DataFrame, open_cells: DataFrame) -> DataFrame:
    """What a review starts from: ``(copy_key, batch, cells)``, the cells of each copy that wait for a decision.

    A row holds the cells of one copy; copies with nothing to decide have an empty array.
    """
    waiting = open_cells.groupBy("copy_key").agg(F.array_sort(F.collect_set(cell_key("q", "ch"))).alias("cells"))
    return copies.select("copy_key", "batch").join(waiting, "copy_key", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))


def running_open_counts(events: DataFrame, totals: DataFrame, delay: str = "1 hour", parts: int = STATE_PARTS) -> DataFrame:
    """Open cells of each copy as its review events come, an update row per copy and micro-batch.

    ``events(ts, event_id, copy_key, q, ch, reviewed)`` is a stream; ``totals`` comes from ``open_totals``. The decision latest in
    (ts, event_id) stands, whatever the order of arrival, so events that come late or twice count as if they had come in
    order and once; those that come after the watermark (``delay``) are dropped. The copies share ``parts`` states by hash, fixed for a checkpoint, so that the
    calls to Python do not grow with the copies. When the watermark has passed all events of a state, the times leave it: whatever
    still comes is later than they are.
    """
    part = F.pmod(F.xxhash64("copy_key"), F.lit(parts)).alias("part")
    placed = events.select("ts", "event_id", "copy_key", cell_key("q", "ch").alias("cell"), "reviewed").join(totals, "copy_key").withColumn("part", part).withWatermark("ts", delay)

    def fold(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(k, c): (t, i, r) for k, c, t, i, r in zip(*state.get, strict=True)} if state.exists else {}
        if state.hasTimedOut:
            state.update(([k for k, _ in held], [c for _, c in held], [LONG_AGO] * len(held), [LONG_AGO] * len(held), [r for *_, r in held.values()]))
            return
        touched, last = {}, None
        for rows in pieces:
            if not len(rows):
                continue
            times = rows["ts"].astype("int64") if rows["ts"].dtype.kind == "M" else pd.to_datetime(rows["ts"]).astype("int64")
            for copy, cell, stamp, time, number, reviewed, cells, batch in zip(
                    *(rows[c].tolist() for c in ("copy_key", "cell", "ts")), times.tolist(), *(rows[c].tolist() for c in ("event_id", "reviewed", "cells", "batch")), strict=True):
                if (copy, cell) not in held or (time, number) > held[copy, cell][:2]:
                    held[copy, cell] = (time, number, bool(reviewed))
                before = touched.get(copy)
                touched[copy] = (cells, batch, stamp if before is None or stamp > before[2] else before[2])
            newest = rows["ts"].max()
            last = newest if last is None or newest > last else last
        if last is None:
            return
        state.update(([k for k, _ in held], [c for _, c in held], [t for t, *_ in held.values()], [i for _, i, _ in held.values()], [r for *_, r in held.values()]))
        now = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), now) + 1)
        decided = [sum(held[k, c][2] for c in cells if (k, c) in held) for k, (cells, *_) in touched.items()]
        sizes = [len(cells) for cells, *_ in touched.values()]
        yield pd.DataFrame({"copy_key": [*touched], "batch": [b for _, b, _ in touched.values()], "n_total": sizes, "n_open": [n - d for n, d in zip(sizes, decided, strict=True)],
                            "n_decided": decided, "last_ts": [t for *_, t in touched.values()]})

    return placed.groupBy("part").applyInPandasWithState(fold, OPEN_COUNTS, OPEN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def open_counts_now(totals: DataFrame, state: DataFrame) -> DataFrame:
    """``(copy_key, batch, n_total, n_open)`` of every copy: its last update, or all its cells if it had none."""
    decided = state.select("copy_key", "n_decided")
    start = totals.select("copy_key", "batch", F.size("cells").cast("long").alias("n_total"))
    return start.join(decided, "copy_key", "left").select("copy_key", "batch", "n_total", (F.col("n_total") - F.coalesce("n_decided", F.lit(0))).alias("n_open"))


def progress(counts: DataFrame) -> DataFrame:
    """Done and total, in cells and in copies, per batch and in all (``batch`` null)."""
    sums = counts.groupBy("batch", "n_total", "n_open").agg(F.count("*").alias("n"))  # counted values before the totals of a batch meet
    return sums.rollup("batch").agg(
        F.sum("n").alias("n_copies"), F.sum(F.when(F.col("n_open") == 0, F.col("n")).otherwise(0)).alias("n_finished"),
        F.sum(F.col("n") * F.col("n_total")).alias("n_total"), F.sum(F.col("n") * (F.col("n_total") - F.col("n_open"))).alias("n_done"))


def append_to(frame: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Closed windows appended to a table, each exactly once."""
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes_to(frame: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Updated rows of a running state, kept under their micro-batch: a rerun rewrites its own folder."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    writer = frame.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_state(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Last change of each key over all the micro-batches written."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in columns])
