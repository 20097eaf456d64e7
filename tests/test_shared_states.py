"""Review states shared by many copies."""

import pytest
from test_review_stream import DDL, at

from tallyloom.streaming import events


@pytest.mark.parametrize("parts", [1, 3])
def test_copies_share_states(spark, tmp_path, parts):
    rows = [[(at(i), i, 1 + i % 50, 1, "AB"[i % 2], i % 3 > 0) for i in range(n, n + 120)] for n in (0, 60, 700)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in rows:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").json(source)
    copies = spark.createDataFrame([(k, "a") for k in range(1, 52)], "copy_key long, batch string")
    cells = spark.createDataFrame([(k, 1, c) for k in range(1, 51) for c in "AB"], "copy_key long, q int, ch string")
    totals = events.open_totals(copies, cells)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(source)
    events.changes_to(events.running_open_counts(stream, totals, "100 hours", parts=parts), out, state).awaitTermination()
    last = {}
    for part in rows:
        for ts, number, copy, _, ch, reviewed in part:
            last[copy, ch] = max(last.get((copy, ch), (ts, number, reviewed)), (ts, number, reviewed))
    want = {k: 2 - sum(last[k, c][2] for c in "AB" if (k, c) in last) for k in range(1, 51)} | {51: 0}
    got = events.open_counts_now(totals, events.latest_state(spark.read.parquet(out), ["copy_key"], ["n_decided"]))
    assert {r.copy_key: r.n_open for r in got.collect()} == want
