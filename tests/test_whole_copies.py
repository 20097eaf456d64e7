"""Whole copies: merged from sheets, read anew over human work, kept in the versioned store."""

import io
import json
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import merging
from tallyloom.plans import Tables
from tallyloom.plans.review_plans import new_readings, old_copies, whole_new, whole_old
from tallyloom.sources import documents
from tallyloom.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
DOUBTS = "array<struct<q:int,char:string,decision:boolean,ratio:double,masked:double,proba:double,reasons:array<string>>>"
SHEETS = f"""copy_group string, batch string, page long, sheet_page int, student_id string, answers map<int,array<string>>, ambiguous_cells {DOUBTS},
 open_answers map<int,struct<raw_text:string,score:double>>, notes string, n_frame_fail long, n_cells long, copy_id long, copy_id_source string, page_no int, sheet_source string, n_sheets int"""


def doubt(q, char):
    return (q, char, True, 0.4, None, 0.5, ["uncertain"])


def sheet(page, group="g", number=15, sid="", answers=None, doubts=None, free=None, notes=None, bad=0, cells=0):
    return (group, "b", page, number, sid, answers, doubts, free, notes, bad, cells, page, "scan", 1, "printed", 2)


def merged(spark, *sheets):
    return merging.merge_copies(spark.createDataFrame(list(sheets), SHEETS)).collect()


def test_parts_of_a_copy_are_united(spark):
    row, = merged(spark, sheet(2, number=16, answers={40: ["C"]}, doubts=[doubt(40, "B")], free={2: ("late", 1.0), 3: ("own", 0.0)}, notes="method=cv_frames", bad=1, cells=120),
                  sheet(1, answers={1: ["A"], 2: ["B"]}, doubts=[doubt(1, "A")], free={1: ("one", 1.0), 2: ("early", 0.0)}, notes="method=cv_full", bad=3, cells=100))
    assert row.answers == {1: ["A"], 2: ["B"], 40: ["C"]} and [(d.q, d.char) for d in row.ambiguous_cells] == [(1, "A"), (40, "B")]
    assert {q: a.raw_text for q, a in row.open_answers.items()} == {1: "one", 2: "late", 3: "own"}
    assert (row.page, row.n_frame_fail, row.n_cells, row.notes) == (1, 4, 220, "f15: method=cv_full | f16: method=cv_frames")
    assert [tuple(s) for s in row.sheets] == [("b", 1, 15), ("b", 2, 16)]


@pytest.mark.parametrize(("first", "second", "kept"), [("3021", "", "3021"), ("", "3021", "3021"), ("30?1", "3021", "3021"), ("3021", "30?1", "3021"), ("3021", "????", "3021"), ("1", "2", "1"), ("", None, "")])
def test_the_fullest_number_wins(spark, first, second, kept):
    row, = merged(spark, sheet(1, sid=first), sheet(2, sid=second))
    assert row.student_id == kept


def test_one_sheet_stays_as_it_is_and_no_sheets_give_no_copies(spark):
    row, = merged(spark, sheet(1, sid="3021", answers={1: ["A"]}, notes="method=cv_full"))
    assert (row.answers, row.student_id, row.notes, row.sheets, row.open_answers, row.ambiguous_cells) == ({1: ["A"]}, "3021", "method=cv_full", None, {}, [])
    assert merged(spark) == []


def test_differences_follow_the_options(spark):
    ddl = "a map<int,array<string>>, b map<int,array<string>>, o map<int,array<string>>"
    letters = {2: ["B", "A"], 1: ["A", "B"], 3: []}
    rows = spark.createDataFrame([({1: ["A"], 2: ["B", "Z"]}, {1: ["A", "B"]}, letters), ({}, {}, letters)], ddl).select(merging.cell_differences("a", "b", "o").alias("d")).collect()
    assert [[tuple(d) for d in r.d] for r in rows] == [[(1, "B", False, True), (2, "B", True, False)], []]


def canonical(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.select("batch", F.col("page").cast("long").alias("page"), *merging.WHOLE_COLUMNS).collect())


def test_whole_copies_read_twice_change_nothing_and_keep_typed_answers(spark):
    t = Tables(spark, FOLDER)
    old, new = whole_old(t), whole_new(t)
    once = merging.upsert_readings(old, new)
    assert canonical(merging.upsert_readings(once, new)) == canonical(once)
    rows = {r.page: r for r in once.collect()}
    typed = [r for r in rows.values() if any(a.manually_edited for a in (r.open_answers or {}).values())]
    assert typed and all(r.cv_open_answers != r.open_answers for r in typed if r.source == "cv")


# ---- the versioned store


def fill(spark, path, rows, ddl="batch string, page long, student_id string, answers map<int,array<string>>, flags array<string>"):
    ingest.write_store(spark.createDataFrame(rows, ddl), path)


def reading(spark, rows):
    ddl = "batch string, page long, student_id string, answers map<int,array<string>>, flags array<string>, sheets array<struct<batch:string,page:long,sheet_page:int>>, _time timestamp, _file string"
    return spark.createDataFrame([(*r, None, f"f{i}") for i, r in enumerate(rows)], ddl)


def pages(spark, path):
    return {(r.batch, r.page): r.student_id for r in ingest.read_store(spark, path).collect()}


def test_a_run_lost_before_the_manifest_leaves_the_old_copies(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert pages(spark, path) == {}
    fill(spark, path, [("a", 1, "1", {}, []), ("a", 20_001, "2", {}, []), ("b b=%", 1, "3", {}, [])])
    before = pages(spark, path)
    lost = ingest.committed_versions

    def failing(df, *a, **k):
        raise OSError("lost")

    batch = [("a", 1, "9", {1: ["A"]}, [], None), ("c", 5, "4", {}, [], None)]
    with monkeypatch.context() as m:
        frame = type(spark.range(1))
        m.setattr(frame, "withColumn", lambda self, name, column, real=frame.withColumn: failing(self) if name == "whole" else real(self, name, column))
        with pytest.raises(OSError, match="lost"):
            ingest.merge_batch(reading(spark, batch), path)
    assert (tmp_path / "store" / "data" / "v=1").exists() and lost(spark, path) == [0]
    assert pages(spark, path) == before == {("a", 1): "1", ("a", 20_001): "2", ("b b=%", 1): "3"}
    ingest.merge_batch(reading(spark, batch), path)
    ingest.merge_batch(reading(spark, batch), path)  # again, as after a lost commit of the stream
    assert pages(spark, path) == {**before, ("a", 1): "9", ("c", 5): "4"}


def test_a_micro_batch_reads_its_own_ranges_only(spark, tmp_path):
    path = str(tmp_path / "store")
    fill(spark, path, [("a", p, str(p), {}, []) for p in (1, 10_001, 20_001)] + [("b", 1, "x", {}, [])])
    fill(spark, path, [("a", 10_002, "new range", {}, [])])
    touched = spark.createDataFrame([("a", 1), ("z", 7)], "batch string, page_range long")
    rows = ingest.read_ranges(spark, path, touched)
    with redirect_stdout(io.StringIO()) as plan:
        rows.explain("formatted")
    scan = re.search(r"PartitionFilters: \[(.*)\]", plan.getvalue()).group(1)
    assert re.search(r"page_range#\d+L? (IN \(1\)|= 1)", scan) and re.search(r"batch#\d+ (IN \(a\)|= a)", scan)
    assert {re.search("/v=(\\d+)/", f).group(1) for f in rows.inputFiles()} == {"1"}
    assert [(r.batch, r.page) for r in rows.collect()] == [("a", 10_002)]
    assert pages(spark, path) == {("a", 1): "1", ("a", 10_002): "new range", ("a", 20_001): "20001", ("b", 1): "x"}
    assert ingest.read_ranges(spark, path, touched.filter("batch = 'z'")).count() == 0


def test_swallowed_pages_leave_the_store_and_empty_ranges_stay_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    fill(spark, path, [("a", 9_999, "1", {}, []), ("a", 10_000, "2", {}, []), ("a", 30_000, "3", {}, [])])
    ingest.merge_batch(reading(spark, [("a", 9_999, "7", {}, [], [("a", 9_999, 1), ("a", 10_000, 2)])]), path)
    assert pages(spark, path) == {("a", 9_999): "7", ("a", 30_000): "3"}


def test_whole_manifests_and_vacuum_keep_the_live_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "WHOLE_MANIFEST", 3)
    path = str(tmp_path / "store")
    for i in range(8):
        fill(spark, path, [("a", 10_000 * (i % 5), str(i), {}, [])])
    want = {("a", 10_000 * (i % 5)): str(i) for i in range(8)}
    assert pages(spark, path) == want and ingest.committed_versions(spark, path) == list(range(8))
    assert ingest.vacuum(spark, path) == [0, 1, 2] and pages(spark, path) == want
    assert ingest.committed_versions(spark, path) == [6, 7] and not (tmp_path / "store" / "data" / "v=0").exists()
    fill(spark, path, [("a", 0, "last", {}, [])])
    assert pages(spark, path) == {**want, ("a", 0): "last"}


def test_a_stream_of_whole_readings_equals_the_batch(spark, tmp_path):
    t = Tables(spark, FOLDER)
    store, incoming, state = (str(tmp_path / n) for n in ("store", "in", "state"))
    old, new = whole_old(t), whole_new(t)
    ingest.write_store(old, store)
    text = {c: F.transform_keys(c, lambda k, v: k.cast("string")) for c in ("answers", "amc_answers", "open_answers")}
    for part in range(2):
        new.withColumns(text).filter(F.col("page") % 2 == part).coalesce(1).write.mode("append").json(incoming)
    ingest.ingest_readings(spark, incoming, store, state, files_per_trigger=1).awaitTermination()
    stored = ingest.read_store(spark, store)
    assert stored.filter("open_answers is not null and size(ambiguous_cells) > 0").count() > 0
    # pages that are second sheets go when their copy is read; in two micro-batches they may have come anew before
    anew = new.select("batch", "page").join(merging.swallowed_pages(new), ["batch", "page"])
    other = lambda df: canonical(df.join(anew, ["batch", "page"], "left_anti"))
    assert other(stored) == other(merging.upsert_readings(old, new))


def test_documents_keep_doubts_sheets_and_free_answers(spark, tmp_path):
    body = {"student_id": "13021", "answers": {"3": ["A"]}, "open_answers": {"1": {"raw_text": "x", "score": 1, "manually_edited": True}, "bad": {}}, "_cv_open_answers": {"1": {"raw_text": "y"}},
            "_ambiguous_cells": [{"q": 3, "char": "A", "reasons": ["uncertain"]}], "_n_sheets": 2, "_sheets": [{"batch": "b1", "page": 1, "sheet_page": 15}, {"batch": "b1", "page": 2, "sheet_page": None}], "_page_no": 4}
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "page_001.json").write_text(json.dumps(body))
    row = documents.read_copies(spark, str(tmp_path))["copies"].first()
    assert list(row.open_answers) == [1] and row.open_answers[1].manually_edited and row.cv_open_answers[1].raw_text == "y"
    assert (row.n_sheets, row.page_no, [tuple(s) for s in row.sheets]) == (2, 4, [("b1", 1, 15), ("b1", 2, None)]) and row.ambiguous_cells[0].reasons == ["uncertain"]


def test_narrow_readings_still_merge(spark):
    t = Tables(spark, FOLDER)
    assert merging.upsert_readings(old_copies(t), new_readings(t)).columns == ["batch", "page", *merging.COPY_COLUMNS]


def exchanges(df):
    with redirect_stdout(io.StringIO()) as plan:
        df.explain()
    return plan.getvalue().count("Exchange hashpartitioning")


def test_letters_of_copies_take_one_shuffle_and_stored_ranges_none(spark, tmp_path):
    from tallyloom.plans.review_plans import _map

    ticks = spark.createDataFrame([(1, 2, "B"), (1, 2, "A"), (1, 2, "B"), (1, 5, "C"), (2, 1, "D")], "copy_key long, q int, ch string")
    letters = _map(ticks, "answers")
    assert exchanges(letters) == 1
    assert {r.copy_key: r.answers for r in letters.collect()} == {1: {2: ["A", "B"], 5: ["C"]}, 2: {1: ["D"]}}
    path = str(tmp_path / "store")
    fill(spark, path, [("a", p, str(p), {}, []) for p in (1, 10_001)])
    assert exchanges(ingest.read_ranges(spark, path, spark.createDataFrame([("a", 1)], "batch string, page_range long"))) == 0


def test_only_the_last_reading_of_a_page_swallows_others(spark, tmp_path):
    path = str(tmp_path / "store")
    fill(spark, path, [("a", 1, "1", {}, []), ("a", 2, "2", {}, []), ("a", 10_000, "3", {}, [])])
    ingest.merge_batch(reading(spark, [("a", 1, "8", {}, [], [("a", 1, 1), ("a", 2, 2)]), ("a", 1, "9", {}, [], [("a", 1, 1), ("a", 10_000, 2)]), ("b", 1, "4", {}, [], [("b", 1, 1), ("b", 2, 2)])]), path)
    assert pages(spark, path) == {("a", 1): "9", ("a", 2): "2", ("b", 1): "4"}


def test_a_second_reading_may_come_with_the_sheets(spark):
    rows = spark.createDataFrame([sheet(1, answers={1: ["A"]}), sheet(2, number=16, answers={2: ["B"]})], SHEETS).withColumns({
        "amc_copy": F.col("page"), "amc_answers": F.expr("map(1, array(if(page = 1, 'B', 'C')))"), "amc_validated_cells": F.lit(0).cast("long")})
    options = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "q int, pos int, ch string")
    joined = merging.fresh_copies(merging.merge_copies(rows.drop(*merging.SECOND)), rows.filter("page = 1").select("batch", "page", *merging.SECOND), options)
    carried = merging.fresh_copies(merging.merge_copies(rows), None, options)
    assert carried.collect() == joined.select(*carried.columns).collect() and [tuple(d) for d in carried.first().cv_amc_diff] == [(1, "A", True, False), (1, "B", False, True)]
