import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import merging
from tallyloom.plans import Tables
from tallyloom.plans.review_plans import new_readings, old_copies
from tallyloom.sources import documents, sinks, tables
from tallyloom.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("body", ["Titre\nid;nom\n1;MARTIN\n2;DURAND\n", "id,nom\n1,MARTIN\n2,DURAND\n", "﻿id\tnom\n1\tMARTIN\n2\tDURAND\n"])
def test_delimiters_titles_and_byte_order_marks(spark, tmp_path, body):
    path = tmp_path / "list.csv"
    path.write_text(body, encoding="utf-8")
    rows = [r["cells"] for r in tables.read_table(spark, str(path)).orderBy("row_no").collect()]
    assert ["1", "MARTIN"] in rows and ["2", "DURAND"] in rows
    assert ["id", "nom"] in rows


@pytest.mark.parametrize("body, rows", [
    ('1;"a\nb;c";x\n2;y\n', [["1", "a\nb;c", "x"], ["2", "y", None]]),
    ('1;"a\n\n;""q""\n";x;"\n";z\n2;"y;y";w\n', [["1", 'a\n\n;"q"\n', "x", "\n", "z"], ["2", "y;y", "w", None, None]]),
    ('1;"a;b"\n2;;\n', [["1", "a;b", None], ["2", None, None]]),
    ("", [])])
def test_width_and_rows_of_quoted_cells(spark, tmp_path, body, rows):
    path = tmp_path / "list.csv"
    path.write_text(body, encoding="utf-8")
    assert [r["cells"] for r in tables.read_table(spark, str(path)).orderBy("row_no").collect()] == rows


def test_a_sheet_cut_into_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "list.csv").write_text("".join(f"{i};n{i}\n" for i in range(3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r["row_no"], r["cells"][0]) for r in tables.read_table(spark, str(tmp_path / "list.csv")).orderBy("row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(i, str(i)) for i in range(3000)]


def test_a_missing_sheet_raises(spark, tmp_path):
    for sheet in ("A", "B"):
        (tmp_path / f"sheet={sheet}").mkdir()
        (tmp_path / f"sheet={sheet}" / "data.csv").write_text(f"{sheet};1\n")
    assert tables.read_table(spark, str(tmp_path), sheet="B").first()["cells"] == ["B", "1"]
    with pytest.raises(ValueError, match="no sheet 'C'; present: A, B"):
        tables.read_table(spark, str(tmp_path), sheet="C")
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, str(tmp_path / "roster.doc"))


def test_copies_are_read_from_their_folders(spark, tmp_path):
    for batch, page, body in (("b1", 1, {"student_id": "13021", "answers": {"3": ["A", "B"]}, "_flags": ["validated"]}), ("b2", 7, {"answers": {}})):
        (tmp_path / batch).mkdir(exist_ok=True)
        (tmp_path / batch / f"page_{page:03d}.json").write_text(json.dumps(body))
    (tmp_path / "b2" / "page_008.json").write_text('{"student_id": ')
    out = documents.read_copies(spark, str(tmp_path))
    rows = {(r["batch"], r["page"]): r for r in out["copies"].collect()}
    assert set(rows) == {("b1", 1), ("b2", 7)}
    assert rows[("b1", 1)]["answers"] == {3: ["A", "B"]} and rows[("b1", 1)]["flags"] == ["validated"]
    assert [(r["batch"], r["page"]) for r in out["unreadable"].collect()] == [("b2", 8)]


def test_exports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a;b", None), ("2", "", 3.5)], "id string, flags string, mark double")
    sinks.write_csv(rows, str(tmp_path / "out"), single_file=True)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("id").collect()
    assert [r["mark"] for r in back] == [None, "3.5"]


def test_log_is_appended(spark, tmp_path):
    row = spark.createDataFrame([("t", "a@x", "A", 1.0, "ok", "d" * 300)], "ts string, email string, name string, score double, status string, detail string")
    for _ in range(2):
        sinks.append_log(row, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(got) == 2 and len(got[0]["detail"]) == 200


def canonical(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.select("batch", "page", *merging.COPY_COLUMNS).collect())


def test_merging_readings_twice_changes_nothing(spark):
    t = Tables(spark, FOLDER)
    once = merging.upsert_readings(old_copies(t), new_readings(t))
    twice = merging.upsert_readings(once, new_readings(t))
    assert canonical(once) == canonical(twice)


def test_stream_equals_batch_whatever_the_arrival(spark, tmp_path):
    t = Tables(spark, FOLDER)
    store, incoming, state = (str(tmp_path / n) for n in ("store", "in", "state"))
    ingest.write_store(old_copies(t), store)
    fresh = new_readings(t).withColumn("answers", F.transform_keys("answers", lambda k, v: k.cast("string")))
    for part in range(2):
        fresh.filter(F.col("page") % 2 == part).coalesce(1).write.mode("append").json(incoming)
    ingest.ingest_readings(spark, incoming, store, state, files_per_trigger=1).awaitTermination()
    assert canonical(ingest.read_store(spark, store)) == canonical(merging.upsert_readings(old_copies(t), new_readings(t)))


def test_rows_keep_their_width_and_order(spark, tmp_path):
    folder = tmp_path / "sheet"
    folder.mkdir()
    (folder / "a.csv").write_text("".join(f"{i};x;y\n" for i in range(12)) + '99;a;b;LOST\n"q;q";"two\nlines ""q""";z\n', encoding="utf-8")
    (folder / "b.csv").write_text("100;m;n\n101;;o\n", encoding="utf-8")
    (folder / "c.csv").write_text("200;p;q\n" * 500, encoding="utf-8")
    rows = tables.read_table(spark, str(folder)).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(len(rows))) and len(rows) == 516
    cells = [r["cells"] for r in rows]
    assert cells[12] == ["99", "a", "b", "LOST"] and cells[13] == ["q;q", 'two\nlines "q"', "z", None]
    assert cells[0] == ["0", "x", "y", None] and cells[14:16] == [["100", "m", "n", None], ["101", None, "o", None]] and cells[-1][0] == "200"
