"""Sheets whose numbers have several widths."""

import duckdb

import __spark_entry__ as entry
from tallyloom.operators import roster
from tallyloom.plans import QUERIES, Tables, twin_sql

FOLDER = "/root/testdata/sf0.001"


def test_summaries_equal_their_sql_where_six_digits_are_more_frequent(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE small AS SELECT * FROM '{FOLDER}/customer.parquet'")
    con.execute("CREATE TABLE customer AS SELECT * FROM small UNION ALL SELECT small.* REPLACE (c_custkey + 100000 * r AS c_custkey) FROM small, range(1, 4) t(r)")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    assert "d8_sheet_summaries" in entry.queries()
    found = QUERIES["d8_sheet_summaries"](Tables(spark, str(tmp_path))).select("sheet", "nrow", "ncol", "n_students").collect()
    want = con.execute(f"SELECT sheet, nrow, ncol, n_students FROM ({twin_sql('d8_sheet_summaries')})").fetchall()
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) == 5


def test_the_most_frequent_width_is_the_default(spark):
    lines = [["Num", "Nom"], ["12345", "A"], ["12346", "B"], ["12347", "C"], *[[str(100000 + i), "N"] for i in range(5)]]
    table = spark.createDataFrame([("s", i, c) for i, c in enumerate(lines)], "sheet string, row_no long, cells array<string>")
    assert [r.n_students for r in roster.sheet_summaries(table).collect()] == [5]
    assert [r.n_students for r in roster.sheet_summaries(table, 5).collect()] == [8]
