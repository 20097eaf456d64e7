"""Labels from one aggregation of bits."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as entry

from tallyloom.operators import evaluate

FOLDER = "/root/testdata/sf0.001"


def joins(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue().count("Join ")


def test_cells_are_joined_with_their_copies_alone(spark):
    assert joins(entry.queries()["k1_human_labels"](spark, FOLDER)) <= 1


def test_labels_of_seen_cells(spark):
    cell = "copy_key long, q int, ch string"
    copies = spark.createDataFrame([(1, True), (2, False)], "copy_key long, validated boolean")
    cells = spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (2, 1, "A"), (2, 1, "B"), (9, 1, "A")], cell)
    ticked, seen = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (2, 7, "A")], cell), spark.createDataFrame([(2, 1, "B"), (2, 1, "C")], cell)
    rows = evaluate.human_labels(copies, ticked, seen, cells).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "A", 1, "ui_validated"), (1, 1, "B", 0, "ui_validated"), (2, 1, "B", 1, "ui_reviewed")]
