"""Review work from one aggregation over the readings."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as entry

from tallyloom.operators import review

FOLDER = "/root/testdata/sf0.001"


def joins(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue().count("Join ")


def test_cells_meet_in_one_aggregation(spark):
    assert joins(entry.queries()["i5_item_context"](spark, FOLDER)) <= 7


def test_context_of_states_equals_the_rules(spark):
    from tallyloom.plans import Tables
    from tallyloom.plans import review_plans as plans

    t = Tables(spark, FOLDER)
    cells = plans.judged(t)
    want = review.item_context(plans.items(t, cells), t.fx_option, t.fx_current, cells)
    got = review.context_of_states(t.fx_vcopy, plans.states(t), t.fx_question, t.fx_option).select(*want.columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty() and not got.isEmpty()
    again = plans.state_judged(t)
    assert cells.exceptAll(again).isEmpty() and again.exceptAll(cells).isEmpty()


def test_measures_without_a_reading_and_repeats(spark):
    tick, none = spark.createDataFrame([(1, 1, "A"), (1, 1, "A")], "copy_key long, q int, ch string"), spark.createDataFrame([], "copy_key long, q int, ch string")
    kind = "copy_key long, q int, ch string, reasons array<string>, ratio double, masked double, proba double"
    doubt = spark.createDataFrame([(2, 1, "B", ["uncertain"], .5, None, .4), (2, 1, "B", ["uncertain"], .5, None, .4)], kind)
    marks = spark.createDataFrame([(3, "1_C"), (3, "1_C"), (3, "x_A")], "copy_key long, cell string")
    got = {(r.copy_key, r.q, r.ch): (r.s, r.m and r.m.proba) for r in review.cell_states(none, tick, none, doubt, marks).collect()}
    assert got == {(1, 1, "A"): (review.MACHINE, None), (2, 1, "B"): (0, .4), (3, 1, "C"): (review.MARKED, None)}
