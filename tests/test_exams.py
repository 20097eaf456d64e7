"""Many exams in one pass against one run for each exam."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import exams, questions, review, scoring
from tallyloom.plans import Tables
from tallyloom.plans.exam_plans import items, keys, scored
from tallyloom.plans.review_plans import flags

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple("" if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("exam", [0, 7, 31])
def test_one_pass_equals_single_runs(spark, exam):
    t = Tables(spark, FOLDER)
    own = {n: getattr(t, n).filter(F.col("exam") == exam).drop("exam") for n in ("fx_exam_copy", "fx_exam_tick", "fx_exam_question", "fx_exam_option", "fx_exam_current")}
    assert own["fx_exam_copy"].count() > 0
    key = scoring.question_key(own["fx_exam_question"], own["fx_exam_option"])
    marked = scoring.score_questions(own["fx_exam_tick"], own["fx_exam_option"], key)
    one = lambda df: df.filter(F.col("exam") == exam).drop("exam")
    many, all_keys = scored(t), keys(t)
    assert rows(one(all_keys).drop("opts")) == rows(key.drop("opts"))
    assert rows(one(many)) == rows(marked)
    assert rows(one(exams.score_copies(t.fx_exam_copy, many, all_keys, 0.0))) == rows(scoring.score_copies(own["fx_exam_copy"], marked, key, 0.0))
    spread = questions.score_distribution(own["fx_exam_copy"], marked, key)
    by_exam = exams.score_distribution(t.fx_exam_copy, many, all_keys)
    assert rows(one(by_exam)) == rows(spread)
    assert rows(one(exams.question_stats(by_exam, all_keys))) == rows(questions.question_stats(spread, key))
    doubts = flags(t).join(own["fx_exam_copy"].select("copy_key"), "copy_key", "left_semi")
    judged = review.judged_cells(own["fx_exam_copy"], doubts, t.fx_exam_mark_cell, own["fx_exam_question"], own["fx_exam_option"])
    structure = review.structural_flags(own["fx_exam_copy"], own["fx_exam_current"], own["fx_exam_question"], own["fx_exam_option"])
    alone = review.review_items(own["fx_exam_copy"], judged, structure, review.reviewed_questions(t.fx_review_q))
    assert rows(items(t).join(own["fx_exam_copy"].select("copy_key"), "copy_key", "left_semi")) == rows(alone)


def test_exams_with_the_same_numbers_stay_apart(spark):
    copies = spark.createDataFrame([("x", 1, ""), ("x", 2, "a"), ("y", 3, "a"), ("y", 4, "b"), ("z", 5, "")], "exam string, copy_key long, grp string")
    asked = spark.createDataFrame([("x", 1, "single", "1", None, None, ""), ("x", 2, "mult", None, -1.0, None, "a"), ("y", 1, "single", "3", None, 2.0, "a"), ("y", 2, "single", "1", None, None, "")],
                                  "exam string, q int, qtype string, value string, lo double, hi double, grp string")
    options = spark.createDataFrame([(e, q, p, c, c == right, pts) for e, q, right, pts in (("x", 1, "A", "0"), ("x", 2, "B", "-2"), ("y", 1, "B", "0"), ("y", 2, "C", "0")) for p, c in enumerate("ABC", 1)],
                                    "exam string, q int, pos int, ch string, correct boolean, pts string")
    ticks = spark.createDataFrame([("x", 1, 1, "A"), ("x", 2, 1, "B"), ("x", 2, 2, "A"), ("y", 3, 1, "B"), ("y", 3, 2, "C"), ("y", 4, 1, "B"), ("y", 4, 2, "Z")], "exam string, copy_key long, q int, ch string")
    key = exams.question_keys(asked, options)
    total = exams.score_copies(copies, exams.score_questions(ticks, options, key), key)
    assert {r.copy_key: r.total for r in total.collect()} == {1: 1.0, 2: -1.0, 3: 3.0, 4: 0.0, 5: 0.0}
    assert {(r.exam, r.grp): r.total_max for r in exams.version_totals(key, copies).collect()} == {("x", ""): 1.0, ("x", "a"): -1.0, ("y", "a"): 4.0, ("y", "b"): 1.0}
    assert exams.score_copies(copies.limit(0), exams.score_questions(ticks, options, key), key).count() == 0


def test_no_plan_reads_a_single_value_back_or_crosses(spark):
    import io
    from contextlib import redirect_stdout

    t = Tables(spark, FOLDER)
    for df in (exams.score_copies(t.fx_exam_copy, scored(t), keys(t)), items(t)):
        with redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        assert "CartesianProduct" not in plan.getvalue() and "BroadcastNestedLoopJoin" not in plan.getvalue() and "Subquery" not in plan.getvalue()
