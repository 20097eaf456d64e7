import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import answers, numbers, text
from tallyloom.operators import cohort, marks, scoring, stats

QUESTIONS = "q int, qtype string, value string, lo double, hi double, grp string"
OPTIONS = "q int, pos int, ch string, correct boolean, pts string"


def exam(spark):
    questions = spark.createDataFrame([
        (1, "single", "2", None, None, ""), (2, "mult", None, None, None, ""), (3, "mult", None, -0.25, 0.5, "morning"),
        (4, "mult", None, None, None, "afternoon"), (5, "single", "", 0.25, None, "morning")], QUESTIONS)
    options = spark.createDataFrame([
        (1, 1, "A", True, "0"), (1, 2, "B", False, "0"), (2, 1, "A", True, "1/2"), (2, 2, "B", True, "1/2"), (2, 3, "C", False, "-1/3"),
        (3, 1, "A", True, "1"), (3, 2, "B", False, "-1"), (4, 1, "A", True, "1"), (4, 2, "B", False, "n/a"), (5, 1, "A", True, "0"), (5, 2, "B", False, "0")], OPTIONS)
    return questions, options, scoring.question_key(questions, options)


def total(spark, ticks, grp, floor=None):
    questions, options, key = exam(spark)
    cells = spark.createDataFrame([("c", q, ch) for q, ch in ticks] or [("other", 1, "A")], "copy_key string, q int, ch string")
    copies = spark.createDataFrame([("c", grp)], "copy_key string, grp string")
    return scoring.score_copies(copies, scoring.score_questions(cells, options, key), key, floor).first()["total"]


def test_marks(spark):
    assert total(spark, [(1, "A"), (2, "A"), (2, "B"), (3, "A"), (5, "A")], "morning") == 2 + 1 + 0.5 + 1
    # a blank copy still gets the floor of question 5
    assert total(spark, [], "morning") == 0.25
    assert total(spark, [], "afternoon") == 0.0
    # repeated, unknown letters and questions of the other version change nothing
    assert total(spark, [(1, "A"), (1, "A"), (1, "Z"), (4, "A"), (3, "B")], "afternoon") == 2.0
    assert total(spark, [(2, "C")], "afternoon") == round(-1 / 3, 4)
    assert total(spark, [(2, "C")], "afternoon", floor=0.0) == 0.0
    # an unreadable point voids question 4
    assert total(spark, [(4, "A")], "afternoon") == 0.0


def test_self_check(spark):
    _, _, key = exam(spark)
    rows = {r["q"]: r for r in scoring.self_check(key).collect()}
    assert rows[1]["perfect"] == 2.0 and rows[1]["all_ticked"] == 0.0
    assert rows[2]["perfect"] == rows[2]["max_score"] == 1.0 and rows[2]["one_wrong"] < 0


def test_row_order_does_not_matter(spark):
    questions, options, key = exam(spark)
    ticks = [(f"c{i % 7}", i % 5 + 1, "AB"[i % 2]) for i in range(60)]
    copies = spark.createDataFrame([(f"c{i}", "morning") for i in range(7)], "copy_key string, grp string")
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(ticks)
        cells = spark.createDataFrame(ticks, "copy_key string, q int, ch string").repartition(3)
        found.append(sorted(tuple(r) for r in scoring.score_copies(copies, scoring.score_questions(cells, options, key), key).collect()))
    assert found[0] == found[1]


def test_the_cap_comes_before_the_mean(spark):
    raws = spark.createDataFrame([("1", "qcm", 31.0), ("1", "project", 14.0)], "id string, key string, raw double")
    columns = spark.createDataFrame([("qcm", 30.0, 20.0, 1.0), ("project", 20.0, 20.0, 1.0)], "key string, norm double, max double, weight double")
    row = marks.finals(marks.rescaled_marks(raws, columns), 20.0).first()
    assert row["final"] == 17.0 and row["n_columns"] == 2


def test_absent_rows_have_no_mark(spark):
    copies = spark.createDataFrame([
        ("b1", 1, "1", "ZOLA Émile", "", "1", 3.0, 3.0, True, ["validated"]), ("b1", 2, "2", "ADAM Ève", "", "2", 4.0, 4.0, False, [])],
        "batch string, page int, id string, name string, email string, id_read string, raw double, mark double, validated boolean, flags array<string>")
    gone = spark.createDataFrame([("3", "MOREL", "Jean", "")], "id string, nom string, prenom string, email string")
    rows = marks.student_rows(copies, gone)
    assert [r["name"] for r in rows.collect()] == ["ADAM Ève", "MOREL Jean", "ZOLA Émile"]
    written = {r["id_canonique"]: r for r in marks.export_rows(rows).collect()}
    assert written["3"]["note_finale"] == "ABS" and written["3"]["validee"] == "" and written["1"]["validee"] == "oui"
    assert marks.exam_summary(rows).first().asDict() == {"n_students": 3, "n_copies": 2, "n_absent": 1, "n_validated": 1, "n_unlinked": 0}


def test_series_stats_match_a_sorted_list(spark):
    rng = random.Random(5)
    values = [round(rng.choice([1.5, 2.25, rng.random() * 20]), 3) for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 4.0)], "k string, v double").repartition(6)
    got = {r["k"]: r for r in stats.series_stats(df, ["k"], "v").collect()}
    assert got["a"]["median"] == sorted(values)[250] and got["a"]["n"] == 501
    assert got["b"]["median"] == 2.5 and got["b"]["std"] == 1.5


def test_expressions(spark):
    row = spark.sql("select 1").select(
        text.norm_name(F.lit("Éléonore  d'Ŀœ-ﬁ́n")).alias("norm"), text.fold(F.lit(" Régression  LINÉAIRE ½ Й")).alias("fold"),
        text.slug(F.lit("  Été à la plage !! ")).alias("slug"), text.slug(F.lit("…")).alias("empty"),
        numbers.coerce_float(F.lit(" 12,5 ")).alias("mark"), numbers.coerce_float(F.lit("NaN")).alias("nan"), numbers.coerce_float(F.lit("")).alias("blank"),
        numbers.frac(F.lit("-1/3")).alias("third"), numbers.frac(F.lit("1/0")).alias("zero"),
        numbers.score_text(F.lit(4.5)).alias("short"), numbers.score_text(F.lit(5.0)).alias("whole"), numbers.score_text(F.lit(100.0), 0).alias("hundred"),
        numbers.general_text(F.lit(33.0)).alias("g"), numbers.general_text(F.lit(0.1 + 0.2)).alias("g3"),
        numbers.rescale(F.lit(-3.0), F.lit(30.0), F.lit(20.0)).alias("negative"), text.cell_text(F.lit("13021.0")).alias("cell"),
        answers.match_answer(F.lit(" 3,14 "), ["3.15"], "numeric_tol").alias("near"), answers.match_answer(F.lit("x"), []).alias("none")).first()
    assert row["norm"] == "eleonore d l fin" and row["fold"] == "regression lineaire 1⁄2 и"
    assert row["slug"] == "ete-a-la-plage" and row["empty"] == "untitled"
    assert row["mark"] == 12.5 and row["nan"] is None and row["blank"] is None
    assert abs(row["third"] + 1 / 3) < 1e-12 and row["zero"] is None
    assert (row["short"], row["whole"], row["hundred"], row["g"], row["g3"]) == ("4.5", "5", "100", "33", "0.3")
    assert row["negative"] == -2.0 and row["cell"] == "13021" and row["near"] is True and row["none"] is False


def test_folding_equals_the_unicode_tables(spark):
    import unicodedata
    letters = "".join(chr(c) for c in list(range(0xA0, 0x250)) + list(range(0x370, 0x500)) + list(range(0x1E00, 0x1F00)) + list(range(0xFB00, 0xFB07)))
    words = [letters[i:i + 7] for i in range(0, len(letters), 7)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.strip_accents("w").alias("s")).collect()
    for r in rows:
        want = "".join(c for c in unicodedata.normalize("NFKD", r["w"]) if not unicodedata.combining(c))
        assert r["s"] == want, (r["w"], r["s"], want)


def test_folding_looks_up_special_characters_only(spark):
    long = "é" + "x" * 5000
    row = spark.createDataFrame([(f"{long}ﬁ½{long}😀ﬁ", long)], "t string, plain string").select(
        F.size(text.multi_pieces(F.col("t"))).alias("n"), F.size(text.multi_pieces(F.col("plain"))).alias("one"), text.strip_accents("t").alias("s")).first()
    assert 5 <= row["n"] <= 6 and row["one"] == 1
    assert row["s"] == "e" + "x" * 5000 + "fi1⁄2e" + "x" * 5000 + "😀fi"


def test_templates_are_checked_before_any_row():
    import pytest
    with pytest.raises(ValueError, match=r"\$nobody"):
        text.render("Dear $nobody", {})
    with pytest.raises(ValueError, match="lone"):
        text.render("5$ fee", {})


def test_unlinked_copies_are_counted_apart(spark):
    rows = spark.createDataFrame([("a", 0, 1, "", "?", "", 1.0, False), ("a", 0, 2, "11", "X", "", 2.0, False), ("b", 1, 1, "", "?", "", None, True)],
                                 "path string, exam_ord long, ord long, id string, name string, email string, raw double, absent boolean")
    assert cohort.unlinked(rows).first()["n_unlinked"] == 1


@pytest.mark.parametrize("name", ["k6_train_and_predict", "k7_model_scores", "k22_permutation_importance"])
def test_model_queries_fit_all_rounds_and_score_other_copies(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from tallyloom.operators import model

    rounds, learnt, scored = [], [], []
    copies = {r.copy_key for r in entry.Tables(spark, "/root/testdata/sf0.001").fx_cell.select("copy_key").distinct().collect()}

    def copies_of(data):
        return {r.copy_key for r in data.select("copy_key").distinct().collect()}

    def train(data, features, max_iter=model.MAX_ITER, seed=42):
        rounds.append(max_iter)
        learnt.append(copies_of(data))
        return fit(data, features, 1, seed)

    def seen(fn):
        return lambda fitted, data, *rest, **named: scored.append(copies_of(data)) or fn(fitted, data, *rest, **named)

    fit = model.train
    monkeypatch.setattr(model, "train", train)
    monkeypatch.setattr(model, "predict", seen(model.predict))
    monkeypatch.setattr(model, "permutation_importance", seen(model.permutation_importance))
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert rounds and set(rounds) == {300}
    assert all(a and b and not a & b and a | b == copies for a, b in zip(learnt, scored, strict=True))


def test_equal_cells_are_learnt_from_once_with_their_number(spark, monkeypatch):
    from tallyloom.operators import model

    seen = []
    fit = model.Pipeline.fit
    monkeypatch.setattr(model.Pipeline, "fit", lambda pipe, data, *rest: seen.append(data) or fit(pipe, data, *rest))
    cells = spark.range(900).selectExpr("id AS copy_key", "1 AS q", "'A' AS ch", "CAST(id % 3 > 0 AS int) AS label",
                                        "CASE WHEN id % 3 = 0 THEN 0.1D WHEN id % 9 = 1 THEN double('NaN') ELSE 0.7D END AS ratio")
    fitted = model.train(cells, ["ratio"], 3)
    assert seen[0].count() == 3
    assert sum(r["_weight"] for r in seen[0].collect()) == 900
    assert model.predict(fitted, cells, ["ratio"]).filter("label <> prediction").count() == 0
    lost = model.permutation_importance(fitted, cells, ["ratio"], repeats=4).first()
    assert 0.3 < lost["importance"] < 0.6
