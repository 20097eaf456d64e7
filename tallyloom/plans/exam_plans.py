"""Hundreds of exams of very unequal size scored and reviewed in one pass."""

from pyspark.sql import functions as F

from tallyloom.operators import exams, review
from tallyloom.plans.registry import query, view
from tallyloom.plans.review_plans import flags

# one exam holds a third of all copies
view("fx_exam_copy", """
SELECT o_orderkey AS copy_key, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % 199 END AS exam,
       CASE WHEN o_orderkey % 2 = 0 THEN 'morning' ELSE 'afternoon' END AS grp, o_orderkey % 11 = 0 AS validated
FROM {orders}""")
view("fx_exam_tick", """
SELECT c.exam, c.copy_key, r.q, r.ch FROM {fx_response} r JOIN {fx_exam_copy} c ON c.copy_key = r.copy_key""")
# each exam asks the questions that its copies answered, each with points, bounds and group of its own
view("fx_exam_question", """
SELECT exam, q, CASE WHEN (q + exam) % 2 = 0 THEN 'mult' ELSE 'single' END AS qtype, CASE (q + exam) % 3 WHEN 0 THEN '1' WHEN 1 THEN '1/2' ELSE '2' END AS value,
       CASE WHEN exam % 5 = 1 THEN CAST(-0.5 AS DOUBLE) END AS lo, CASE WHEN exam % 4 = 2 THEN CAST(0.75 AS DOUBLE) END AS hi,
       CASE (q + exam) % 4 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' ELSE '' END AS grp
FROM (SELECT DISTINCT exam, q FROM {fx_exam_tick}) asked""")
view("fx_exam_option", """
SELECT q.exam, q.q, o.pos, o.ch, (o.pos + q.q + q.exam) % 4 IN (0, CASE WHEN q.qtype = 'mult' THEN 1 ELSE 0 END) AS correct,
       CASE WHEN (o.pos + q.q + q.exam) % 4 IN (0, 1) THEN '1/2' WHEN q.exam % 17 = 3 AND o.pos = 2 THEN 'n/a' ELSE '-1/4' END AS pts
FROM {fx_exam_question} q JOIN {fx_option} o ON o.q = q.q""")
view("fx_exam_current", "SELECT c.exam, c.copy_key, r.q, r.ch FROM {fx_current} r JOIN {fx_exam_copy} c ON c.copy_key = r.copy_key")
view("fx_exam_mark_cell", "SELECT copy_key, q, ch FROM {fx_decision} WHERE reviewed GROUP BY 1, 2, 3")

view("fx_tw_exam_key", """
SELECT q.exam, q.q, q.qtype, q.grp, CASE q.value WHEN '1/2' THEN 0.5::DOUBLE ELSE CAST(q.value AS DOUBLE) END AS value, q.lo, q.hi, string_agg(o.ch, '' ORDER BY o.ch) FILTER (o.correct) AS correct,
  bool_and(o.pts <> 'n/a') AS readable, CASE WHEN q.qtype = 'single' THEN CASE q.value WHEN '1/2' THEN 0.5::DOUBLE ELSE CAST(q.value AS DOUBLE) END
  ELSE round(coalesce(sum(CASE o.pts WHEN '1/2' THEN 0.5::DOUBLE WHEN '-1/4' THEN -0.25 END) FILTER (o.correct), 0), 6) END AS max_score
FROM {fx_exam_question} q JOIN {fx_exam_option} o ON o.exam = q.exam AND o.q = q.q GROUP BY q.exam, q.q, q.qtype, q.grp, q.value, q.lo, q.hi""")
view("fx_tw_exam_score", """
SELECT c.exam, c.copy_key, c.grp, k.q, k.max_score, least(greatest(CASE WHEN k.qtype = 'single' THEN CASE WHEN coalesce(s.sel, '') = k.correct THEN k.value ELSE 0 END
   WHEN NOT k.readable THEN 0 ELSE round(coalesce(s.pts, 0), 6) END, k.lo), k.hi) AS score
FROM {fx_exam_copy} c JOIN {fx_tw_exam_key} k ON k.exam = c.exam AND k.grp IN ('', c.grp)
LEFT JOIN (SELECT t.exam, t.copy_key, t.q, string_agg(t.ch, '' ORDER BY t.ch) AS sel, sum(CASE o.pts WHEN '1/2' THEN 0.5::DOUBLE WHEN '-1/4' THEN -0.25 END) AS pts
           FROM {fx_exam_tick} t JOIN {fx_exam_option} o ON o.exam = t.exam AND o.q = t.q AND o.ch = t.ch GROUP BY 1, 2, 3) s
  ON s.exam = c.exam AND s.copy_key = c.copy_key AND s.q = k.q""")
view("fx_tw_exam_judged", """
SELECT c.exam, f.copy_key, f.q, f.ch, f.proba, c.validated OR r.q IS NOT NULL AS reviewed FROM {fx_tw_flag} f JOIN {fx_exam_copy} c ON c.copy_key = f.copy_key
JOIN {fx_exam_question} q ON q.exam = c.exam AND q.q = f.q AND q.grp IN ('', c.grp) LEFT JOIN {fx_exam_mark_cell} r ON r.copy_key = f.copy_key AND r.q = f.q AND r.ch = f.ch""")
view("fx_tw_exam_structure", """
SELECT * FROM (SELECT c.exam, c.copy_key, q.q, c.validated, CASE WHEN count(r.ch) = 0 THEN 'no_answer' WHEN count(r.ch) > 1 THEN 'multi_answer' END AS reason
 FROM {fx_exam_copy} c JOIN {fx_exam_question} q ON q.exam = c.exam AND q.grp IN ('', c.grp) AND q.qtype = 'single'
 LEFT JOIN {fx_exam_current} r ON r.copy_key = c.copy_key AND r.q = q.q GROUP BY 1, 2, 3, 4) WHERE reason IS NOT NULL""")
view("fx_tw_exam_review", """
SELECT coalesce(c.copy_key, s.copy_key) AS copy_key, coalesce(c.q, s.q) AS q, s.reason, coalesce(c.n, 0) + CASE WHEN s.reason IS NULL THEN 0 ELSE 1 END AS n_flagged,
  coalesce(c.o, 0) + coalesce(s.o, 0) AS n_open, coalesce(c.risk, 0) + coalesce(s.o, 0) AS risk, round(greatest(c.doubt, CASE WHEN s.reason IS NOT NULL THEN 0.5::DOUBLE END), 4) AS ambiguity
FROM (SELECT copy_key, q, count(*) AS n, count(*) FILTER (NOT reviewed) AS o, sum(CASE WHEN reviewed THEN 0 ELSE 1 + u END) AS risk, max(u) AS doubt
      FROM (SELECT *, CASE WHEN proba IS NULL THEN 0.5 ELSE 1 - abs(2 * proba - 1) END AS u FROM {fx_tw_exam_judged}) GROUP BY 1, 2) c
FULL JOIN (SELECT t.copy_key, t.q, t.reason, CASE WHEN t.validated OR d.q IS NOT NULL THEN 0 ELSE 1 END AS o FROM {fx_tw_exam_structure} t
      LEFT JOIN (SELECT DISTINCT copy_key, CAST(question AS INT) AS q FROM {fx_review_q} WHERE question <> 'bad') d ON d.copy_key = t.copy_key AND d.q = t.q) s ON s.copy_key = c.copy_key AND s.q = c.q""")


def keys(t):
    return exams.question_keys(t.fx_exam_question, t.fx_exam_option)


def scored(t):
    return exams.score_questions(t.fx_exam_tick, t.fx_exam_option, keys(t))


def items(t):
    judged = exams.judged_cells(t.fx_exam_copy, flags(t), t.fx_exam_mark_cell, t.fx_exam_question, t.fx_exam_option)
    structure = exams.structural_flags(t.fx_exam_copy, t.fx_exam_current, t.fx_exam_question, t.fx_exam_option)
    return review.review_items(t.fx_exam_copy, judged, structure, review.reviewed_questions(t.fx_review_q))


@query("c5_max_by_exam", "SELECT exam, q, max_score FROM fx_tw_exam_key")
def c5(t):
    return keys(t).select("exam", "q", "max_score")


@query("c6_version_totals_by_exam", """
SELECT v.exam, v.grp, round(sum(k.max_score), 6) AS total_max FROM (SELECT DISTINCT exam, grp FROM fx_exam_copy) v JOIN fx_tw_exam_key k ON k.exam = v.exam AND k.grp IN ('', v.grp) GROUP BY 1, 2""")
def c6(t):
    return exams.version_totals(keys(t), t.fx_exam_copy)


@query("c13_by_exam", "SELECT c.exam, c.copy_key, c.grp, round(coalesce(sum(s.score), 0), 4) AS total FROM fx_exam_copy c LEFT JOIN fx_tw_exam_score s ON s.copy_key = c.copy_key GROUP BY 1, 2, 3")
def c13(t):
    return exams.score_copies(t.fx_exam_copy, scored(t), keys(t))


@query("h1_by_exam", """
SELECT exam, q, max_score, count(*) AS n_eval, count(*) FILTER (score >= max_score - 1e-9::DOUBLE) AS n_perfect, round(avg(score), 6) AS mean_score, round(avg(score) / max_score, 6) AS mean_normalized
FROM fx_tw_exam_score WHERE max_score > 0 GROUP BY 1, 2, 3""")
def h1(t):
    key = keys(t)
    stats = exams.question_stats(exams.score_distribution(t.fx_exam_copy, scored(t), key), key)
    return stats.select("exam", "q", "max_score", "n_eval", "n_perfect", F.round("mean_score", 6).alias("mean_score"), F.round("mean_normalized", 6).alias("mean_normalized"))


@query("i5_by_exam", "SELECT c.exam, r.copy_key, r.q, reason, n_flagged, n_open, round(risk, 6) AS risk, ambiguity FROM fx_tw_exam_review r JOIN fx_exam_copy c ON c.copy_key = r.copy_key")
def i5(t):
    return items(t).join(t.fx_exam_copy.select("exam", "copy_key"), "copy_key").withColumn("risk", F.round("risk", 6))


@query("i7_progress_by_exam", """
SELECT exam, count(*) AS n_copies, count(r.copy_key) AS n_listed, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n_open
FROM fx_exam_copy c LEFT JOIN (SELECT copy_key, sum(n_open) AS n FROM fx_tw_exam_review GROUP BY 1) r ON r.copy_key = c.copy_key GROUP BY 1""")
def i7(t):
    return exams.exam_progress(t.fx_exam_copy, review.copy_review(items(t)))
