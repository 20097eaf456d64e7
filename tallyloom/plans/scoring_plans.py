"""Scoring queries over the copies (orders), the readings (line items) and the question stock (parts)."""

from pyspark.sql import functions as F

from tallyloom.operators import scoring
from tallyloom.plans.registry import query, view

view("fx_item", """
SELECT p_partkey AS q, p_brand AS subject, CASE WHEN p_size % 2 = 0 THEN 'single' ELSE 'mult' END AS qtype,
       CASE p_size % 4 WHEN 0 THEN '1' WHEN 2 THEN '1/2' ELSE '' END AS value,
       CASE WHEN p_size % 7 = 0 THEN CAST(-1.0 AS DOUBLE) END AS lo, CASE WHEN p_size % 11 = 0 THEN CAST(0.75 AS DOUBLE) END AS hi,
       CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'morning' ELSE 'afternoon' END AS grp
FROM {part}""")

view("fx_item_option", """
SELECT l_partkey AS q, l_linenumber AS pos, substr('ABCDEFG', l_linenumber, 1) AS ch, max(l_returnflag) = 'R' AS correct,
       CASE WHEN max(l_quantity) >= 50 THEN 'n/a' WHEN max(l_returnflag) = 'R' THEN '1/2' ELSE '-1/4' END AS pts
FROM {lineitem} GROUP BY l_partkey, l_linenumber""")

view("fx_item_layout", """
SELECT DISTINCT l_suppkey AS copy, l_partkey AS q, l_linenumber AS pos, substr('BADCFEG', l_linenumber, 1) AS ch
FROM {lineitem}""")

view("fx_version", """
SELECT s_nationkey AS subject, concat('v', CAST(s_suppkey AS STRING)) AS vid,
       CASE WHEN s_suppkey % 2 = 0 THEN 'morning' ELSE 'afternoon' END AS grp,
       CAST(floor(s_acctbal / 100) AS INT) AS num_copies, s_suppkey AS ord
FROM {supplier}""")

view("fx_box", """
SELECT DISTINCT l_orderkey AS copy, l_linenumber AS num,
       CASE WHEN l_linenumber = 6 THEN CAST(CAST(floor(l_quantity) AS INT) % 10 AS STRING)
            ELSE substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) END AS ch
FROM {lineitem}""")

# printed names and document questions of the layout of `fx_box`
view("fx_box_name", """
SELECT * FROM (VALUES (1,'t1'), (2,'t2'), (3,'dup'), (4,'dup'), (5,'bareme-b5'), (6,'etu[1]')) AS t(num, name)""")
view("fx_box_question", """
SELECT * FROM (VALUES (1,'t1',1), (2,'t2',2), (3,'t9',1), (4,'dup',2)) AS t(q, tag, n_answers)""")

# twin side: key, and the score of every question of every copy
view("fx_tw_option", """
SELECT q, pos, ch, correct, CASE WHEN contains(pts, '/') THEN CAST(split_part(pts, '/', 1) AS DOUBLE) / CAST(split_part(pts, '/', 2) AS DOUBLE)
   ELSE CAST(pts AS DOUBLE) END AS p FROM {fx_option}""")
view("fx_tw_key", """
SELECT q.q, q.qtype, q.grp, CASE WHEN q.pts = '1/2' THEN 0.5::DOUBLE ELSE CAST(q.pts AS DOUBLE) END AS value,
  CAST(q.lo AS DOUBLE) AS lo, CAST(q.hi AS DOUBLE) AS hi, string_agg(o.ch, '' ORDER BY o.ch) FILTER (o.correct) AS correct,
  CASE WHEN q.qtype = 'single' THEN CASE WHEN q.pts = '1/2' THEN 0.5::DOUBLE ELSE CAST(q.pts AS DOUBLE) END
       ELSE round(coalesce(sum(o.p) FILTER (o.correct), 0), 6) END AS max_score
FROM {fx_question} q JOIN {fx_tw_option} o ON q.q = o.q GROUP BY q.q, q.qtype, q.grp, q.pts, q.lo, q.hi""")
view("fx_tw_score", """
SELECT c.copy_key, c.grp, k.q, k.max_score, k.correct, coalesce(s.sel, '') AS sel,
  least(greatest(CASE WHEN k.qtype = 'single' THEN CASE WHEN coalesce(s.sel, '') = k.correct THEN k.value ELSE 0 END
        ELSE round(coalesce(s.pts, 0), 6) END, k.lo), k.hi) AS score
FROM {fx_copy} c JOIN {fx_tw_key} k ON k.grp IN ('', c.grp)
LEFT JOIN (SELECT r.copy_key, r.q, string_agg(r.ch, '' ORDER BY r.ch) AS sel, sum(o.p) AS pts
           FROM {fx_response} r JOIN {fx_tw_option} o ON r.q = o.q AND r.ch = o.ch GROUP BY 1, 2) s
  ON s.copy_key = c.copy_key AND s.q = k.q""")
view("fx_tw_total", "SELECT copy_key, grp, round(sum(score), 4) AS total FROM {fx_tw_score} GROUP BY 1, 2")


def exam_key(t, **bounds):
    return scoring.question_key(t.fx_question.withColumnRenamed("pts", "value"), t.fx_option, **bounds)


def item_key(t, **bounds):
    return scoring.question_key(t.fx_item, t.fx_item_option, **bounds)


def exam_scored(t, **bounds):
    return scoring.score_questions(t.fx_tick, t.fx_option, exam_key(t, **bounds))


def exam_totals(t, total_floor=None):
    return scoring.score_copies(t.fx_copy, exam_scored(t), exam_key(t), total_floor)


@query("c1_explode_answers", """
SELECT copy_key, q, string_agg(ch, '' ORDER BY ch) AS letters FROM fx_response GROUP BY 1, 2""")
def c1(t):
    per = t.fx_tick.groupBy("copy_key", "q").agg(F.collect_set("ch").alias("l"))
    copies = per.groupBy("copy_key").agg(F.map_from_entries(F.collect_list(F.struct("q", "l"))).alias("answers"))
    return scoring.explode_answers(copies, ["copy_key"]).withColumn("letters", F.array_join("letters", ""))


_MAP = """
WITH per AS (SELECT copy, num, count(*) AS nb, bool_and(regexp_full_match(ch, '[0-9]+')) AS dg FROM fx_box GROUP BY 1, 2),
lt AS (SELECT copy, num, nb FROM per WHERE NOT dg),
tag AS (SELECT copy, num, nb, CASE num WHEN 1 THEN 1 ELSE 2 END AS q, CASE num WHEN 1 THEN 1 ELSE 2 END AS na FROM lt WHERE num IN (1, 2)),
fr AS (SELECT copy, num, nb, row_number() OVER (PARTITION BY copy ORDER BY num) AS rn FROM lt WHERE num NOT IN (1, 2)),
pos AS (SELECT copy, num, nb, rn + 2 AS q, CASE rn WHEN 1 THEN 1 ELSE 2 END AS na FROM fr WHERE rn <= 2),
qcm AS (SELECT copy, num, nb, q, na FROM tag UNION ALL SELECT copy, num, nb, q, na FROM pos)
"""


@query("c2_question_map", _MAP + "SELECT copy, num, q FROM qcm")
def c2(t):
    return scoring.question_map(t.fx_box, t.fx_box_name, t.fx_box_question)["qcm"]


@query("c2_question_map_issues", _MAP + """
SELECT copy, 'box_count' AS issue, num FROM qcm WHERE nb <> na
UNION ALL SELECT copy, 'missing_in_layout', 2 - count(rn) FROM (SELECT DISTINCT copy FROM lt) LEFT JOIN fr USING (copy) GROUP BY 1 HAVING count(rn) < 2
UNION ALL SELECT copy, 'surplus_in_layout', num FROM fr WHERE rn > 2 AND num <> 5""")
def c2_issues(t):
    return scoring.question_map(t.fx_box, t.fx_box_name, t.fx_box_question)["issues"]


@query("c3_effective_spec", """
WITH d AS (SELECT q, count(*) AS n FROM fx_item_option GROUP BY 1),
z AS (SELECT l.copy, l.q, count(*) AS nl, count(o.correct) AS nk, string_agg(DISTINCT l.ch, '' ORDER BY l.ch) AS op,
   coalesce(string_agg(DISTINCT l.ch, '' ORDER BY l.ch) FILTER (o.correct), '') AS co
 FROM fx_item_layout l LEFT JOIN fx_item_option o ON l.q = o.q AND l.pos = o.pos GROUP BY 1, 2)
SELECT copy, z.q, CASE WHEN nl = n AND nk = n THEN op ELSE '' END AS options, CASE WHEN nl = n AND nk = n THEN co ELSE '' END AS correct
FROM z JOIN d ON z.q = d.q""")
def c3(t):
    return scoring.effective_spec(t.fx_item_option, t.fx_item_layout)


@query("c4_option_points", """
SELECT i.q, i.qtype, CASE WHEN qtype = 'single' THEN CASE value WHEN '1/2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS value,
   CASE WHEN qtype = 'mult' THEN coalesce(o.ok, false) END AS usable
FROM fx_item i LEFT JOIN (SELECT q, bool_and(pts <> 'n/a') AS ok FROM fx_item_option GROUP BY 1) o ON i.q = o.q""")
def c4(t):
    return scoring.option_points(t.fx_item, t.fx_item_option)


view("fx_tw_item", """
SELECT i.*, CASE i.value WHEN '1/2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS v,
  coalesce(o.good, 0) AS good, coalesce(o.bad, 0) AS bad, coalesce(o.ok, false) AS ok, coalesce(o.n_good, 0) AS n_good, coalesce(o.n_bad, 0) AS n_bad, o.first_bad,
  CASE WHEN i.qtype = 'single' THEN CASE i.value WHEN '1/2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE round(coalesce(o.good, 0), 6) END AS max_score
FROM {fx_item} i LEFT JOIN (SELECT q, sum(p) FILTER (correct) AS good, sum(p) FILTER (NOT correct) AS bad, bool_and(pts <> 'n/a') AS ok,
   count(*) FILTER (correct) AS n_good, count(*) FILTER (NOT correct) AS n_bad, min_by(coalesce(p, 0), pos) FILTER (NOT correct) AS first_bad
  FROM (SELECT *, CASE pts WHEN '1/2' THEN 0.5::DOUBLE WHEN '-1/4' THEN -0.25::DOUBLE END AS p FROM {fx_item_option}) GROUP BY 1) o ON i.q = o.q""")


@query("c5_max_score", "SELECT q, max_score FROM fx_tw_item")
def c5(t):
    return item_key(t).select("q", "max_score")


@query("c6_version_total_max", """
SELECT v.vid, v.grp, round(coalesce(s.own, 0) + (SELECT sum(max_score) FROM fx_tw_item WHERE grp = ''), 6) AS total_max
FROM fx_version v LEFT JOIN (SELECT grp, sum(max_score) AS own FROM fx_tw_item WHERE grp <> '' GROUP BY 1) s ON s.grp = v.grp""")
def c6(t):
    return scoring.version_total_max(item_key(t), t.fx_version.select("vid", "grp"))


@query("c7_copy_total_max", """
SELECT l.copy, round(sum(i.max_score), 6) AS total_max FROM (SELECT DISTINCT copy, q FROM fx_item_layout) l JOIN fx_tw_item i ON l.q = i.q GROUP BY 1""")
def c7(t):
    return scoring.copy_total_max(t.fx_item_layout, item_key(t))


@query("c8_subject_total_max", """
SELECT coalesce(max(s), 0) AS total_max FROM (SELECT round(sum(i.max_score), 6) AS s
FROM (SELECT DISTINCT copy, q FROM fx_item_layout) l JOIN fx_tw_item i ON l.q = i.q GROUP BY l.copy) WHERE s > 0""")
def c8(t):
    return scoring.subject_total_max(scoring.copy_total_max(t.fx_item_layout, item_key(t)))


_RANGES = """WITH r AS (SELECT *, CAST(sum(greatest(1, num_copies)) OVER (PARTITION BY subject ORDER BY ord) AS BIGINT) AS last_copy FROM fx_version),
g AS (SELECT *, CAST(last_copy - greatest(1, num_copies) + 1 AS BIGINT) AS first_copy FROM r) """


@query("c9_version_ranges", _RANGES + "SELECT subject, vid, first_copy, last_copy FROM g")
def c9(t):
    return scoring.version_copy_ranges(t.fx_version).select("subject", "vid", "first_copy", "last_copy")


@query("c9_version_of_copy", _RANGES + """
SELECT n.copy_key, n.subject, n.n, g.vid FROM (SELECT o_orderkey AS copy_key, o_custkey % 25 AS subject, 1 + o_orderkey % 300 AS n FROM orders) n
LEFT JOIN g ON g.subject = n.subject AND n.n BETWEEN g.first_copy AND g.last_copy""")
def c9_of(t):
    numbers = t.orders.select(F.col("o_orderkey").alias("copy_key"), (F.col("o_custkey") % 25).alias("subject"),
                              (1 + F.col("o_orderkey") % 300).alias("n"))
    return scoring.version_of_copy(numbers, scoring.version_copy_ranges(t.fx_version))


@query("c10_score_single", """
SELECT s.copy_key, s.q, s.score FROM fx_tw_score s JOIN fx_question q ON s.q = q.q WHERE q.qtype = 'single' AND s.sel <> ''""")
def c10(t):
    return _answered(t, "single")


@query("c11_score_mult", """
SELECT s.copy_key, s.q, s.score FROM fx_tw_score s JOIN fx_question q ON s.q = q.q WHERE q.qtype = 'mult' AND s.sel <> ''""")
def c11(t):
    return _answered(t, "mult")


def _answered(t, qtype):
    key = exam_key(t).filter(F.col("qtype") == qtype)
    scored = scoring.score_questions(t.fx_tick, t.fx_option, key)
    joined = scored.join(t.fx_copy.select("copy_key", "grp"), "copy_key")
    return joined.filter(scoring.belongs(F.col("q_grp"), F.col("grp"))).select("copy_key", "q", "score")


@query("c12_bounds", """
SELECT s.copy_key, s.q, least(greatest(CASE WHEN k.qtype = 'single' THEN CASE WHEN s.sel = k.correct THEN k.value ELSE 0 END
   ELSE round(coalesce((SELECT sum(o.p) FROM fx_tw_option o WHERE o.q = s.q AND contains(s.sel, o.ch)), 0), 6) END,
   coalesce(k.lo, -0.25::DOUBLE)), coalesce(k.hi, 0.9::DOUBLE)) AS score
FROM fx_tw_score s JOIN fx_tw_key k ON s.q = k.q""")
def c12(t):
    key = exam_key(t, floor=-0.25, ceiling=0.9)
    scored = scoring.score_questions(t.fx_tick, t.fx_option, key)
    return scoring.copy_questions(t.fx_copy, scored, key).select("copy_key", "q", "score")


@query("c13_score_copy", "SELECT copy_key, grp, greatest(total, -0.5::DOUBLE) AS total FROM fx_tw_total")
def c13(t):
    return exam_totals(t, total_floor=-0.5)


@query("c13_score_detail", "SELECT copy_key, q, sel, score, max_score FROM fx_tw_score")
def c13_detail(t):
    key = exam_key(t)
    detail = scoring.copy_questions(t.fx_copy, exam_scored(t), key).join(key.select("q", "opts"), "q")
    return detail.select("copy_key", "q", scoring.mask_letters("picked").alias("sel"), "score", "max_score")


@query("c14_all_question_numbers", "SELECT DISTINCT num AS q FROM fx_box ORDER BY 1")
def c14(t):
    return t.fx_box.select(F.col("num").alias("q")).distinct().orderBy("q")


@query("c15_natural_bounds", """
SELECT q, round(coalesce(sum(p) FILTER (NOT correct), 0), 6) AS lo, round(coalesce(sum(p) FILTER (correct), 0), 6) AS hi
FROM (SELECT *, CASE pts WHEN '1/2' THEN 0.5::DOUBLE WHEN '-1/4' THEN -0.25::DOUBLE ELSE 0 END AS p FROM fx_item_option) GROUP BY 1""")
def c15(t):
    return scoring.natural_bounds(t.fx_item_option)


@query("c16_scheme_census", """
WITH p AS (SELECT *, CASE pts WHEN '1/2' THEN 0.5::DOUBLE WHEN '-1/4' THEN -0.25::DOUBLE ELSE 0 END AS p FROM fx_item_option),
s AS (SELECT q, count(*) FILTER (correct) AS n_good, count(*) FILTER (NOT correct) AS n_bad, arg_min(p, pos) FILTER (correct) AS good,
   -arg_min(p, pos) FILTER (NOT correct) AS bad FROM p GROUP BY 1 HAVING n_good > 0 AND n_bad > 0),
c AS (SELECT n_good, n_bad, good, bad, count(*) AS n_questions, min(q) AS fq FROM s GROUP BY 1, 2, 3, 4 ORDER BY n_questions DESC, fq LIMIT 10)
SELECT n_good, n_bad, good, bad, n_questions, least(greatest(n_good * good, -0.5::DOUBLE), 1.0::DOUBLE) AS best,
  least(greatest(good - bad, -0.5::DOUBLE), 1.0::DOUBLE) AS mixed, least(greatest(-n_bad * bad, -0.5::DOUBLE), 1.0::DOUBLE) AS worst FROM c""")
def c16(t):
    return scoring.scheme_census(t.fx_item_option, 10, floor=-0.5, ceiling=1.0)


@query("c17_rank_in_version", """
SELECT subject, grp, q, row_number() OVER (PARTITION BY subject, grp ORDER BY q) AS ordinal FROM fx_item""")
def c17(t):
    return scoring.rank_in_version(t.fx_item)


@query("c18_self_check", """
WITH i AS (SELECT * FROM fx_tw_item WHERE q IN (SELECT q FROM fx_item_option)),
r AS (SELECT *, least(greatest(CASE WHEN qtype = 'single' THEN v WHEN ok THEN round(good, 6) ELSE 0 END, lo), hi) AS perfect,
  least(greatest(CASE WHEN qtype = 'single' AND n_good = 0 THEN v ELSE 0 END, lo), hi) AS blank,
  least(greatest(CASE WHEN qtype = 'single' THEN CASE WHEN n_bad = 0 THEN v ELSE 0 END WHEN ok THEN round(good + bad, 6) ELSE 0 END, lo), hi) AS all_ticked,
  CASE WHEN n_bad > 0 THEN least(greatest(CASE WHEN qtype = 'single' THEN 0 WHEN ok THEN round(first_bad, 6) ELSE 0 END, lo), hi) END AS one_wrong FROM i)
SELECT q, max_score, perfect, blank, all_ticked, one_wrong FROM r""")
def c18(t):
    asked = item_key(t).filter("opts IS NOT NULL")
    return scoring.self_check(asked)


@query("c19_layout_roles", """
SELECT num AS question, CASE WHEN num = 5 THEN 'copy' WHEN num IN (6, 7) THEN 'student' ELSE 'question' END AS role,
   string_agg(DISTINCT ch, '' ORDER BY ch) AS letters
FROM (SELECT l_linenumber AS num, CASE WHEN l_linenumber >= 5 THEN CAST(CAST(floor(l_quantity) AS INT) % 10 AS VARCHAR)
      ELSE substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) END AS ch FROM lineitem) GROUP BY 1""")
def c19(t):
    number = (F.floor("l_quantity").cast("int"))
    ch = F.when(F.col("l_linenumber") >= 5, (number % 10).cast("string")).otherwise(F.substring(F.lit("ABCD"), number % 4 + 1, F.lit(1)))
    name = F.when(F.col("l_linenumber") == 5, "copie[1]").when(F.col("l_linenumber") == 6, "etu[1]") \
        .when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")))
    return scoring.layout_roles(t.lineitem.select(F.col("l_linenumber").alias("question"), name.alias("name"), ch.alias("ch")))


@query("c20_pdf_page", """
WITH p AS (SELECT copy, page, row_number() OVER (ORDER BY copy, page) AS n FROM (SELECT DISTINCT l_orderkey AS copy, l_linenumber AS page FROM lineitem WHERE l_linenumber < 6))
SELECT w.copy, w.page, coalesce(p.n, w.page) AS pdf_page FROM (SELECT DISTINCT l_orderkey AS copy, l_linenumber AS page FROM lineitem) w LEFT JOIN p ON p.copy = w.copy AND p.page = w.page""")
def c20(t):
    pages = t.lineitem.select(F.col("l_orderkey").alias("copy"), F.col("l_linenumber").alias("page")).distinct()
    return scoring.locate_pages(pages, scoring.pdf_pages(pages.filter("page < 6")))
