"""Imported marks, distributions, cohorts and question statistics."""

from pyspark.sql import functions as F

from tallyloom.operators import cohort, identity, imports, marks, questions, roster, scoring, stats
from tallyloom.plans.registry import query, view
from tallyloom.plans.identity_plans import resolved_links
from tallyloom.plans.scoring_plans import exam_key, exam_scored, exam_totals, item_key

# ------------------------------------------------------------ imports (E)

view("fx_table_line", """
SELECT o_orderstatus AS path, o_orderkey AS row_no, concat(CASE WHEN o_orderkey % 7 = 0 THEN CAST(10000 + o_custkey AS STRING) ELSE right(CAST(10000 + o_custkey AS STRING), 4) END, ';',
   replace(CAST(o_totalprice AS STRING), '.', ','), ';', CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'abs' ELSE CAST(o_orderkey % 20 AS STRING) END) AS line
FROM {orders}""")


def table(t):
    return t.fx_table_line.select("path", "row_no", F.split("line", ";").alias("cells"))


def _files(t):
    return table(t).groupBy("path").agg(F.lit(0).alias("join_col"), F.lit(3).alias("data_start"))


def _columns(t):
    return _files(t).select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx")).withColumn(
        "label", F.when(F.col("idx") == 1, "Projet").otherwise(""))


def _series(t):
    raws = table(t).select("path", F.get("cells", F.lit(0)).alias("raw")).distinct()
    links = raws.join(imports.resolve_ids(raws, t.fx_roster), "raw")
    return imports.series(table(t), _files(t), _columns(t), links)


view("fx_tw_import", """
SELECT path, row_no, split_part(line, ';', 1) AS raw, split_part(line, ';', 2) AS c1, split_part(line, ';', 3) AS c2, k.id AS student_id
FROM {fx_table_line} l LEFT JOIN {fx_tw_lookup} k ON k.key = split_part(line, ';', 1)""")
view("fx_tw_series", """
SELECT path, 1 AS idx, 'Projet' AS name, student_id, arg_max(TRY_CAST(replace(c1, ',', '.') AS DOUBLE), row_no) AS value FROM {fx_tw_import}
 WHERE student_id IS NOT NULL AND row_no >= 3 AND TRY_CAST(replace(c1, ',', '.') AS DOUBLE) IS NOT NULL GROUP BY 1, 4
UNION ALL SELECT path, 2, 'Colonne 3', student_id, arg_max(TRY_CAST(c2 AS DOUBLE), row_no) FROM {fx_tw_import}
 WHERE student_id IS NOT NULL AND row_no >= 3 AND TRY_CAST(c2 AS DOUBLE) IS NOT NULL GROUP BY 1, 4""")


@query("e1_analyze_table", """
WITH c AS (SELECT path, row_no, 0 AS col, raw AS v FROM fx_tw_import UNION ALL SELECT path, row_no, 1, c1 FROM fx_tw_import UNION ALL SELECT path, row_no, 2, c2 FROM fx_tw_import),
f AS (SELECT *, TRY_CAST(replace(v, ',', '.') AS DOUBLE) IS NOT NULL AS num, v IN (SELECT id FROM fx_roster UNION SELECT right(id, 4) FROM fx_roster) AS hit FROM c WHERE v <> ''),
d AS (SELECT path, row_no, lead(row_no) OVER w AS a, lead(row_no, 2) OVER w AS b FROM f WHERE col = 0 AND hit WINDOW w AS (PARTITION BY path ORDER BY row_no)),
s AS (SELECT path, coalesce(min(row_no) FILTER (a = row_no + 1 AND b = row_no + 2), min(row_no)) AS data_start FROM d GROUP BY 1),
h AS (SELECT path, col, count(*) FILTER (hit) AS hits FROM f GROUP BY 1, 2),
r AS (SELECT f.path, f.col, count(*) AS nonnull, count(*) FILTER (num) AS n FROM f JOIN s ON f.path = s.path WHERE row_no >= data_start GROUP BY 1, 2)
SELECT h.path, h.col, 'id' AS join_mode, 0 AS join_col, data_start, coalesce(nonnull, 0) AS nonnull, round(coalesce(n / nonnull, 0), 2) AS numeric_ratio,
  hits >= 3 AS looks_id, false AS looks_name, h.col <> 0 AND coalesce(nonnull, 0) >= 3 AND n / nonnull >= 0.6 AS looks_grade
FROM h JOIN s ON h.path = s.path LEFT JOIN r ON r.path = h.path AND r.col = h.col""")
def e1(t):
    return imports.analyze_table(table(t), t.fx_roster)


@query("e2_resolve_join_cell", """
SELECT DISTINCT raw, student_id FROM fx_tw_import WHERE student_id IS NOT NULL""")
def e2(t):
    return imports.resolve_ids(table(t).select(F.get("cells", F.lit(0)).alias("raw")), t.fx_roster)


@query("e2_resolve_names")
def e2_names(t):
    raws = t.fx_name_read.select(F.lit("list").alias("path"), "raw")
    forced = t.part.filter("p_partkey % 16 = 0").select(F.lit("list").alias("path"), F.concat_ws(" ", "p_name", "p_type").alias("raw"),
                                                     F.when(F.col("p_partkey") % 32 == 0, F.col("p_partkey").cast("string")).alias("id"))
    forced = forced.groupBy("path", "raw").agg(F.max("id").alias("id"))
    return imports.resolve_names(raws, roster.name_index(t.fx_name_roster), forced)


@query("e3_series", "SELECT path, idx, name, student_id, value FROM fx_tw_series WHERE idx = 1")
def e3(t):
    return _series(t).filter("idx = 1")


@query("e4_all_series", "SELECT path, idx, name, student_id, value FROM fx_tw_series")
def e4(t):
    return _series(t)


@query("e5_id_match_report", """
SELECT path, count(student_id) AS n_matched, count(*) - count(student_id) AS n_unmatched FROM fx_tw_import GROUP BY 1""")
def e5_id(t):
    return imports.id_match_report(table(t).select("path", F.get("cells", F.lit(0)).alias("raw")), t.fx_roster)


@query("e5_id_match_problems", "SELECT path, row_no, raw FROM fx_tw_import WHERE student_id IS NULL AND trim(raw) <> ''")
def e5_id_problems(t):
    return imports.id_match_problems(table(t).select("path", "row_no", F.get("cells", F.lit(0)).alias("raw")), t.fx_roster)


def _name_report(t):
    raws = t.fx_name_read.select(F.lit("list").alias("path"), F.col("copy_key").alias("row_no"), "raw")
    ruled = t.part.filter("p_partkey % 20 = 0").select(
        F.lit("list").alias("path"), F.concat_ws(" ", "p_name", "p_type").alias("raw"), F.lit(None).cast("string").alias("id")).distinct()
    return imports.match_report(raws, roster.name_index(t.fx_name_roster), ruled)


@query("e5_match_report")
def e5(t):
    return _name_report(t)["counts"]


@query("e5_match_problems")
def e5_problems(t):
    return _name_report(t)["problems"].withColumn("candidates", F.array_join(F.transform("candidates", lambda c: c["id"]), ","))


view("fx_grade_col", """
SELECT concat('f', CAST(s_nationkey AS STRING)) AS path, CAST(s_suppkey AS INT) AS idx, s_name AS label,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(10.0 AS DOUBLE) END AS norm, CASE WHEN s_suppkey % 4 = 0 THEN CAST(5.0 AS DOUBLE) END AS max,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(2.0 AS DOUBLE) END AS weight FROM {supplier}""")


@query("e6_upsert_grade_file", """
WITH o AS (SELECT path, idx, label, coalesce(norm, 20.0::DOUBLE) AS norm, coalesce(max, 20.0::DOUBLE) AS max, coalesce(weight, 1.0::DOUBLE) AS weight FROM fx_grade_col),
n AS (SELECT path, idx, 'again ' || label AS label, CASE WHEN idx % 2 = 0 THEN 7.0::DOUBLE END AS norm FROM fx_grade_col WHERE path IN ('f1', 'f2', 'f3') AND idx % 3 <> 1)
SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)
UNION ALL SELECT n.path, n.idx, n.label, coalesce(n.norm, o.norm, 20.0::DOUBLE), coalesce(o.max, 20.0::DOUBLE), coalesce(o.weight, 1.0::DOUBLE) FROM n LEFT JOIN o ON n.path = o.path AND n.idx = o.idx""")
def e6(t):
    old = t.fx_grade_col.fillna({"norm": 20.0, "max": 20.0, "weight": 1.0})
    new = t.fx_grade_col.filter("path IN ('f1', 'f2', 'f3') AND idx % 3 <> 1").select(
        "path", "idx", F.concat(F.lit("again "), "label").alias("label"), F.when(F.col("idx") % 2 == 0, 7.0).alias("norm"),
        F.lit(None).cast("double").alias("max"), F.lit(None).cast("double").alias("weight"))
    return imports.upsert_grade_files(old, new)


@query("e7_remove_grade_file", "SELECT path, idx, label FROM fx_grade_col WHERE path NOT IN (SELECT 'f' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)")
def e7(t):
    gone = t.nation.filter("n_regionkey = 1").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"))
    return imports.remove_grade_files(t.fx_grade_col, gone).select("path", "idx", "label")


@query("e7_name_overrides", """
WITH o AS (SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS path, c_name AS raw, CASE WHEN c_custkey % 3 > 0 THEN CAST(10000 + c_custkey AS VARCHAR) END AS id, c_custkey AS k FROM customer)
SELECT path, raw, CASE k % 10 WHEN 1 THEN NULL WHEN 3 THEN '10001' ELSE id END AS id FROM o WHERE k % 10 <> 2""")
def e7_overrides(t):
    key = F.col("c_custkey")
    base = t.customer.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_name").alias("raw"), key,
                             F.when(key % 3 > 0, (key + 10000).cast("string")).alias("id"))
    edits = base.filter(key % 10 < 4).filter(key % 10 > 0).select(
        "path", "raw", F.when(key % 10 == 2, "").when(key % 10 == 3, "10001").alias("id"))
    return imports.edit_overrides(base, edits)


# ------------------------------------------------------------ marks (F)


def exam_copies(t):
    """Copies with their student, mark and state: the input of every export."""
    linked = resolved_links(t).select("copy_key", "batch", "page", "student_id", "matched_id", "flags")
    totals = exam_totals(t).select("copy_key", "total")
    who = t.fx_roster.select(F.col("id").alias("matched_id"), roster.full_name().alias("name"), "email")
    joined = linked.join(totals, "copy_key").join(who, "matched_id", "left")
    return joined.select(
        "batch", "page", F.coalesce("matched_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("?")).alias("name"),
        F.coalesce("email", F.lit("")).alias("email"), F.col("student_id").alias("id_read"), F.bround("total", 2).alias("raw"),
        F.bround("total", 2).alias("mark"), F.array_contains("flags", "validated").alias("validated"), "flags", "copy_key")


def exam_rows(t):
    # who is absent depends on the links alone, not on the marks
    gone = identity.absentees(t.fx_roster, resolved_links(t))
    return marks.student_rows(exam_copies(t).drop("copy_key"), gone)


view("fx_tw_rows", """
SELECT l.batch, l.page, coalesce(l.matched_id, '') AS id, CASE WHEN r.id IS NULL THEN '?' ELSE r.nom || ' ' || r.prenom END AS name, coalesce(r.email, '') AS email, l.student_id AS id_read,
  round_even(s.total, 2) AS raw, contains(flag_text, 'validated') AS validated, flag_text AS flags, false AS absent
FROM {fx_tw_link} l JOIN {fx_tw_total} s ON s.copy_key = l.copy_key LEFT JOIN {fx_roster} r ON r.id = l.matched_id
UNION ALL SELECT '', NULL, id, nom || ' ' || prenom, email, '', NULL, NULL, 'absent', true FROM {fx_roster}
 WHERE id NOT IN (SELECT matched_id FROM {fx_tw_link} WHERE matched_id IS NOT NULL)""")


@query("f1_series_stats", """
SELECT grp AS version, count(*) AS n, round(avg(total), 6) AS mean, round(var_pop(total), 6) AS variance, round(stddev_pop(total), 6) AS std, median(total) AS median, min(total) AS min, max(total) AS max
FROM fx_tw_total GROUP BY 1""")
def f1(t):
    out = stats.series_stats(exam_totals(t), ["grp"], "total").withColumnRenamed("grp", "version")
    return out.select("version", "n", "median", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "std")])


view("fx_exam", """
SELECT concat('e', CAST(s_suppkey AS STRING)) AS path, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS label,
  CASE WHEN s_suppkey % 4 = 0 THEN CAST(0.0 AS DOUBLE) WHEN s_suppkey % 4 = 1 THEN CAST(30.0 AS DOUBLE) END AS norm,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(20.0 AS DOUBLE) END AS max, CASE WHEN s_suppkey % 5 = 0 THEN CAST(2.0 AS DOUBLE) END AS weight,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(18.0 AS DOUBLE) END AS threshold,
  CAST(s_suppkey % 37 AS DOUBLE) AS total_max, CAST(s_suppkey % 3 AS INT) AS n_imported, s_suppkey AS ord,
  CASE WHEN s_suppkey % 10 = 7 THEN 'no roster' ELSE '' END AS error
FROM {supplier}""")


@query("f2_grade_columns", """
SELECT path, 'qcm' AS key, 'QCM' AS label, coalesce(nullif(norm, 0), nullif(total_max, 0), 20.0::DOUBLE) AS norm, nullif(norm, 0) IS NULL AS auto_norm, coalesce(max, 20.0::DOUBLE) AS max, coalesce(weight, 1.0::DOUBLE) AS weight FROM fx_exam
UNION ALL SELECT path, path || '::' || CAST(idx AS VARCHAR), label, coalesce(norm, 20.0::DOUBLE), false, coalesce(max, 20.0::DOUBLE), coalesce(weight, 1.0::DOUBLE) FROM fx_grade_col""")
def f2(t):
    imported = t.fx_grade_col.select("path", "idx", F.col("label").alias("name"))
    return marks.grade_columns(t.fx_exam, imported, t.fx_grade_col.drop("label")).drop("position")


def _cohort_columns(t):
    """Columns of the three exams of the cohort, with settings that derive from the marks."""
    return t.fx_exam_mark.groupBy("path").agg(F.max("raw").alias("top")).select(
        F.col("path").alias("key"), (F.col("top") * 0.75).alias("norm"), F.lit(20.0).alias("max"),
        F.when(F.col("path") == "P", 2.0).otherwise(1.0).alias("weight"))


view("fx_tw_marks", """
SELECT m.id, m.path AS key, CASE WHEN m.path = 'P' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, m.raw, least(m.raw / (0.75::DOUBLE * c.top), 1.0::DOUBLE) * 20.0::DOUBLE AS mark
FROM {fx_exam_mark} m JOIN (SELECT path, max(raw) AS top FROM {fx_exam_mark} GROUP BY 1) c ON c.path = m.path""")


def _marks(t):
    return marks.rescaled_marks(t.fx_exam_mark.withColumnRenamed("path", "key"), _cohort_columns(t))


@query("f3_calibration_series", """
SELECT c.copy_key, m.key, m.mark FROM fx_tw_link c JOIN fx_tw_marks m ON m.id = c.matched_id""")
def f3(t):
    linked = resolved_links(t).filter("matched_id IS NOT NULL").select("copy_key", F.col("matched_id").alias("id"))
    return linked.join(_marks(t), "id").select("copy_key", "key", "mark")


@query("f4_copy_rescaled", "SELECT id, key, weight, mark FROM fx_tw_marks")
def f4(t):
    return _marks(t)


@query("f5_weighted_final", """
SELECT id, count(*) AS n_columns, round(least(sum(weight * mark) / sum(weight), 19.0::DOUBLE), 6) AS final FROM fx_tw_marks GROUP BY 1""")
def f5(t):
    return marks.finals(_marks(t), 19.0).withColumn("final", F.round("final", 6))


view("fx_tw_frame", """
SELECT lo, nb, lo + nb * 0.5::DOUBLE AS hi FROM (SELECT lo, CAST(greatest(1, least(400, round((hi - lo) / 0.5))) AS INT) AS nb FROM (
 SELECT floor(least(0, min(mark)) / 0.5::DOUBLE) * 0.5::DOUBLE AS lo, ceil(max(mark) / 0.5::DOUBLE) * 0.5::DOUBLE AS hi FROM {fx_tw_marks}))""")


@query("f6_multi_histogram", """
WITH b AS (SELECT key, CAST(least(nb - 1, greatest(0, floor((mark - lo) / ((hi - lo) / nb)))) AS INT) AS bin, count(*) AS n FROM fx_tw_marks, fx_tw_frame GROUP BY 1, 2)
SELECT k.key, CAST(i AS INT) AS bin, lo + i * ((hi - lo) / nb) AS lo, lo + (i + 1) * ((hi - lo) / nb) AS hi, coalesce(b.n, 0) AS n
FROM (SELECT DISTINCT key FROM fx_tw_marks) k CROSS JOIN fx_tw_frame, range(0, nb) r(i) LEFT JOIN b ON b.key = k.key AND b.bin = i""")
def f6(t):
    return marks.multi_histogram(_marks(t), 0.5)


@query("f7_chart_guides", """
SELECT key, round(any_value(lo), 1) AS tick0, round(any_value(lo + (hi - lo) * 0.25), 1) AS tick1, round(any_value(lo + (hi - lo) * 0.5), 1) AS tick2, round(any_value(lo + (hi - lo) * 0.75), 1) AS tick3, round(any_value(hi), 1) AS tick4,
 round(avg(mark), 6) AS mean, round(greatest(any_value(lo), avg(mark) - stddev_pop(mark)), 6) AS band_lo, round(least(any_value(hi), avg(mark) + stddev_pop(mark)), 6) AS band_hi, 10.0::DOUBLE AS pass_line
FROM fx_tw_marks, fx_tw_frame GROUP BY 1""")
def f7(t):
    out = marks.chart_guides(_marks(t), 0.5, 10)
    return out.select("key", *[f"tick{i}" for i in range(5)], "pass_line", *[F.round(c, 6).alias(c) for c in ("mean", "band_lo", "band_hi")])


@query("f8_scatter", """
SELECT id, round_even(max(mark) FILTER (key = 'F'), 3) AS "F", round_even(max(mark) FILTER (key = 'O'), 3) AS "O", round_even(max(mark) FILTER (key = 'P'), 3) AS "P",
  round_even(least(sum(weight * mark) / sum(weight), 20.0::DOUBLE), 3) AS final FROM fx_tw_marks GROUP BY 1""")
def f8(t):
    return marks.scatter(_marks(t), ["F", "O", "P"], 20.0)


@query("f11_pass_counts", "SELECT key, count(*) FILTER (mark < 10) AS n_below, count(*) AS n FROM fx_tw_marks GROUP BY 1")
def f11(t):
    return marks.pass_counts(_marks(t), 10.0)


@query("f12_settings_drift", """
WITH e AS (SELECT *, coalesce(nullif(norm, 0), total_max) AS nn, coalesce(max, 20.0) AS mx, coalesce(threshold, 20.0) AS cap FROM fx_exam)
SELECT path, 'rescaled' AS issue, printf('%g', mx) || ' from ' || printf('%g', nn) AS detail FROM e WHERE total_max > 0 AND abs(mx - nn) > 1e-9
UNION ALL SELECT path, 'capped', printf('%g', cap) FROM e WHERE total_max > 0 AND cap < total_max - 1e-9
UNION ALL SELECT path, 'imported_columns', CAST(n_imported AS VARCHAR) FROM e WHERE n_imported > 0""")
def f12(t):
    return marks.settings_drift(t.fx_exam)


@query("f13_student_rows", "SELECT batch, page, id, name, email, id_read, raw, raw AS mark, validated, flags, absent FROM fx_tw_rows")
def f13(t):
    return exam_rows(t).withColumn("flags", F.array_join("flags", ";"))


@query("f14_exam_summary", """
SELECT count(*) AS n_students, count(*) FILTER (NOT absent) AS n_copies, count(*) FILTER (absent) AS n_absent, count(*) FILTER (coalesce(validated, false)) AS n_validated,
  count(*) FILTER (NOT absent AND id = '') AS n_unlinked FROM fx_tw_rows""")
def f14(t):
    return marks.exam_summary(exam_rows(t))


@query("a9_export_rows", """
SELECT batch, coalesce(CAST(page AS VARCHAR), '') AS page, id AS id_canonique, name AS nom_prenom, email AS courriel, id_read AS id_lu, coalesce(CAST(raw AS VARCHAR), 'ABS') AS note_sur_32,
  coalesce(CAST(raw AS VARCHAR), 'ABS') AS note_finale, CASE WHEN absent THEN '' WHEN validated THEN 'oui' ELSE 'non' END AS validee, flags FROM fx_tw_rows""")
def a9(t):
    return marks.export_rows(exam_rows(t))


@query("a10_report_rows", """
SELECT batch, coalesce(CAST(page AS VARCHAR), '') AS page, id AS id_canonique, name AS nom_prenom, email AS courriel, coalesce(CAST(raw AS VARCHAR), 'ABS') AS "QCM_brut_sur_32",
  coalesce(CAST(raw AS VARCHAR), 'ABS') AS note_finale, CASE WHEN absent THEN '' WHEN validated THEN 'oui' ELSE 'non' END AS validee FROM fx_tw_rows""")
def a10(t):
    return marks.report_rows(exam_rows(t))


# ------------------------------------------------------------ cohorts (G)

view("fx_member", """
SELECT o_orderstatus AS path, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS exam_ord, o_custkey AS ord,
  CASE WHEN o_custkey % 50 = 49 THEN '' WHEN o_orderstatus = 'F' THEN right(CAST(10000 + o_custkey AS STRING), 4) WHEN o_custkey % 40 = 1 THEN concat('2', right(CAST(10000 + o_custkey AS STRING), 4)) ELSE CAST(10000 + o_custkey AS STRING) END AS id,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN '?' WHEN o_orderstatus = 'F' AND o_custkey % 23 = 0 THEN 'OTHER Name' ELSE concat('N ', translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')) END AS name,
  CASE WHEN o_orderstatus = 'O' THEN concat('u', CAST(o_custkey AS STRING), '@x.org') ELSE '' END AS email,
  CASE WHEN o_custkey % 9 = 0 AND o_orderstatus = 'O' THEN NULL ELSE floor(max(o_totalprice) / 1000) / 16 END AS raw, o_custkey % 9 = 0 AND o_orderstatus = 'O' AS absent
FROM {orders} GROUP BY o_orderstatus, o_custkey""")

view("fx_tw_people", """
SELECT id, coalesce(arg_min(name, exam_ord * 10000000000 + ord) FILTER (name NOT IN ('', '?')), arg_min(name, exam_ord * 10000000000 + ord)) AS name,
  coalesce(arg_min(email, exam_ord * 10000000000 + ord) FILTER (email <> ''), '') AS email, min(exam_ord * 10000000000 + ord) AS place FROM {fx_member} WHERE id <> '' GROUP BY 1""")
view("fx_tw_fold", """
SELECT s.id, count(*) AS n_longer, min(l.id) AS target, min(l.norm) AS lnorm, min(s.norm) AS norm,
  CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN min(s.norm) <> '' AND min(l.norm) <> '' AND min(s.norm) <> min(l.norm) THEN 'names_differ' END AS reason
FROM (SELECT *, trim(lower(regexp_replace(name, '[^a-zA-Z]+', ' ', 'g'))) AS norm FROM {fx_tw_people}) s
JOIN (SELECT *, trim(lower(regexp_replace(name, '[^a-zA-Z]+', ' ', 'g'))) AS norm FROM {fx_tw_people}) l
  ON right(l.id, CAST(length(s.id) AS INT)) = s.id AND length(l.id) > length(s.id) GROUP BY 1""")
view("fx_tw_canon", """
SELECT p.*, CASE WHEN f.id IS NOT NULL AND f.reason IS NULL THEN f.target ELSE p.id END AS canonical FROM {fx_tw_people} p LEFT JOIN {fx_tw_fold} f ON f.id = p.id""")
view("fx_tw_notes", """
SELECT m.*, least(m.raw / 20.0::DOUBLE, 1.0::DOUBLE) * CASE WHEN m.key = 'P' THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS note, CASE WHEN m.key = 'O' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (
 SELECT c.canonical AS id, m.path AS key, arg_max(m.raw, c.place * 100000 + m.exam_ord * 1000 + 1) AS raw FROM {fx_member} m JOIN {fx_tw_canon} c ON c.id = m.id WHERE NOT m.absent GROUP BY 1, 2) m""")
view("fx_tw_table", """
SELECT p.id, p.name, p.email, p.n_ids, coalesce(n.n_columns, 0) AS n_columns, n.final, coalesce(a.absent_in, '') AS absent_in FROM (
 SELECT canonical AS id, coalesce(arg_min(name, place) FILTER (name NOT IN ('', '?')), arg_min(name, place)) AS name, coalesce(arg_min(email, place) FILTER (email <> ''), '') AS email, count(*) AS n_ids FROM {fx_tw_canon} GROUP BY 1) p
LEFT JOIN (SELECT id, count(*) AS n_columns, round_even(least(sum(weight * note) / sum(weight), 25.0::DOUBLE), 2) AS final FROM {fx_tw_notes} GROUP BY 1) n ON n.id = p.id
LEFT JOIN (SELECT c.canonical AS id, string_agg(DISTINCT m.path, ';' ORDER BY m.path) AS absent_in FROM {fx_member} m JOIN {fx_tw_canon} c ON c.id = m.id WHERE m.absent GROUP BY 1) a ON a.id = p.id""")


def _joint_columns(t):
    return t.fx_member.select("path").distinct().select(
        F.col("path").alias("key"), "path", F.col("path").alias("label"), F.lit(20.0).alias("norm"),
        F.when(F.col("path") == "P", 40.0).otherwise(20.0).alias("max"), F.when(F.col("path") == "O", 2.0).otherwise(1.0).alias("weight"))


def _joint(t):
    return cohort.build_table(t.fx_member, _joint_columns(t), 25.0)


@query("g1_read_members", """
SELECT path, CASE WHEN label <> '' THEN label WHEN error = '' AND ord % 10 <> 3 THEN 'project ' || path ELSE path END AS label, error = '' AND ord % 10 <> 3 AS ok,
  CASE WHEN ord % 10 = 3 THEN 'not readable' ELSE error END AS error, CASE WHEN error = '' AND ord % 10 <> 3 THEN total_max ELSE 0 END AS total_max FROM fx_exam""")
def g1(t):
    return _members(t)


def _members(t):
    read = t.fx_exam.filter("ord % 10 <> 3").select("path", F.concat(F.lit("project "), "path").alias("project"), "error", "total_max")
    return cohort.read_members(t.fx_exam.select("path", "label"), read)


@query("g2_exam_columns", """
SELECT 'exam::' || path AS key, path, coalesce(nullif(norm, 0), nullif(tm, 0), 1.0::DOUBLE) AS norm, coalesce(nullif(max, 0), nullif(tm, 0), 1.0::DOUBLE) AS max,
  nullif(norm, 0) IS NULL AS auto_norm, nullif(max, 0) IS NULL AS auto_max, coalesce(weight, 1.0::DOUBLE) AS weight, ok
FROM (SELECT *, error = '' AND ord % 10 <> 3 AS ok, CASE WHEN error = '' AND ord % 10 <> 3 THEN total_max ELSE 0 END AS tm FROM fx_exam)""")
def g2(t):
    return cohort.exam_columns(_members(t), t.fx_exam.select("path", "norm", "max", "weight")).drop("label", "error")


@query("g3_scale_warnings", """
WITH m AS (SELECT *, error = '' AND ord % 10 <> 3 AS ok FROM fx_exam), c AS (SELECT *, coalesce(nullif(max, 0), nullif(total_max, 0), 1) AS mx FROM m WHERE ok)
SELECT '' AS path, 'mixed_scales' AS warning, CAST(count(DISTINCT mx) AS VARCHAR) || ' scales' AS detail FROM c HAVING count(DISTINCT mx) > 1
UNION ALL SELECT path, 'unreadable', CASE WHEN label <> '' THEN label ELSE path END || ' : ' || CASE WHEN ord % 10 = 3 THEN 'not readable' ELSE error END FROM m WHERE NOT ok""")
def g3(t):
    return cohort.scale_warnings(cohort.exam_columns(_members(t), t.fx_exam.select("path", "norm", "max", "weight")))


@query("g4_identity_map", "SELECT id, canonical FROM fx_tw_canon")
def g4(t):
    return cohort.identity_map(cohort.people(t.fx_member))["map"]


@query("g4_identity_refused", "SELECT id, reason, n_longer FROM fx_tw_fold WHERE reason IS NOT NULL")
def g4_refused(t):
    return cohort.identity_map(cohort.people(t.fx_member))["refused"]


@query("g5_cohort_table", "SELECT id, name, email, n_ids, n_columns, final, absent_in FROM fx_tw_table")
def g5(t):
    return _joint(t).drop("notes", "raws").withColumn("absent_in", F.array_join("absent_in", ";"))


@query("g6_unlinked", "SELECT count(*) AS n_unlinked FROM fx_member WHERE id = '' AND NOT absent")
def g6(t):
    return cohort.unlinked(t.fx_member)


@query("g6_shown_table", """
SELECT t.id, name, email, coalesce(a.also_id, '') AS also_id, n_columns, final, absent_in, CAST(NULL AS BIGINT) AS unlinked FROM fx_tw_table t
LEFT JOIN (SELECT canonical AS id, string_agg(id, ';' ORDER BY place, id) AS also_id FROM fx_tw_canon WHERE id <> canonical GROUP BY 1) a ON a.id = t.id
UNION ALL SELECT '', '(' || CAST(count(*) AS VARCHAR) || ' copie(s) non reliée(s))', '', '', 0, NULL, '', count(*) FROM fx_member WHERE id = '' AND NOT absent HAVING count(*) > 0""")
def g6_shown(t):
    shown = cohort.shown_table(t.fx_member, _joint_columns(t), 25.0).drop("notes", "raws")
    return shown.withColumn("absent_in", F.array_join("absent_in", ";")).withColumn("also_id", F.array_join("also_id", ";"))


@query("g7_cohort_roster", """
SELECT id, split_part(name, ' ', 1) AS nom, CASE WHEN contains(name, ' ') THEN substr(name, strpos(name, ' ') + 1) ELSE '' END AS prenom, email FROM (
 SELECT id, arg_min(name, exam_ord * 10000000000 + ord) AS name, arg_min(email, exam_ord * 10000000000 + ord) AS email FROM fx_member WHERE id <> '' GROUP BY 1)""")
def g7(t):
    return cohort.cohort_roster(t.fx_member)


_EXPORT = """
SELECT t.id AS id_canonique, name AS nom_prenom, email AS courriel, {cells},
  coalesce(CAST(final AS VARCHAR), '') AS note_finale, absent_in AS absent_de
FROM fx_tw_table t LEFT JOIN (SELECT id, max(raw) FILTER (key = 'F') AS rf, max(note) FILTER (key = 'F') AS nf, max(raw) FILTER (key = 'O') AS ro, max(note) FILTER (key = 'O') AS no,
  max(raw) FILTER (key = 'P') AS rp, max(note) FILTER (key = 'P') AS np FROM fx_tw_notes GROUP BY 1) n ON n.id = t.id""".replace("{cells}", ", ".join(
    f"coalesce(CAST(round_even({p}{k.lower()}, {d}) AS VARCHAR), CASE WHEN contains(absent_in, '{k}') THEN 'ABS' ELSE '' END) AS \"{k}{s}\""
    for k in "FOP" for p, d, s in (("r", 2, "_brut"), ("n", 3, ""))))


@query("a13_cohort_export", _EXPORT)
def a13(t):
    return cohort.cohort_export(_joint(t), [(k, k) for k in "FOP"])


@query("g8_absent_or_blank", """
SELECT t.id, k.key, CASE WHEN n.id IS NOT NULL THEN 'mark' WHEN contains(absent_in, k.key) THEN 'ABS' ELSE '' END AS shown
FROM fx_tw_table t CROSS JOIN (SELECT DISTINCT path AS key FROM fx_member) k LEFT JOIN fx_tw_notes n ON n.id = t.id AND n.key = k.key""")
def g8(t):
    table_ = cohort.cohort_export(_joint(t), [(k, k) for k in "FOP"])
    long = table_.select(F.col("id_canonique").alias("id"), F.explode(F.create_map(*[x for k in "FOP" for x in (F.lit(k), F.col(k))])).alias("key", "v"))
    return long.select("id", "key", F.when(F.col("v").isin("", "ABS"), F.col("v")).otherwise("mark").alias("shown"))


@query("g9_cohort_summary", """
SELECT count(*) AS n_students, count(*) FILTER (n_columns = 3) AS n_complete, count(*) FILTER (n_columns BETWEEN 1 AND 2) AS n_partial,
  (SELECT count(*) FROM fx_member WHERE id = '' AND NOT absent) AS n_unlinked, count(final) AS n, round(avg(final), 6) AS mean, round(var_pop(final), 6) AS variance, round(stddev_pop(final), 6) AS std,
  median(final) AS median, min(final) AS min, max(final) AS max FROM fx_tw_table""")
def g9(t):
    out = cohort.cohort_summary(_joint(t), 3, cohort.unlinked(t.fx_member))
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "variance", "std") else c for c in out.columns])


@query("g10_calibration_series", "SELECT id, key, round_even(note, 3) AS mark FROM fx_tw_notes")
def g10(t):
    return cohort.calibration_series(cohort.cohort_marks(t.fx_member, _joint_columns(t)))


@query("g11_candidates", "SELECT path, label FROM fx_exam WHERE path NOT IN (SELECT 'e' || CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08 AND l_returnflag = 'R')")
def g11(t):
    listed = t.lineitem.filter("l_quantity > 49 AND l_discount > 0.08 AND l_returnflag = 'R'").select(F.concat(F.lit("e"), F.col("l_suppkey").cast("string")).alias("path"))
    return cohort.candidates(t.fx_exam.select("path", "label"), listed)


# ------------------------------------------------------------ questions (H)

view("fx_tw_qstats", """
SELECT q, max_score, count(*) AS n_eval, CAST(sum(CASE WHEN score >= max_score - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_perfect, sum(score) AS sum_score,
  avg(score) AS mean_score, sum(score) / max_score AS sum_normalized, avg(score) / max_score AS mean_normalized FROM {fx_tw_score} WHERE max_score > 0 GROUP BY 1, 2""")


def _distribution(t):
    return questions.score_distribution(t.fx_copy, exam_scored(t), exam_key(t))


def _stats(t):
    return questions.question_stats(_distribution(t), exam_key(t))


@query("h1_question_stats", """
SELECT q, max_score, n_eval, n_perfect, sum_score, round(mean_score, 6) AS mean_score, round(mean_normalized, 6) AS mean_normalized FROM fx_tw_qstats""")
def h1(t):
    return _stats(t).select("q", "max_score", "n_eval", "n_perfect", "sum_score", F.round("mean_score", 6).alias("mean_score"),
                            F.round("mean_normalized", 6).alias("mean_normalized"))


@query("h1_score_distribution", "SELECT q, score, count(*) AS n FROM fx_tw_score GROUP BY 1, 2")
def h1_distribution(t):
    return _distribution(t)


@query("h2_rank_questions", "SELECT q, n_eval, round(mean_normalized, 6) AS success FROM fx_tw_qstats ORDER BY success DESC")
def h2(t):
    return questions.rank_questions(_stats(t)).select("q", "n_eval", F.round("mean_normalized", 6).alias("success"))


@query("h3_normalized_histogram", """
SELECT q, CAST(greatest(0, least(14, floor((greatest(-0.5, least(1.0, score / max_score)) + 0.5) * 10 + 1e-9))) AS INT) AS bin, count(*) AS n FROM fx_tw_score WHERE max_score > 0 GROUP BY 1, 2""")
def h3(t):
    return questions.normalized_histogram(_distribution(t), exam_key(t))


@query("h4_bank_sync", """
SELECT 'b' || CAST(q % 3 AS VARCHAR) AS bank_id, CAST(sum(n_eval) AS BIGINT) AS n_eval, round(sum(sum_normalized), 6) AS sum_normalized, CAST(sum(n_perfect) AS BIGINT) AS n_perfect, max(max_score) AS max_score_at_sync FROM fx_tw_qstats GROUP BY 1""")
def h4(t):
    instances = t.fx_question.select("q", F.concat(F.lit("b"), (F.col("q") % 3).cast("string")).alias("bank_id"))
    return questions.bank_sync(_stats(t), instances).withColumn("sum_normalized", F.round("sum_normalized", 6))


@query("h5_upsert_project_stats", """
SELECT question_id, user_id, project_name, CASE WHEN project_name = 'R' THEN n_eval + 1 ELSE n_eval END AS n_eval, n_perfect FROM fx_eval
UNION ALL SELECT question_id, user_id, 'new', n_eval, n_perfect FROM fx_eval WHERE project_name = 'A'""")
def h5(t):
    stored = t.fx_eval.drop("sum_normalized")
    again = stored.filter("project_name = 'R'").withColumn("n_eval", F.col("n_eval") + 1)
    fresh = again.unionByName(stored.filter("project_name = 'A'").withColumn("project_name", F.lit("new")))
    return questions.upsert(questions.upsert(stored, fresh), fresh)


@query("h6_stats_summary", """
SELECT question_id, CAST(sum(n_eval) AS BIGINT) AS n_eval, CAST(sum(n_perfect) AS BIGINT) AS n_perfect, round(sum(sum_normalized) / sum(n_eval), 6) AS mean_normalized, count(*) AS n_projects
FROM fx_eval WHERE n_eval > 0 GROUP BY 1""")
def h6(t):
    return questions.stats_summary(t.fx_eval).drop("sum_normalized").withColumn("mean_normalized", F.round("mean_normalized", 6))


@query("h7_global_eval_stats", """
SELECT question_id, count(DISTINCT user_id) AS n_users, count(DISTINCT CAST(user_id AS VARCHAR) || '|' || project_name) AS n_projects, CAST(sum(n_eval) AS BIGINT) AS n_eval,
  CAST(sum(n_perfect) AS BIGINT) AS n_perfect, round(sum(sum_normalized) / sum(n_eval), 6) AS mean_normalized FROM fx_eval GROUP BY 1""")
def h7(t):
    return questions.global_eval_stats(t.fx_eval).withColumn("mean_normalized", F.round("mean_normalized", 6))


@query("h8_rating_stats", """
SELECT question_id, round(avg(stars), 6) AS avg_stars, count(stars) AS n_ratings, count(*) FILTER (favorite) AS n_favorites FROM fx_rating GROUP BY 1""")
def h8(t):
    return questions.rating_stats(t.fx_rating).withColumn("avg_stars", F.round("avg_stars", 6))


def _card(t):
    detail = scoring.copy_questions(t.fx_copy, exam_scored(t), exam_key(t))
    return questions.student_card(detail, exam_key(t), t.fx_edit)


@query("h9_student_card", """
SELECT s.copy_key, s.q, sel AS selected, correct, score, max_score, d.q IS NOT NULL AS has_diff FROM fx_tw_score s
LEFT JOIN (SELECT DISTINCT copy_key, q FROM fx_edit) d ON d.copy_key = s.copy_key AND d.q = s.q""")
def h9(t):
    return _card(t)


@query("h9_card_totals", """
SELECT s.copy_key, round(sum(score), 4) AS total, round(sum(max_score), 6) AS total_max, count(d.q) AS n_diff FROM fx_tw_score s
LEFT JOIN (SELECT DISTINCT copy_key, q FROM fx_edit) d ON d.copy_key = s.copy_key AND d.q = s.q GROUP BY 1""")
def h9_totals(t):
    return questions.card_totals(_card(t))


view("fx_rating_change", """
SELECT event_id % 200 AS question_id, user_id, max(CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INT) % 8 END) AS stars,
  max(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 0 END) = 1 AS favorite
FROM {events} WHERE event_type <> 'view' GROUP BY 1, 2""")


@query("h10_rating_upsert", """
WITH g AS (SELECT * FROM fx_rating_change WHERE stars IS NULL OR stars BETWEEN 1 AND 5)
SELECT coalesce(r.question_id, g.question_id) AS question_id, coalesce(r.user_id, g.user_id) AS user_id, coalesce(g.stars, r.stars) AS stars, coalesce(g.favorite, r.favorite, false) AS favorite
FROM fx_rating r FULL JOIN g ON g.question_id = r.question_id AND g.user_id = r.user_id""")
def h10(t):
    return questions.merge_ratings(t.fx_rating, t.fx_rating_change)["ratings"]


@query("h10_rating_rejected", "SELECT * FROM fx_rating_change WHERE stars NOT BETWEEN 1 AND 5")
def h10_rejected(t):
    return questions.merge_ratings(t.fx_rating, t.fx_rating_change)["rejected"]


@query("h10_personal_tags", """
WITH s AS (SELECT question_id, user_id, 'old' AS tags FROM fx_rating), c AS (SELECT question_id, user_id, CASE WHEN favorite THEN 'hard;todo' ELSE '' END AS tags FROM fx_rating_change)
SELECT * FROM (SELECT s.* FROM s ANTI JOIN c ON s.question_id = c.question_id AND s.user_id = c.user_id UNION ALL SELECT * FROM c) WHERE tags <> ''""")
def h10_tags(t):
    stored = t.fx_rating.select("question_id", "user_id", F.array(F.lit("old")).alias("tags"))
    changes = t.fx_rating_change.select("question_id", "user_id", F.when(F.col("favorite"), F.array(F.lit(" todo "), F.lit("hard"), F.lit("todo")))
                                        .otherwise(F.array(F.lit(" "))).alias("tags"))
    return questions.merge_tags(stored, changes).withColumn("tags", F.array_join("tags", ";"))
