"""Cell decisions, labels and evaluation queries; the measures come from the line items."""

from pyspark.sql import functions as F

from tallyloom.operators import cells, evaluate, model
from tallyloom.plans.registry import query, view

# ------------------------------------------------------------ decisions (J)

view("fx_tw_sorted", """
SELECT copy_key, q, ratio, row_number() OVER w AS rn, lead(ratio) OVER w AS nx FROM {fx_cell} WINDOW w AS (PARTITION BY copy_key, q ORDER BY ratio DESC)""")
view("fx_tw_gap", """
SELECT copy_key, q, ratio - nx AS gap, (ratio + nx) / 2 AS mid FROM (SELECT *, row_number() OVER (PARTITION BY copy_key, q ORDER BY ratio - nx DESC, rn) AS k FROM {fx_tw_sorted} WHERE nx IS NOT NULL AND ratio > nx) WHERE k = 1""")
view("fx_tw_base", "SELECT copy_key, list_sort(list(ratio))[CAST(floor(count(*) / 2) AS INT) + 1] AS baseline FROM {fx_cell} GROUP BY 1")
view("fx_tw_measure", """
SELECT c.copy_key, c.q, median(ratio) AS median, avg(ratio) AS mean, stddev_pop(ratio) AS std, any_value(CASE WHEN g.gap >= 0.1::DOUBLE AND g.mid >= 0.18::DOUBLE THEN g.mid ELSE 0.5 END) AS threshold,
  any_value(CASE WHEN g.gap >= 0.1::DOUBLE AND g.mid >= 0.18::DOUBLE THEN g.mid ELSE greatest(0.18::DOUBLE, b.baseline + 0.1::DOUBLE) END) AS light_threshold
FROM {fx_cell} c LEFT JOIN {fx_tw_gap} g ON g.copy_key = c.copy_key AND g.q = c.q JOIN {fx_tw_base} b ON b.copy_key = c.copy_key GROUP BY 1, 2""")


@query("j1_adaptive_threshold", "SELECT copy_key, q, round(threshold, 6) AS threshold, round(light_threshold, 6) AS light_threshold FROM fx_tw_measure")
def j1(t):
    plain = cells.question_measures(t.fx_cell).select("copy_key", "q", F.round("threshold", 6).alias("threshold"))
    light = cells.question_measures(t.fx_cell, cells.copy_baseline(t.fx_cell)).select("copy_key", "q", F.round("threshold", 6).alias("light_threshold"))
    return plain.join(light, ["copy_key", "q"])


@query("j2_question_measures", "SELECT copy_key, q, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(threshold, 6) AS threshold FROM fx_tw_measure")
def j2(t):
    out = cells.question_measures(t.fx_cell)
    return out.select("copy_key", "q", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std", "threshold")])


@query("j3_copy_baseline", "SELECT copy_key, baseline FROM fx_tw_base")
def j3(t):
    return cells.copy_baseline(t.fx_cell)


@query("j4_context_features", """
SELECT c.copy_key, c.q, c.ch, round(ratio - median, 6) AS ratio_minus_q_median, round((ratio - mean) / greatest(std, 0.01), 6) AS ratio_z_in_q, round(ratio - baseline, 6) AS ratio_minus_copy_baseline,
  round(threshold, 6) AS question_threshold, round(ratio - threshold, 6) AS ratio_above_threshold
FROM fx_cell c JOIN fx_tw_measure m ON m.copy_key = c.copy_key AND m.q = c.q JOIN fx_tw_base b ON b.copy_key = c.copy_key""")
def j4(t):
    out = cells.context_features(t.fx_cell)
    return out.select("copy_key", "q", "ch", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("ratio_") or c == "question_threshold"])


@query("j5_intensity_features", """
WITH p AS (SELECT cell_key, list_transform(pixels, lambda x: greatest(0, least(255, CAST(floor(140 + 500 * CAST(x AS DOUBLE)) AS INT)))) AS px FROM fx_intensity),
u AS (SELECT cell_key, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM p),
a AS (SELECT cell_key, count(*) AS n, quantile_cont(v, 0.85) AS paper, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (v <= 128) AS dark, count(*) FILTER (v BETWEEN 120 AND 200) AS light,
  avg(i % 8) FILTER (v <= 128) AS mx, avg(i // 8) FILTER (v <= 128) AS my, stddev_pop(i % 8) FILTER (v <= 128) AS sx, stddev_pop(i // 8) FILTER (v <= 128) AS sy FROM u GROUP BY 1),
d AS (SELECT u.cell_key, count(*) FILTER (v < 0.6 * greatest(paper, 1)) AS k FROM u JOIN a ON a.cell_key = u.cell_key GROUP BY 1)
SELECT a.cell_key, round(greatest(paper, 1), 6) AS paper_level, round(mean, 6) AS mean_intensity, round(std, 6) AS std_intensity, round(dark / n, 6) AS fill_ratio, round(d.k / n, 6) AS dark_ratio, round(light / n, 6) AS light_gray_ratio,
  round(CASE WHEN dark > 5 THEN mx / 8 - 0.5 ELSE 0 END, 6) AS centroid_dx, round(CASE WHEN dark > 5 THEN my / (n / 8) - 0.5 ELSE 0 END, 6) AS centroid_dy,
  round(CASE WHEN dark > 5 THEN sx / 8 ELSE 0 END, 6) AS dark_std_x, round(CASE WHEN dark > 5 THEN sy / (n / 8) ELSE 0 END, 6) AS dark_std_y
FROM a JOIN d ON d.cell_key = a.cell_key""")
def j5(t):
    grey = F.transform("pixels", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(140 + 500 * x.cast("double")).cast("int"))))
    out = cells.intensity_features(t.fx_intensity.select("cell_key", grey.alias("pixels")), "pixels", 8)
    return out.select("cell_key", *[F.round(c, 6).alias(c) for c in out.columns if c != "cell_key"])


def measured(t):
    """Cells with their question threshold; one in four has no model probability."""
    proba = F.when(F.col("copy_key") % 4 > 0, F.col("proba"))
    return t.fx_cell.join(cells.question_measures(t.fx_cell).select("copy_key", "q", "threshold"), ["copy_key", "q"]).withColumn("proba", proba)


view("fx_tw_decided", """
SELECT *, CASE WHEN proba IS NULL OR isnan(masked) THEN e2 ELSE proba >= 0.5 END AS ticked, coalesce(isnan(masked) AND (proba >= 0.5) <> e2, false) AS no_masked, CASE WHEN NOT isnan(masked) THEN masked > 0.12::DOUBLE END AS e1, CASE WHEN NOT isnan(masked) THEN proba END AS published
FROM (SELECT c.copy_key, c.q, c.ch, ratio, masked, truth, m.threshold, ratio > m.threshold AS e2, CASE WHEN c.copy_key % 4 > 0 THEN proba END AS proba FROM {fx_cell} c JOIN {fx_tw_measure} m ON m.copy_key = c.copy_key AND m.q = c.q)""")
view("fx_tw_reason", """
SELECT *, concat_ws(';', CASE WHEN (e1 IS NOT NULL AND e1 <> e2) OR (e1 IS NOT NULL AND e1 <> ticked) OR e2 <> ticked THEN 'disagree' END, CASE WHEN published BETWEEN 0.3 AND 0.7 THEN 'uncertain' END, CASE WHEN no_masked THEN 'no_masked' END) AS reasons FROM {fx_tw_decided}""")


@query("j6_decide_cell", "SELECT copy_key, q, ch, ticked, published, no_masked FROM fx_tw_decided")
def j6(t):
    base = measured(t).withColumn("e2", F.col("ratio") > F.col("threshold"))
    ticked, published, no_masked = cells.decide_cell("proba", "e2", "masked")
    return base.select("copy_key", "q", "ch", ticked.alias("ticked"), published.alias("published"), no_masked.alias("no_masked"))


@query("j7_flag_reasons", "SELECT copy_key, q, ch, e1, e2, ticked, published, reasons FROM fx_tw_reason")
def j7(t):
    return cells.flag_reasons(measured(t)).select("copy_key", "q", "ch", "e1", "e2", "ticked", "published", F.array_join("reasons", ";").alias("reasons"))


view("fx_digit", """
SELECT l_orderkey AS copy_key, l_linenumber AS col, CAST(CAST(floor(l_quantity) AS INT) % 10 AS STRING) AS ch, max(l_discount * 4) AS ratio FROM {lineitem} GROUP BY 1, 2, 3""")
view("fx_tw_digit", """
SELECT copy_key, col, CASE WHEN max(ratio) >= 0.15::DOUBLE AND max(ratio) - coalesce(max(ratio) FILTER (rn = 2), 0) >= 0.05::DOUBLE THEN max(ch) FILTER (rn = 1) END AS digit
FROM (SELECT *, row_number() OVER (PARTITION BY copy_key, col ORDER BY ratio DESC, CAST(ch AS INT)) AS rn FROM {fx_digit}) GROUP BY 1, 2""")


@query("j8_decode_student_id", "SELECT copy_key, string_agg(coalesce(digit, '?'), '' ORDER BY col) AS student_id FROM fx_tw_digit GROUP BY 1")
def j8(t):
    return cells.decode_student_id(t.fx_digit)


@query("j9_decode_copy_grid", """
SELECT copy_key, CASE WHEN bool_and(digit IS NOT NULL) THEN CAST(string_agg(digit, '' ORDER BY col DESC) AS BIGINT) END AS copy_id FROM fx_tw_digit GROUP BY 1""")
def j9(t):
    return cells.decode_copy_grid(t.fx_digit.withColumnRenamed("col", "rank"))


view("fx_bit", """
SELECT l_orderkey AS page_key, CAST(1 + (l_linenumber - 1) % 3 AS INT) AS kind, CAST(1 + floor((l_linenumber - 1) / 3.0) AS INT) AS rank, max(l_tax * 10) AS ratio
FROM {lineitem} GROUP BY 1, 2, 3""")
view("fx_known_code", "SELECT DISTINCT s_suppkey % 8 AS copy, (s_suppkey + 1) % 4 AS page, s_suppkey % 3 AS checksum FROM {supplier}")
view("fx_tw_code", """
WITH s AS (SELECT page_key, ratio, row_number() OVER w AS rn, lead(ratio) OVER w AS nx FROM {fx_bit} WINDOW w AS (PARTITION BY page_key ORDER BY ratio DESC)),
g AS (SELECT page_key, ratio - nx AS gap, (ratio + nx) / 2 AS mid FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY ratio - nx DESC, rn) AS k FROM s WHERE nx IS NOT NULL AND ratio > nx) WHERE k = 1),
b AS (SELECT b.*, CASE WHEN g.gap >= 0.15::DOUBLE THEN g.mid ELSE 0.5 END AS thr FROM {fx_bit} b LEFT JOIN g ON g.page_key = b.page_key)
SELECT page_key, CAST(sum(CASE WHEN ratio > thr THEN 1 << (3 - rank) ELSE 0 END) FILTER (kind = 1) AS BIGINT) AS copy, CAST(sum(CASE WHEN ratio > thr THEN 1 << greatest(0, 2 - rank) ELSE 0 END) FILTER (kind = 2) AS BIGINT) AS page,
  CAST(sum(CASE WHEN ratio > thr THEN 1 << greatest(0, 2 - rank) ELSE 0 END) FILTER (kind = 3) AS BIGINT) AS checksum FROM b GROUP BY 1
HAVING count(*) FILTER (kind = 1) > 0 AND count(*) FILTER (kind = 2) > 0 AND count(*) FILTER (kind = 3) > 0""")


def _codes(t):
    return cells.decode_page_codes(t.fx_bit, {1: 3, 2: 2, 3: 2})


@query("j10_decode_page_codes", """
SELECT c.* FROM fx_tw_code c SEMI JOIN fx_known_code k ON k.copy = c.copy AND k.page = c.page AND k.checksum = c.checksum""")
def j10(t):
    return cells.known_codes(_codes(t), t.fx_known_code).select("page_key", "copy", "page", "checksum")


@query("j11_unique_codes", """
WITH k AS (SELECT p.k AS page_key, c.copy, c.page, c.checksum FROM (SELECT page_key, page_key // 3 AS k, copy, page, checksum FROM fx_tw_code) c JOIN (SELECT DISTINCT page_key // 3 AS k FROM fx_tw_code) p ON p.k = c.k
  SEMI JOIN fx_known_code n ON n.copy = c.copy AND n.page = c.page AND n.checksum = c.checksum)
SELECT page_key, any_value(copy) AS copy, any_value(page) AS page, any_value(checksum) AS checksum FROM k GROUP BY 1 HAVING count(DISTINCT copy * 10000 + page * 100 + checksum) = 1""")
def j11(t):
    candidates = _codes(t).withColumn("page_key", F.floor(F.col("page_key") / 3))
    return cells.unique_codes(candidates, t.fx_known_code)


@query("j12_question_offsets", """
SELECT copy_key, q, list_sort(list(dx))[CAST(floor(count(*) / 2) AS INT) + 1] AS dx, list_sort(list(dy))[CAST(floor(count(*) / 2) AS INT) + 1] AS dy
FROM (SELECT l_orderkey AS copy_key, l_linenumber AS q, CAST(l_suppkey % 9 AS INT) - 4 AS dx, CAST(l_partkey % 7 AS INT) - 3 AS dy FROM lineitem) GROUP BY 1, 2""")
def j12(t):
    return cells.question_offsets(t.lineitem.select(
        F.col("l_orderkey").alias("copy_key"), F.col("l_linenumber").alias("q"),
        ((F.col("l_suppkey") % 9).cast("int") - 4).alias("dx"), ((F.col("l_partkey") % 7).cast("int") - 3).alias("dy")))


@query("j13_answer_sheet", """
SELECT copy_key, count(*) FILTER (isnan(masked)) AS n_frame_fail, count(*) AS n_cells, count(*) FILTER (isnan(masked)) < 0.7::DOUBLE * count(*) AS is_answer_sheet FROM fx_cell GROUP BY 1""")
def j13(t):
    return cells.answer_sheet_flags(t.fx_cell.withColumn("frame_detected", F.when(F.isnan("masked"), 0).otherwise(1)))


@query("j14_pick_sheet", """
WITH s AS (SELECT copy_key, q AS sheet, max(ratio) AS share FROM fx_cell GROUP BY 1, 2), b AS (SELECT copy_key, arg_max(sheet, share * 1000 - sheet) AS best, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT copy_key, CASE WHEN copy_key % 3 > 0 THEN CAST(1 + copy_key % 9 AS INT) END AS page_no FROM b)
SELECT c.copy_key, CASE WHEN s.sheet IS NOT NULL THEN c.page_no ELSE best END AS sheet, CASE WHEN s.sheet IS NOT NULL THEN 'printed' WHEN n = 1 THEN 'only' ELSE 'frames' END AS source
FROM c JOIN b ON b.copy_key = c.copy_key LEFT JOIN s ON s.copy_key = c.copy_key AND s.sheet = c.page_no""")
def j14(t):
    shares = t.fx_cell.groupBy("copy_key", F.col("q").alias("sheet")).agg(F.max("ratio").alias("share"))
    scans = t.fx_cell.select("copy_key").distinct().withColumn("page_no", F.when(F.col("copy_key") % 3 > 0, (1 + F.col("copy_key") % 9).cast("int")))
    return cells.pick_sheets(scans, shares)


@query("j15_copy_numbers", """
WITH s AS (SELECT o_orderkey AS copy_key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS p, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE o_custkey + 1 END AS g FROM orders),
r AS (SELECT copy_key, coalesce(p, nullif(g, 0), 1) AS id, CASE WHEN p IS NOT NULL THEN 'printed' WHEN coalesce(nullif(g, 0), 1) <> 1 THEN 'grid' ELSE 'default' END AS src FROM s)
SELECT copy_key, CASE WHEN id = 1 OR a.k IS NOT NULL THEN id ELSE 1 END AS copy_id, CASE WHEN id = 1 OR a.k IS NOT NULL THEN src ELSE 'default' END AS source FROM r LEFT JOIN (SELECT s_suppkey AS k FROM supplier) a ON a.k = r.id""")
def j15(t):
    key = F.col("o_orderkey")
    scans = t.orders.select(key.alias("copy_key"), F.when(key % 3 == 0, F.col("o_custkey")).alias("printed_id"),
                            F.when(key % 4 == 1, 1).when(key % 4 == 2, 0).when(key % 4 == 3, F.col("o_custkey") + 1).alias("grid_id"))
    return cells.copy_numbers(scans, t.supplier.select(F.col("s_suppkey").alias("copy")))


@query("j16_assemble_answers", """
SELECT copy_key, q, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (ticked), '') AS letters, count(*) FILTER (ticked <> e2) AS n_overrides, count(*) FILTER (reasons <> '') AS n_ambiguous FROM fx_tw_reason GROUP BY 1, 2""")
def j16(t):
    return cells.assemble_answers(cells.flag_reasons(measured(t)))


@query("j16_reading_notes", """
SELECT copy_key, concat_ws('; ', 'ml=on(overrides=' || CAST(count(*) FILTER (ticked <> e2) AS VARCHAR) || ')', CASE WHEN count(*) FILTER (reasons <> '') > 0 THEN 'ambigu(' || CAST(count(*) FILTER (reasons <> '') AS VARCHAR) || ')' END) AS notes
FROM fx_tw_reason GROUP BY 1""")
def j16_notes(t):
    return cells.reading_notes(cells.assemble_answers(cells.flag_reasons(measured(t))))


# ------------------------------------------------------------ labels and evaluation (K)


view("fx_optcell", "SELECT copy_key, q, ch FROM {fx_cell}")
view("fx_tw_human", """
SELECT c.copy_key, c.q, c.ch, CASE WHEN r.q IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN v.validated THEN 'ui_validated' ELSE 'ui_reviewed' END AS source FROM {fx_optcell} c JOIN {fx_vcopy} v ON v.copy_key = c.copy_key
LEFT JOIN {fx_tw_reviewed} w ON w.copy_key = c.copy_key AND w.q = c.q AND w.ch = c.ch LEFT JOIN {fx_current} r ON r.copy_key = c.copy_key AND r.q = c.q AND r.ch = c.ch WHERE v.validated OR w.q IS NOT NULL""")
view("fx_zone", """
SELECT l_orderkey AS copy_key, l_linenumber AS q, substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) AS ch, CAST(max(CASE WHEN l_returnflag = 'A' THEN 3 ELSE 4 END) AS INT) AS type,
  CAST(max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 ELSE -1 END) AS INT) AS manual, max(CASE WHEN l_tax > 0.07 THEN 0 ELSE 100 END) AS total, max(l_discount * 1000) AS black FROM {lineitem} GROUP BY 1, 2, 3""")
view("fx_tw_manual", """
SELECT copy_key, q, ch, CASE WHEN (manual IN (0, 1) AND manual = 1) OR (manual = -1 AND black / total >= 0.5) THEN 1 ELSE 0 END AS label FROM {fx_zone} WHERE type = 4 AND (manual IN (0, 1) OR (manual = -1 AND total > 0))""")


def _reviewed(t):
    from tallyloom.operators import review
    return review.reviewed_cells(t.fx_review_mark, review.edited_cells(t.fx_current, t.fx_tick))


def _manual(t):
    return evaluate.manual_truth(t.fx_zone).select("copy_key", "q", "ch", F.col("truth").cast("int").alias("label"))


def _labels(t):
    return evaluate.label_precedence(evaluate.human_labels(t.fx_vcopy, t.fx_current, _reviewed(t), t.fx_optcell), _manual(t))


@query("a6_manual_truth", "SELECT * FROM fx_tw_manual")
def a6(t):
    return _manual(t)


@query("k1_human_labels", "SELECT * FROM fx_tw_human")
def k1(t):
    return evaluate.human_labels(t.fx_vcopy, t.fx_current, _reviewed(t), t.fx_optcell)


view("fx_tw_label", """
SELECT coalesce(h.copy_key, m.copy_key) AS copy_key, coalesce(h.q, m.q) AS q, coalesce(h.ch, m.ch) AS ch, coalesce(h.label, m.label) AS label, coalesce(h.source, 'amc_manual') AS source
FROM {fx_tw_human} h FULL JOIN {fx_tw_manual} m ON m.copy_key = h.copy_key AND m.q = h.q AND m.ch = h.ch""")


@query("k2_label_precedence", "SELECT * FROM fx_tw_label")
def k2(t):
    return _labels(t)


@query("k3_build_dataset", """
SELECT l.*, c.ratio, round(c.ratio - m.threshold, 6) AS ratio_above_threshold FROM fx_tw_label l JOIN fx_cell c ON c.copy_key = l.copy_key AND c.q = l.q AND c.ch = l.ch JOIN fx_tw_measure m ON m.copy_key = c.copy_key AND m.q = c.q""")
def k3(t):
    data = evaluate.build_dataset(_labels(t), cells.context_features(t.fx_cell))
    return data.select("copy_key", "q", "ch", "label", "source", "ratio", F.round("ratio_above_threshold", 6).alias("ratio_above_threshold"))


@query("a12_dataset_summary", """
SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_filled, count(DISTINCT copy_key) AS n_copies FROM fx_tw_label GROUP BY 1""")
def a12(t):
    from tallyloom.sources.sinks import dataset_summary
    return dataset_summary(_labels(t))


@query("k4_split_by_copy", """
WITH c AS (SELECT DISTINCT copy_key FROM fx_cell), r AS (SELECT copy_key, row_number() OVER (ORDER BY md5(CAST(copy_key AS VARCHAR) || '-42'), copy_key) AS rn, count(*) OVER () AS n FROM c)
SELECT copy_key, rn <= greatest(1, floor(n * 0.2::DOUBLE)) AS is_test FROM r""")
def k4(t):
    return evaluate.split_by_copy(t.fx_cell.select("copy_key")).distinct()


def predicted(t):
    data = t.fx_cell.withColumnRenamed("truth", "label").join(cells.question_measures(t.fx_cell).select("copy_key", "q", "threshold"), ["copy_key", "q"])
    return evaluate.baseline_predict(data)


view("fx_tw_pred", """
SELECT c.copy_key, c.q, c.ch, c.ratio, m.threshold, CAST(truth AS INT) AS label, CASE WHEN c.ratio > m.threshold THEN 1 ELSE 0 END AS prediction FROM {fx_cell} c JOIN {fx_tw_measure} m ON m.copy_key = c.copy_key AND m.q = c.q""")
_CONF = """count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"""
_SCORE = """n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_filled, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_filled,
  round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_empty, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_empty, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_filled, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_empty"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


@query("k5_baseline_predict", "SELECT copy_key, q, ch, prediction FROM fx_tw_pred")
def k5(t):
    return predicted(t).select("copy_key", "q", "ch", "prediction")


@query("k6_train_and_predict")
def k6(t):
    split = evaluate.split_by_copy(_training(t))
    fitted = model.train(split.filter("NOT is_test"), FEATURES)
    return model.predict(fitted, split.filter("is_test"), FEATURES).select("copy_key", "q", "ch", "label", "proba", "prediction")


FEATURES = ["ratio", "masked", "ratio_minus_q_median", "ratio_minus_copy_baseline", "ratio_above_threshold"]


def _training(t):
    from tallyloom.session import durable
    return durable(cells.context_features(t.fx_cell).withColumnRenamed("truth", "label").select("copy_key", "q", "ch", "label", *FEATURES))


@query("k7_model_scores")
def k7(t):
    data = _training(t)
    split = evaluate.split_by_copy(data)
    fitted = model.train(split.filter("NOT is_test"), FEATURES)
    return evaluate.evaluate(model.predict(fitted, split.filter("is_test"), FEATURES))


@query("k8_evaluate", f"SELECT {_SCORE} FROM (SELECT {_CONF} FROM fx_tw_pred)")
def k8(t):
    return _rounded(evaluate.evaluate(predicted(t)))


@query("k9_slices", f"""
WITH s AS (SELECT 'all' AS slice, * FROM fx_tw_pred UNION ALL SELECT 'ambiguous', * FROM fx_tw_pred WHERE ratio BETWEEN 0.2::DOUBLE AND 0.45::DOUBLE UNION ALL SELECT 'near', * FROM fx_tw_pred WHERE abs(ratio - threshold) < 0.1::DOUBLE)
SELECT slice, {_SCORE} FROM (SELECT slice, {_CONF} FROM s GROUP BY 1)""")
def k9(t):
    return _rounded(evaluate.evaluate_slices(predicted(t)))


@query("k10_assign_folds", """
SELECT copy_key, n AS n_cells, CAST((row_number() OVER (ORDER BY n DESC, md5(CAST(copy_key AS VARCHAR) || '-42'), copy_key) - 1) % 5 AS INT) AS fold FROM (SELECT copy_key, count(*) AS n FROM fx_cell GROUP BY 1)""")
def k10(t):
    return evaluate.assign_folds(t.fx_cell)


#: all measures of a cell: against its question and copy, and of its picture
CONTEXT = ["ratio", "masked", "ratio_minus_q_median", "ratio_z_in_q", "ratio_minus_copy_baseline", "question_threshold", "ratio_above_threshold"]
PICTURE = ["paper_level", "mean_intensity", "std_intensity", "fill_ratio", "dark_ratio", "light_gray_ratio", "centroid_dx", "centroid_dy", "dark_std_x", "dark_std_y"]


def _all_measures(t, folder):
    """Cells with all their measures; the pictures are dealt out by copy and question. Written without the pictures, which are few."""
    from tallyloom.session import durable, stored
    grey = F.transform("pixels", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(140 + 500 * x.cast("double")).cast("int"))))
    pictures = durable(cells.intensity_features(t.fx_intensity.select("cell_key", grey.alias("pixels")), "pixels", 8).select("cell_key", *PICTURE))
    n = pictures.agg(F.count("*"))
    data = cells.context_features(t.fx_cell).withColumnRenamed("truth", "label").select("copy_key", "q", "label", *CONTEXT)
    placed = stored(data, f"{folder}/context").withColumn("cell_key", F.pmod(F.col("copy_key") * 7 + F.col("q"), n.scalar()))
    joined = placed.join(pictures, "cell_key", "left").withColumn("threshold", F.col("question_threshold"))
    return joined.select("copy_key", "label", "threshold", *CONTEXT, *PICTURE)


def _fold_scores(t):
    from tallyloom.session import passing_folder
    with passing_folder(t.spark, "measures") as folder:
        return model.cross_validate(_all_measures(t, folder), CONTEXT + PICTURE, k=5)


@query("k10_cross_validate")
def k10_scores(t):
    return model.cross_validation_summary(_fold_scores(t))


@query("k10_fold_scores")
def k10_folds(t):
    return _fold_scores(t)


_BASE = "count(*) FILTER ({0} AND b = 1 AND label = 1) AS baseline_tp{1}, count(*) FILTER ({0} AND b = 1 AND label = 0) AS baseline_fp{1}, count(*) FILTER ({0} AND b = 0 AND label = 1) AS baseline_fn{1}, count(*) FILTER ({0} AND b = 0 AND label = 0) AS baseline_tn{1}"


@query("k10_fold_baseline", f"""
WITH f AS (SELECT copy_key, CAST((row_number() OVER (ORDER BY n DESC, md5(CAST(copy_key AS VARCHAR) || '-42'), copy_key) - 1) % 5 AS INT) AS fold FROM (SELECT copy_key, count(*) AS n FROM fx_cell GROUP BY 1)),
p AS (SELECT fold, label, prediction AS b, ratio BETWEEN 0.2::DOUBLE AND 0.45::DOUBLE AS z FROM fx_tw_pred t JOIN f ON f.copy_key = t.copy_key),
c AS (SELECT fold, count(*) AS n, count(*) FILTER (z) AS n_ambiguous, {_BASE.format("true", "")}, {_BASE.format("z", "_ambiguous")} FROM p GROUP BY 1)
SELECT *, round((baseline_tp + baseline_tn) / n, 6) AS baseline_accuracy, round((baseline_tp_ambiguous + baseline_tn_ambiguous) / nullif(n_ambiguous, 0), 6) AS baseline_accuracy_ambiguous FROM c""")
def k10_baseline(t):
    folded = predicted(t).join(evaluate.assign_folds(t.fx_cell).select("copy_key", "fold"), "copy_key")
    scores = model.fold_scores(folded)
    return _rounded(scores.select("fold", "n", "n_ambiguous", *[c for c in scores.columns if c.startswith("baseline_")]))


view("fx_tw_bench", """
SELECT copy_key, count(*) AS n, count(*) FILTER (label = prediction) AS n_match, count(*) FILTER (label < prediction) AS n_fp, count(*) FILTER (label > prediction) AS n_fn, round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy
FROM {fx_tw_pred} GROUP BY ROLLUP (copy_key)""")


@query("k11_benchmark", "SELECT * FROM fx_tw_bench")
def k11(t):
    return _rounded(evaluate.benchmark(predicted(t)))


@query("k11_worst_copies", "SELECT * FROM fx_tw_bench WHERE copy_key IS NOT NULL ORDER BY accuracy, copy_key LIMIT 15")
def k11_worst(t):
    return _rounded(evaluate.worst_copies(evaluate.benchmark(predicted(t))))


@query("k12_mismatch_bins", """
SELECT CASE WHEN ratio < 0.2 THEN 0.0::DOUBLE WHEN ratio < 0.4 THEN 0.2 WHEN ratio < 0.5 THEN 0.4 WHEN ratio < 0.6 THEN 0.5 WHEN ratio < 0.8 THEN 0.6 ELSE 0.8 END AS bin, count(*) AS n,
  count(*) FILTER (prediction = 1) AS n_fp, count(*) FILTER (prediction = 0) AS n_fn FROM fx_tw_pred WHERE label <> prediction AND ratio >= 0 AND ratio < 1 GROUP BY 1""")
def k12(t):
    return evaluate.mismatch_bins(predicted(t))


for _name, _measure in (("old", "ratio"), ("new", "masked")):
    view(f"fx_tw_cut_{_name}", f"""
WITH v AS (SELECT q, {_measure} AS v, count(*) AS n, sum(truth) AS t FROM {{fx_cell}} WHERE NOT isnan({_measure}) GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER w AS bn, sum(t) OVER w AS bt, sum(t) OVER (PARTITION BY q) AS tt, sum(n) OVER (PARTITION BY q) AS nn, lead(v) OVER (PARTITION BY q ORDER BY v) AS nx, min(v) OVER (PARTITION BY q) AS lo FROM v WINDOW w AS (PARTITION BY q ORDER BY v)),
c AS (SELECT q, nn, bn - bt + tt - bt AS r, v AS cut, (v + coalesce(nx, v + 1e-6)) / 2 AS thr, 1 AS o FROM p UNION ALL SELECT DISTINCT q, nn, tt, NULL, (lo - 1e-6 + lo) / 2, 0 FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r DESC, o, cut) AS rn FROM c)
SELECT q, CAST(nn AS BIGINT) AS n, CAST(r AS BIGINT) AS n_right, thr AS threshold FROM b WHERE rn = 1""")


@query("k13_oracle_accuracy", "SELECT q, n, n_right FROM fx_tw_cut_new")
def k13(t):
    return evaluate.oracle_cuts(t.fx_cell, "masked").select("q", "n", "n_right")


@query("k14_oracle_threshold", "SELECT q, round(threshold, 9) AS threshold FROM fx_tw_cut_old")
def k14(t):
    return evaluate.oracle_cuts(t.fx_cell, "ratio").select("q", F.round("threshold", 9).alias("threshold"))


@query("k15_letter_bias", """
WITH l AS (SELECT 'ratio' AS measure, ch, ratio AS v FROM fx_cell WHERE truth = 0 UNION ALL SELECT 'masked', ch, masked FROM fx_cell WHERE truth = 0 AND NOT isnan(masked)),
m AS (SELECT measure, ch, avg(v) AS m, sum(v) AS s, count(*) AS n FROM l GROUP BY 1, 2) SELECT measure, round(sum(s) / sum(n), 6) AS mean, round(stddev_pop(m), 6) AS letter_sigma FROM m GROUP BY 1""")
def k15(t):
    return _rounded(evaluate.letter_bias(t.fx_cell, ["ratio", "masked"]))


def _against(t, measure):
    return evaluate.against_cut(t.fx_cell, measure, evaluate.oracle_cuts(t.fx_cell, measure))


for _name, _measure in (("old", "ratio"), ("new", "masked")):
    view(f"fx_tw_dec_{_name}", f"""
SELECT c.copy_key, c.q, c.ch, c.truth AS label, CASE WHEN c.{_measure} > o.threshold THEN 1 ELSE 0 END AS prediction, abs(c.{_measure} - o.threshold) AS distance FROM {{fx_cell}} c JOIN {{fx_tw_cut_{_name}}} o ON o.q = c.q WHERE NOT isnan(c.{_measure})""")


@query("k16_flag_bands", """
SELECT b.band, count(*) FILTER (label <> prediction AND distance < b.band) AS n_caught, count(*) FILTER (distance < b.band) AS n_flagged, count(*) FILTER (label <> prediction) AS n_errors, count(*) AS n
FROM fx_tw_dec_new, (VALUES (0.04::DOUBLE), (0.06::DOUBLE), (0.08::DOUBLE), (0.1::DOUBLE)) b(band) GROUP BY 1""")
def k16(t):
    return evaluate.flag_bands(_against(t, "masked"))


_WRONG = """
WITH e AS (SELECT 'masked' AS measure, * FROM (SELECT copy_key, q, ch, label, prediction FROM fx_tw_dec_new) UNION ALL SELECT 'ratio', * FROM (SELECT copy_key, q, ch, label, prediction FROM fx_tw_dec_old)),
w AS (SELECT *, CASE WHEN prediction = 1 THEN 'FP' ELSE 'FN' END AS kind FROM e WHERE label <> prediction)"""


def _natures(t):
    return evaluate.error_nature({measure: _against(t, measure) for measure in ("masked", "ratio")})


@query("k17_error_nature", f"{_WRONG.strip()} SELECT measure, kind, count(*) AS n FROM w GROUP BY 1, 2")
def k17(t):
    return _natures(t)["counts"]


@query("k17_error_examples", f"""{_WRONG.strip()}
SELECT measure, kind, CAST(rank AS INT) AS rank, q, ch, copy_key FROM (SELECT *, row_number() OVER (PARTITION BY measure, kind ORDER BY q, ch, copy_key) AS rank FROM w) WHERE rank <= 12""")
def k17_examples(t):
    return _natures(t)["examples"]


@query("k18_flag_strategies", """
WITH j AS (SELECT n.*, o.prediction AS old, sum(n.prediction) OVER (PARTITION BY n.copy_key, n.q) AS k, q.qtype FROM fx_tw_dec_new n JOIN fx_tw_dec_old o ON o.copy_key = n.copy_key AND o.q = n.q AND o.ch = n.ch LEFT JOIN fx_question q ON q.q = n.q),
f AS (SELECT *, label <> prediction AS err, coalesce(qtype = 'single' AND k <> 1, false) AS s, old <> prediction AS d, distance < 0.08::DOUBLE AS p FROM j)
SELECT 'structure' AS strategy, count(*) FILTER (s AND err) AS n_covered, count(*) FILTER (s) AS n_flagged, count(*) FILTER (err) AS n_errors, count(*) AS n FROM f
UNION ALL SELECT 'disagreement', count(*) FILTER (d AND err), count(*) FILTER (d), count(*) FILTER (err), count(*) FROM f
UNION ALL SELECT 'proximity', count(*) FILTER (p AND err), count(*) FILTER (p), count(*) FILTER (err), count(*) FROM f
UNION ALL SELECT 'union', count(*) FILTER ((s OR d OR p) AND err), count(*) FILTER (s OR d OR p), count(*) FILTER (err), count(*) FROM f""")
def k18(t):
    return evaluate.flag_strategies(_against(t, "masked"), _against(t, "ratio"), t.fx_question)


view("fx_snap_ref", """
SELECT o_orderkey AS page_id, o_orderstatus AS student_id, o_custkey % 5 AS copy_id, CASE WHEN o_custkey % 3 = 0 THEN 'printed' END AS copy_id_source, o_orderpriority AS notes FROM {orders} WHERE o_totalprice > 30000""")
view("fx_snap_new", """
SELECT o_orderkey AS page_id, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS student_id, o_custkey % 5 AS copy_id, CASE WHEN o_custkey % 3 = 0 AND o_totalprice < 450000 THEN 'printed' END AS copy_id_source, o_orderpriority AS notes
FROM {orders} WHERE o_totalprice < 480000""")
view("fx_tw_snap", """
WITH f AS (SELECT page_id, r.page_id IS NULL AS nr, n.page_id IS NULL AS nn, r.student_id AS s1, n.student_id AS s2, r.copy_id_source AS c1, n.copy_id_source AS c2 FROM {fx_snap_ref} r FULL JOIN {fx_snap_new} n USING (page_id))
SELECT page_id, CASE WHEN nn THEN 'only_ref' ELSE 'only_new' END AS field, CAST(NULL AS VARCHAR) AS ref_value, CAST(NULL AS VARCHAR) AS new_value FROM f WHERE nr OR nn
UNION ALL SELECT page_id, 'student_id', s1, s2 FROM f WHERE NOT nr AND NOT nn AND s1 IS DISTINCT FROM s2
UNION ALL SELECT page_id, 'copy_id_source', c1, c2 FROM f WHERE NOT nr AND NOT nn AND c1 IS DISTINCT FROM c2""")


def _snapshot(t):
    return evaluate.snapshot_fields(t.fx_snap_ref, t.fx_snap_new, ["student_id", "copy_id", "copy_id_source", "notes"])


@query("k19_snapshot_fields", "SELECT * FROM fx_tw_snap")
def k19(t):
    return _snapshot(t)


@query("k19_snapshot_summary", """
SELECT field, count(*) AS n_pages, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (rn <= 8) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY page_id) AS rn FROM fx_tw_snap) GROUP BY 1""")
def k19_summary(t):
    return evaluate.snapshot_summary(_snapshot(t))


@query("k19_answer_changes", """
SELECT copy_key, q, ch, CASE WHEN cv THEN 'removed' ELSE 'added' END AS change FROM fx_tw_diff""")
def k19_answers(t):
    return evaluate.cell_changes(t.fx_response, t.fx_reading2, ["copy_key", "q", "ch"])


view("fx_cell2", "SELECT copy_key, q, ch, CASE WHEN copy_key % 6 = 0 THEN ratio + 0.125 ELSE ratio END AS ratio, CASE WHEN copy_key % 8 = 0 THEN CAST('NaN' AS DOUBLE) ELSE masked END AS masked, proba FROM {fx_cell}")


@query("k19_confidence_changes", "SELECT copy_key, round(CASE WHEN copy_key % 6 = 0 THEN 0.125 ELSE 0 END, 6)::DOUBLE AS max_change FROM fx_cell GROUP BY 1")
def k19_confidence(t):
    return _rounded(evaluate.confidence_changes(t.fx_cell, t.fx_cell2, ["copy_key", "q", "ch"], "ratio"))


@query("k20_feature_diff", """
SELECT 'ratio' AS feature, round(max(CASE WHEN copy_key % 6 = 0 THEN 0.125::DOUBLE ELSE 0 END), 6) AS max_change, false AS endless, count(*) FILTER (copy_key % 6 = 0) AS n_changed, count(*) AS n_cells FROM fx_cell
UNION ALL SELECT 'masked', NULL, true, count(*) FILTER (copy_key % 8 = 0 AND NOT isnan(masked)), count(*) FROM fx_cell UNION ALL SELECT 'proba', 0, false, 0, count(*) FROM fx_cell""")
def k20(t):
    out = evaluate.feature_diff(t.fx_cell, t.fx_cell2, ["ratio", "masked", "proba"])
    endless = F.col("max_change") == float("inf")
    return out.select("feature", F.when(~endless, F.round("max_change", 6)).alias("max_change"), endless.alias("endless"), "n_changed", "n_cells")


@query("k21_timing_compare", """
WITH r AS (SELECT event_type AS stage, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events WHERE ts < (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY 1),
n AS (SELECT event_type AS stage, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events) AND event_type <> 'view' GROUP BY 1)
SELECT stage, round(r.m, 6) AS ref_mean, r.lo AS ref_min, r.hi AS ref_max, round(n.m, 6) AS new_mean, n.lo AS new_min, n.hi AS new_max, round(100 * (n.m / r.m - 1), 6) AS change_pct FROM r FULL JOIN n USING (stage)""")
def k21(t):
    start = t.events.agg(F.min("ts") + F.expr("INTERVAL 10 DAYS")).scalar()
    timed = t.events.select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), (F.col("ts") < start).alias("is_ref"))
    out = evaluate.timing_compare(timed.filter("is_ref"), timed.filter("NOT is_ref AND stage <> 'view'"))
    return _rounded(out)


@query("k22_permutation_importance")
def k22(t):
    split = evaluate.split_by_copy(_training(t))
    fitted = model.train(split.filter("NOT is_test"), FEATURES)
    return model.permutation_importance(fitted, split.filter("is_test"), FEATURES)
