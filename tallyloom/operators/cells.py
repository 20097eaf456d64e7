"""Decisions from cell measurements: thresholds, flags, digits, printed codes, sheets.

A (copy, question) group holds one row per printed option, a copy one row per printed cell:
both are bounded by the layout, so they may be gathered into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import bits_to_int

# Limits of the reading rules.
MIN_GAP, ABS_DEFAULT, ABS_FLOOR, LIGHT_STEP = 0.10, 0.50, 0.18, 0.10
EMPTY_BASELINE, MIN_STD = 0.20, 0.01
MASKED_INK, UNSURE_LOW, UNSURE_HIGH = 0.12, 0.30, 0.70
DIGIT_MIN, DIGIT_GAP, CODE_GAP = 0.15, 0.05, 0.15
FRAME_FAIL_SHARE = 0.7
DARK_SHARE, DARK_LEVEL, LIGHT_RANGE, MIN_DARK = 0.60, 128, (120, 200), 5


def _descending(values: Column) -> Column:
    return F.sort_array(values, asc=False)


def largest_gap(values: Column) -> Column:
    """``struct(gap, rank, middle)`` of the widest step between sorted values; the first one wins."""
    ordered = _descending(values)
    steps = F.transform(
        F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda v, i: F.struct((v - F.get(ordered, i + 1)).alias("gap"), (-i).alias("rank"), ((v + F.get(ordered, i + 1)) / 2).alias("middle")))
    return F.array_max(F.filter(steps, lambda s: s["gap"] > 0))


def adaptive_threshold(values: Column, baseline: Column | None = None) -> Column:
    """Middle of the widest gap when it is wide and high enough, else a fixed level (lower on a light copy)."""
    gap = largest_gap(values)
    fallback = F.lit(ABS_DEFAULT)
    if baseline is not None:
        fallback = F.when(baseline.isNotNull(), F.greatest(F.lit(ABS_FLOOR), baseline + LIGHT_STEP)).otherwise(fallback)
    wide = (gap["gap"] >= MIN_GAP) & (gap["middle"] >= ABS_FLOOR)
    return F.when(F.size(values) == 0, ABS_DEFAULT).when(F.coalesce(wide, F.lit(False)), gap["middle"]).otherwise(fallback)


def question_measures(cells: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Median, mean, population deviation and threshold of each question of each copy."""
    per = cells.groupBy("copy_key", "q").agg(
        F.sort_array(F.collect_list("ratio")).alias("_r"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"))
    n = F.size("_r")
    median = (F.get("_r", F.floor((n - 1) / 2).cast("int")) + F.get("_r", F.floor(n / 2).cast("int"))) / 2
    baseline = None
    if baselines is not None:
        per = per.join(baselines, "copy_key", "left")
        baseline = F.col("baseline")
    return per.select("copy_key", "q", median.alias("median"), "mean", "std", adaptive_threshold(F.col("_r"), baseline).alias("threshold"))


def copy_baseline(cells: DataFrame) -> DataFrame:
    """Upper median of all the ratios of a copy."""
    per = cells.groupBy("copy_key").agg(F.sort_array(F.collect_list("ratio")).alias("_r"))
    upper = F.get("_r", F.floor(F.size("_r") / 2).cast("int"))
    return per.select("copy_key", F.coalesce(upper, F.lit(EMPTY_BASELINE)).alias("baseline"))


def context_features(cells: DataFrame) -> DataFrame:
    """Ratio of each cell against its question and its copy."""
    joined = cells.join(question_measures(cells), ["copy_key", "q"]).join(copy_baseline(cells), "copy_key")
    r = F.col("ratio")
    return joined.select(
        *cells.columns, (r - F.col("median")).alias("ratio_minus_q_median"),
        ((r - F.col("mean")) / F.greatest("std", F.lit(MIN_STD))).alias("ratio_z_in_q"),
        (r - F.col("baseline")).alias("ratio_minus_copy_baseline"), F.col("threshold").alias("question_threshold"),
        (r - F.col("threshold")).alias("ratio_above_threshold"))


def intensity_features(crops: DataFrame, pixels: str, width: int) -> DataFrame:
    """Features of grey-level crops stored as arrays, row by row: shares, level, spread and place of the ink."""
    p = F.col(pixels)
    n = F.size(p)

    def share(test):
        return F.size(F.filter(p, test)) / n

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    place = (n - 1) * 0.85
    ordered = F.sort_array(p)
    low = F.get(ordered, F.floor(place).cast("int"))
    high = F.get(ordered, F.ceil(place).cast("int"))
    paper = F.greatest(low + (high - low) * (place - F.floor(place)), F.lit(1.0))
    mean = total(p) / n
    spread = F.sqrt(total(F.transform(p, lambda x: (x - F.col("mean_intensity")) * (x - F.col("mean_intensity")))) / n)
    step = crops.select("*", paper.alias("paper_level"), mean.alias("mean_intensity"))
    dark = F.transform(p, lambda x, i: F.when(x <= DARK_LEVEL, i))
    step = step.select(
        "*", spread.alias("std_intensity"), share(lambda x: x <= DARK_LEVEL).alias("fill_ratio"),
        share(lambda x: x < DARK_SHARE * F.col("paper_level")).alias("dark_ratio"),
        share(lambda x: x.between(*LIGHT_RANGE)).alias("light_gray_ratio"), F.array_compact(dark).alias("_dark"), (n / width).alias("_h"))
    xs = F.transform("_dark", lambda i: (i % width).cast("double"))
    ys = F.transform("_dark", lambda i: F.floor(i / width).cast("double"))
    step = step.select("*", xs.alias("_x"), ys.alias("_y"), F.size("_dark").alias("_k"))
    step = step.select("*", (total(F.col("_x")) / F.nullif("_k", F.lit(0))).alias("_mx"), (total(F.col("_y")) / F.nullif("_k", F.lit(0))).alias("_my"))

    enough = F.col("_k") > MIN_DARK  # a few specks have no meaningful place

    def deviation(values, mean_name, side):
        squares = F.transform(values, lambda v: (v - F.col(mean_name)) * (v - F.col(mean_name)))
        return F.when(enough, F.sqrt(total(squares) / F.col("_k")) / side).otherwise(0.0)

    return step.select(
        *[c for c in crops.columns if c != pixels], "paper_level", "mean_intensity", "std_intensity", "fill_ratio", "dark_ratio", "light_gray_ratio",
        F.when(enough, F.col("_mx") / width - 0.5).otherwise(0.0).alias("centroid_dx"),
        F.when(enough, F.col("_my") / F.col("_h") - 0.5).otherwise(0.0).alias("centroid_dy"),
        deviation(F.col("_x"), "_mx", F.lit(width)).alias("dark_std_x"), deviation(F.col("_y"), "_my", F.col("_h")).alias("dark_std_y"))


# ------------------------------------------------------------ decisions and flags


def decide_cell(proba: str, e2: str, masked: str) -> tuple[Column, Column, Column]:
    """``(ticked, published, no_masked)``: the model decides, unless it is missing or its masked measure is.

    Without the masked measure the model's probability means nothing, and none is published.
    """
    p, threshold, lost = F.col(proba), F.col(e2), F.isnan(masked)
    model = p >= 0.5
    ticked = F.when(p.isNull() | lost, threshold).otherwise(model)
    return ticked, F.when(~lost, p), F.when(p.isNotNull() & lost, model != threshold).otherwise(F.lit(False))


def flag_reasons(cells: DataFrame) -> DataFrame:
    """Adds the three verdicts, the published probability and the reasons to look at a cell.

    Needs ``proba``, ``masked`` (NaN when missing), ``ratio`` and ``threshold``.
    """
    base = cells.withColumn("e2", F.col("ratio") > F.col("threshold"))
    ticked, published, no_masked = decide_cell("proba", "e2", "masked")
    e1 = F.when(~F.isnan("masked"), F.col("masked") > MASKED_INK)
    base = base.select("*", e1.alias("e1"), ticked.alias("ticked"), published.alias("published"), no_masked.alias("_nm"))
    verdicts = F.array_distinct(F.array_compact(F.array("e1", "e2", "ticked")))
    reasons = F.array_compact(F.array(
        F.when(F.size(verdicts) > 1, "disagree"), F.when(F.col("published").between(UNSURE_LOW, UNSURE_HIGH), "uncertain"),
        F.when(F.col("_nm"), "no_masked")))
    return base.select(*cells.columns, "e1", "e2", "ticked", "published", reasons.alias("reasons"))


def assemble_answers(judged: DataFrame) -> DataFrame:
    """Per question: ticked letters in order and the number of cells the model overrode."""
    return judged.groupBy("copy_key", "q").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ticked"), F.col("ch")))), "").alias("letters"),
        F.count_if(F.col("ticked") != F.col("e2")).alias("n_overrides"), F.count_if(F.size("reasons") > 0).alias("n_ambiguous"))


def reading_notes(answers: DataFrame) -> DataFrame:
    """One short note per copy from its counters."""
    per = answers.groupBy("copy_key").agg(F.sum("n_overrides").alias("n_overrides"), F.sum("n_ambiguous").alias("n_ambiguous"))
    note = F.concat_ws("; ", F.concat(F.lit("ml=on(overrides="), F.col("n_overrides").cast("string"), F.lit(")")),
                       F.when(F.col("n_ambiguous") > 0, F.concat(F.lit("ambigu("), F.col("n_ambiguous").cast("string"), F.lit(")"))))
    return per.select("copy_key", note.alias("notes"))


# ------------------------------------------------------------ digits and printed codes


def _best_digit(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Darkest digit of a column, null when it is too pale or too close to the next."""
    top = F.slice(_descending(F.collect_list("ratio")), 1, 2)
    per = cells.groupBy(*keys).agg(F.max_by("ch", F.struct("ratio", -F.col("ch").cast("int"))).alias("_ch"), top.alias("_top"))
    first, second = F.get("_top", F.lit(0)), F.coalesce(F.get("_top", F.lit(1)), F.lit(0.0))
    clear = (first >= DIGIT_MIN) & (first - second >= DIGIT_GAP)
    return per.select(*keys, F.when(clear, F.col("_ch")).alias("digit"))


def decode_student_id(cells: DataFrame) -> DataFrame:
    """Number read on the digit columns, ``?`` where unclear: ``cells(copy_key, col, ch, ratio)``."""
    digits = _best_digit(cells, ["copy_key", "col"])
    return digits.groupBy("copy_key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col", F.coalesce("digit", F.lit("?")).alias("d")))), lambda s: s["d"]), "").alias("student_id"))


def decode_copy_grid(cells: DataFrame, n_columns: int | None = None) -> DataFrame:
    """Copy number, highest rank first; null if any column is unclear: ``cells(copy_key, rank, ch, ratio)``."""
    digits = _best_digit(cells, ["copy_key", "rank"])
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), F.col("digit").alias("d")))), lambda s: s["d"]), "")
    whole = F.min(F.col("digit").isNotNull())
    if n_columns is not None:
        whole = whole & (F.count("*") == n_columns)
    return digits.groupBy("copy_key").agg(F.when(whole, spelled.try_cast("bigint")).alias("copy_id"))


def decode_page_codes(bits: DataFrame, widths: dict[int, int]) -> DataFrame:
    """Three printed integers per page: ``bits(page_key, kind, rank, ratio)``, widths by kind.

    The threshold is the widest gap over all the bits of the page; 0.5 when none is clear.
    """
    limits = bits.groupBy("page_key").agg(F.collect_list("ratio").alias("_r"))
    gap = largest_gap(F.col("_r"))
    limits = limits.select("page_key", F.when(gap["gap"] >= CODE_GAP, gap["middle"]).otherwise(0.5).alias("_limit"))
    joined = bits.join(limits, "page_key")
    names = ("copy", "page", "checksum")
    codes = [F.when(F.count_if(F.col("kind") == kind) > 0,
                    bits_to_int(F.when(F.col("kind") == kind, F.col("ratio")), "rank", widths[kind], F.col("_limit"))).alias(name)
             for kind, name in zip((1, 2, 3), names)]
    return joined.groupBy("page_key").agg(*codes).filter(" AND ".join(f"{n} IS NOT NULL" for n in names))


def known_codes(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Only the triples of the layout are accepted."""
    return codes.join(known.select("copy", "page", "checksum").distinct(), ["copy", "page", "checksum"], "left_semi")


def unique_codes(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Over all offsets of a page, exactly one distinct known triple is accepted, several are none."""
    seen = known_codes(candidates, known)
    triple = F.struct("copy", "page", "checksum")
    best = seen.groupBy("page_key").agg(F.min(triple).alias("lo"), F.max(triple).alias("hi"))
    return best.filter("lo = hi").select("page_key", "lo.copy", "lo.page", "lo.checksum")


def question_offsets(offsets: DataFrame) -> DataFrame:
    """Upper median of both shifts over the cells of a question."""
    def upper(name):
        values = F.sort_array(F.collect_list(name))
        return F.get(values, F.floor(F.size(values) / 2).cast("int"))

    return offsets.groupBy("copy_key", "q").agg(upper("dx").alias("dx"), upper("dy").alias("dy"))


# ------------------------------------------------------------ sheets


def answer_sheet_flags(cells: DataFrame) -> DataFrame:
    """Frames lost and cells of each copy; an answer sheet loses fewer than seven in ten."""
    per = cells.groupBy("copy_key").agg(F.count_if(F.col("frame_detected") == 0).alias("n_frame_fail"), F.count("*").alias("n_cells"))
    return per.withColumn("is_answer_sheet", (F.col("n_cells") == 0) | (F.col("n_frame_fail") < FRAME_FAIL_SHARE * F.col("n_cells")))


def pick_sheets(scans: DataFrame, shares: DataFrame) -> DataFrame:
    """Answer sheet of each scan: its printed page, else the only sheet, else the best frame share.

    ``scans(copy_key, page_no)``, ``shares(copy_key, sheet, share)`` has one row per sheet of the subject.
    """
    best = shares.groupBy("copy_key").agg(
        F.max_by("sheet", F.struct("share", -F.col("sheet"))).alias("_best"), F.count("*").alias("_n"))
    printed = scans.join(shares.select("copy_key", F.col("sheet").alias("page_no"), F.lit(True).alias("_ok")), ["copy_key", "page_no"], "left")
    joined = printed.join(best, "copy_key", "left")
    source = F.when(F.col("_ok"), "printed").when(F.col("_n") == 1, "only").otherwise("frames")
    return joined.select("copy_key", F.when(F.col("_ok"), F.col("page_no")).otherwise(F.col("_best")).alias("sheet"), source.alias("source"))


def copy_numbers(scans: DataFrame, available: DataFrame) -> DataFrame:
    """Copy number and where it comes from: printed, then grid, then 1; unknown numbers fall back to 1.

    ``scans(copy_key, printed_id, grid_id)``, ``available(copy)``.
    """
    read = F.coalesce("printed_id", F.nullif("grid_id", F.lit(0)), F.lit(1))
    source = F.when(F.col("printed_id").isNotNull(), "printed").when(read != 1, "grid").otherwise("default")
    base = scans.select("copy_key", read.alias("_id"), source.alias("_src"))
    joined = base.join(available.select(F.col("copy").alias("_id")).distinct().withColumn("_ok", F.lit(True)), "_id", "left")
    kept = (F.col("_id") == 1) | F.coalesce("_ok", F.lit(False))
    return joined.select("copy_key", F.when(kept, F.col("_id")).otherwise(1).alias("copy_id"), F.when(kept, F.col("_src")).otherwise("default").alias("source"))
