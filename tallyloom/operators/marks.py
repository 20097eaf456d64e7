"""Rescaled marks, finals, distributions and the result rows of an exam."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import general_text, rescale
from tallyloom.operators.roster import full_name
from tallyloom.operators.stats import series_stats

ABSENT = "ABS"
MAX_BINS = 400


def grade_columns(exam: DataFrame, imported: DataFrame, settings: DataFrame) -> DataFrame:
    """Descriptors of the exam column then of the imported ones.

    ``exam(path, norm, max, weight, total_max)`` per exam; an unset or zero norm takes the
    subject total, else 20. ``imported(path, idx, name)``, ``settings(path, idx, norm, max, weight)``.
    """
    own = exam.select(
        "path", F.lit("qcm").alias("key"), F.lit("QCM").alias("label"), F.lit(0).alias("position"),
        F.coalesce(F.nullif("norm", F.lit(0.0)), F.nullif("total_max", F.lit(0.0)), F.lit(20.0)).alias("norm"),
        F.nullif("norm", F.lit(0.0)).isNull().alias("auto_norm"),
        F.coalesce("max", F.lit(20.0)).alias("max"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    rest = imported.join(settings, ["path", "idx"], "left").select(
        "path", F.concat_ws("::", "path", F.col("idx").cast("string")).alias("key"), F.col("name").alias("label"),
        (F.col("idx") + 1).cast("int").alias("position"), F.coalesce("norm", F.lit(20.0)).alias("norm"), F.lit(False).alias("auto_norm"),
        F.coalesce("max", F.lit(20.0)).alias("max"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return own.unionByName(rest)


def rescaled_marks(raws: DataFrame, columns: DataFrame) -> DataFrame:
    """Present column marks, capped: ``raws(id, key, raw)`` with ``columns(key, norm, max, weight)``."""
    joined = raws.filter("raw IS NOT NULL").join(columns.select("key", "norm", "max", "weight"), "key")
    return joined.select("id", "key", "weight", rescale("raw", "norm", "max").alias("mark"))


def weighted_mean(threshold: float) -> Column:
    """Aggregate: weighted mean of the present marks, capped; a column that is absent counts nowhere."""
    mean = F.try_divide(F.sum(F.col("weight") * F.col("mark")), F.sum("weight"))
    return F.least(F.coalesce(mean, F.lit(0.0)), F.lit(float(threshold)))


def finals(marks: DataFrame, threshold: float) -> DataFrame:
    return marks.groupBy("id").agg(F.count("*").alias("n_columns"), weighted_mean(threshold).alias("final"))


def histogram_frame(series: DataFrame, granularity: float) -> DataFrame:
    """One row: shared bounds, bin count and width of a set of series (``mark`` column)."""
    g = granularity if granularity and granularity > 0 else 1.0
    lo = F.floor(F.least(F.lit(0.0), F.coalesce(F.min("mark"), F.lit(0.0))) / g) * g
    hi = F.ceil(F.coalesce(F.max("mark"), F.lit(g)) / g) * g
    frame = series.agg(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    frame = frame.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + g).otherwise(F.col("hi")))
    bins = F.greatest(F.lit(1), F.least(F.lit(MAX_BINS), F.rint((F.col("hi") - F.col("lo")) / g).cast("int")))
    frame = frame.withColumn("nbins", bins)
    hi = F.col("lo") + F.col("nbins") * g
    return frame.select("lo", hi.alias("hi"), "nbins", ((hi - F.col("lo")) / F.col("nbins")).alias("width"))


def multi_histogram(series: DataFrame, granularity: float) -> DataFrame:
    """``(key, bin, lo, hi, n)`` for every series and every shared bin, empty bins included."""
    frame = histogram_frame(series, granularity).select(F.struct("lo", "hi", "nbins", "width").alias("f"))
    place = F.floor((F.col("mark") - F.col("f.lo")) / F.col("f.width")).cast("int")
    placed = series.withColumn("f", frame.scalar()).withColumn(
        "bin", F.least(F.col("f.nbins") - 1, F.greatest(F.lit(0), place)))
    counts = placed.groupBy("key", "bin").agg(F.count("*").alias("n"))
    grid = counts.select("key").distinct().withColumn("f", frame.scalar()).select(
        "key", "f", F.explode(F.sequence(F.lit(0), F.col("f.nbins") - 1)).alias("bin"))
    return grid.join(counts, ["key", "bin"], "left").select(
        "key", "bin", (F.col("f.lo") + F.col("bin") * F.col("f.width")).alias("lo"),
        (F.col("f.lo") + (F.col("bin") + 1) * F.col("f.width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def chart_guides(series: DataFrame, granularity: float, pass_mark: float) -> DataFrame:
    """Per series: quarter ticks of the shared frame, the mean and its clipped one-deviation band, the pass line."""
    frame = histogram_frame(series, granularity).select(F.struct("lo", "hi").alias("f"))
    stats = series_stats(series, ["key"], "mark").withColumn("f", frame.scalar())
    lo, hi = F.col("f.lo"), F.col("f.hi")
    ticks = [F.round(lo + (hi - lo) * q, 1).alias(f"tick{i}") for i, q in enumerate((0, 0.25, 0.5, 0.75, 1.0))]
    return stats.select(
        "key", *ticks, "mean", F.greatest(lo, F.col("mean") - F.col("std")).alias("band_lo"),
        F.least(hi, F.col("mean") + F.col("std")).alias("band_hi"),
        F.least(F.greatest(F.lit(float(pass_mark)), lo), hi).alias("pass_line"))


def scatter(marks: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One row per student: a mark per listed column, null where missing, and the final."""
    wide = marks.groupBy("id").pivot("key", keys).agg(F.bround(F.first("mark"), 3))
    final = finals(marks, threshold).select("id", F.bround("final", 3).alias("final"))
    return wide.join(final, "id")


def pass_counts(marks: DataFrame, pass_mark: float) -> DataFrame:
    return marks.groupBy("key").agg(F.count_if(F.col("mark") < pass_mark).alias("n_below"), F.count("*").alias("n"))


def settings_drift(exams: DataFrame) -> DataFrame:
    """Stored settings that would change a mark: ``exams(path, norm, max, threshold, total_max, n_imported)``."""
    total = F.coalesce("total_max", F.lit(0.0))
    norm = F.coalesce(F.nullif("norm", F.lit(0.0)), total)
    top, cap = F.coalesce("max", F.lit(20.0)), F.coalesce("threshold", F.lit(20.0))

    def row(test, code, detail):
        return F.when(test, F.struct(F.lit(code).alias("issue"), detail.alias("detail")))

    issues = F.array_compact(F.array(
        row((total > 0) & (F.abs(top - norm) > 1e-9), "rescaled",
            F.concat(general_text(top), F.lit(" from "), general_text(norm))),
        row((total > 0) & (cap < total - 1e-9), "capped", general_text(cap)),
        row(F.coalesce("n_imported", F.lit(0)) > 0, "imported_columns", F.col("n_imported").cast("string"))))
    return exams.select("path", F.explode(issues).alias("i")).select("path", "i.issue", "i.detail")


# ------------------------------------------------------------ result rows


def student_rows(copies: DataFrame, absent: DataFrame) -> DataFrame:
    """One row per copy and one per absent student, sorted by name; an absent has no mark, never 0.

    ``copies(batch, page, id, name, email, id_read, raw, mark, validated, flags)``.
    """
    missing = absent.select("id", full_name().alias("name"), "email", F.lit("").alias("batch"),
                            F.lit("").alias("id_read"), F.array(F.lit("absent")).alias("flags"), F.lit(True).alias("absent"))
    present = copies.withColumn("absent", F.lit(False))
    return present.unionByName(missing, allowMissingColumns=True).orderBy("name", "id", "page")


def exam_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_students"), F.count_if(~F.col("absent")).alias("n_copies"), F.count_if("absent").alias("n_absent"),
        F.count_if(F.coalesce("validated", F.lit(False))).alias("n_validated"),
        F.count_if(~F.col("absent") & (F.coalesce("id", F.lit("")) == "")).alias("n_unlinked"))


def mark_cell(value) -> Column:
    """A mark as written in a file: a missing one is ``ABS``, never blank nor zero."""
    return F.coalesce(F.col(value).cast("string"), F.lit(ABSENT))


def validated_cell() -> Column:
    return F.when(F.col("absent"), "").when(F.coalesce("validated", F.lit(False)), "oui").otherwise("non")


# Column titles that readers of the files rely on.
EXPORT_COLUMNS = ("batch", "page", "id_canonique", "nom_prenom", "courriel", "id_lu", "note_sur_32", "note_finale", "validee", "flags")
REPORT_COLUMNS = ("batch", "page", "id_canonique", "nom_prenom", "courriel", "QCM_brut_sur_32", "note_finale", "validee")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def export_rows(rows: DataFrame) -> DataFrame:
    """The ten-column download."""
    values = [_text("batch"), _text("page"), _text("id"), _text("name"), _text("email"), _text("id_read"),
              mark_cell("raw"), mark_cell("mark"), validated_cell(), F.array_join("flags", ";")]
    return rows.select(*[v.alias(n) for v, n in zip(values, EXPORT_COLUMNS)])


def report_rows(rows: DataFrame) -> DataFrame:
    """The eight-column report that notifications read."""
    values = [_text("batch"), _text("page"), _text("id"), _text("name"), _text("email"),
              mark_cell("raw"), mark_cell("mark"), validated_cell()]
    return rows.select(*[v.alias(n) for v, n in zip(values, REPORT_COLUMNS)])
