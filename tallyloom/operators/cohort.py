"""Several exams together: identity folding, column settings, the joint table and its summary.

Member rows are ``(path, exam_ord, ord, id, name, email, raw, absent)``: one per student of
each exam, in the order of the exams and of their lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import rescale
from tallyloom.functions.text import norm_name
from tallyloom.operators.marks import weighted_mean
from tallyloom.operators.stats import series_stats
from tallyloom.session import durable

UNKNOWN = ("", "?")


def read_members(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Every listed exam with its state; an unreadable one is carried with its error.

    ``registry(path, label)``, ``status(path, project, error, total_max)`` for the exams read.
    """
    joined = registry.join(status, "path", "left")
    ok = F.col("project").isNotNull() & (F.coalesce("error", F.lit("")) == "")
    return joined.select(
        "path", F.coalesce(F.nullif("label", F.lit("")), F.when(ok, F.col("project")), "path").alias("label"), ok.alias("ok"),
        F.when(ok, "").otherwise(F.coalesce(F.nullif("error", F.lit("")), F.lit("not readable"))).alias("error"),
        F.when(ok, F.coalesce("total_max", F.lit(0.0))).otherwise(0.0).alias("total_max"))


def exam_columns(members: DataFrame, settings: DataFrame) -> DataFrame:
    """Exam columns: an unset or zero norm or maximum is the exam's own total, else 1."""
    joined = members.join(settings, "path", "left")

    def filled(name):
        return F.coalesce(F.nullif(name, F.lit(0.0)), F.nullif("total_max", F.lit(0.0)), F.lit(1.0))

    return joined.select(
        F.concat(F.lit("exam::"), F.col("path")).alias("key"), "path", "label", filled("norm").alias("norm"), filled("max").alias("max"),
        F.nullif("norm", F.lit(0.0)).isNull().alias("auto_norm"), F.nullif("max", F.lit(0.0)).isNull().alias("auto_max"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"), "ok", "error")


def scale_warnings(columns: DataFrame) -> DataFrame:
    """Columns of unequal scales make a mean without a scale; unreadable columns are named."""
    live = columns.filter("ok").agg(
        F.count_distinct(F.round("max", 6)).alias("n"), F.min("max").alias("lo"), F.max("max").alias("hi"))
    mixed = live.filter("n > 1").select(
        F.lit("").alias("path"), F.lit("mixed_scales").alias("warning"),
        F.concat_ws(" ", F.col("n").cast("string"), F.lit("scales")).alias("detail"))
    broken = columns.filter(~F.col("ok")).select(
        "path", F.lit("unreadable").alias("warning"),
        F.concat_ws(" : ", "label", F.coalesce(F.nullif("error", F.lit("")), F.lit("illisible"))).alias("detail"))
    return mixed.unionByName(broken)


def people(members: DataFrame) -> DataFrame:
    """One row per identifier: first known name and address, place of first appearance."""
    place = F.struct("exam_ord", "ord")
    known = ~F.col("name").isin(*UNKNOWN)
    linked = members.filter("id <> ''")
    return linked.groupBy("id").agg(
        F.coalesce(F.min_by(F.when(known, F.col("name")), F.when(known, place)), F.min_by("name", place)).alias("name"),
        F.coalesce(F.min_by("email", F.when(F.col("email") != "", place)), F.lit("")).alias("email"),
        F.min(place).alias("place"))


def identity_map(persons: DataFrame) -> dict[str, DataFrame]:
    """``map(id, canonical)`` and ``refused(id, reason, n_longer)``.

    A short number is the longer one it ends, if it is the only such number and the names agree
    or one is unknown. Every number is filed under its proper endings, so this is an equality
    join; following pointers further is never needed, since a number whose target had a longer
    one would itself have two.
    """
    numeric = persons.filter(F.col("id").rlike("^[0-9]+$")).select("id", norm_name("name").alias("norm"))
    endings = numeric.filter(F.length("id") > 1).select(
        F.col("id").alias("long"), F.col("norm").alias("long_norm"),
        F.explode(F.sequence(F.lit(1), F.length("id") - 1)).alias("n")) \
        .select("long", "long_norm", F.right("long", F.col("n")).alias("id"))
    # endings are reduced before they meet the numbers: at most one row per ending
    reduced = endings.groupBy("id").agg(F.count("*").alias("n_longer"), F.min("long").alias("long"), F.min("long_norm").alias("long_norm"))
    pairs = numeric.join(reduced, "id")
    agree = (F.col("norm") == "") | (F.col("long_norm") == "") | (F.col("norm") == F.col("long_norm"))
    judged = pairs.withColumn("reason", F.when(F.col("n_longer") > 1, "ambiguous").when(~agree, "names_differ"))
    folded = judged.filter("reason IS NULL").select("id", F.col("long").alias("canonical"))
    mapping = persons.select("id").join(folded, "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))
    return {"map": mapping, "refused": judged.filter("reason IS NOT NULL").select("id", "reason", "n_longer")}


def file_members(series: DataFrame, exam_ord: int = 1_000_000) -> DataFrame:
    """Imported series as member rows: a student met only there is named by the identifier."""
    return series.select(
        F.concat_ws("::", "path", F.col("idx").cast("string")).alias("path"), F.lit(exam_ord).cast("bigint").alias("exam_ord"),
        F.lit(0).cast("bigint").alias("ord"), F.col("student_id").alias("id"), F.col("student_id").alias("name"),
        F.lit("").alias("email"), F.col("value").alias("raw"), F.lit(False).alias("absent"))


def folded_people(members: DataFrame) -> DataFrame:
    """``(id, name, email, place, canonical)``: one row per identifier, written once since every step needs it."""
    persons = durable(people(members))
    return durable(persons.join(identity_map(persons)["map"], "id"))


def cohort_marks(members: DataFrame, columns: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """``(id, key, raw, weight, mark)`` after folding: the last value of a student in a column wins."""
    canon = (folded_people(members) if folded is None else folded).select("id", "place", "canonical")
    rows = members.filter("id <> '' AND NOT absent AND raw IS NOT NULL").join(canon, "id").join(columns, "path")
    last = rows.groupBy(F.col("canonical").alias("id"), "key").agg(
        F.max_by("raw", F.struct("place", "exam_ord", "ord")).alias("raw"),
        F.first("norm").alias("norm"), F.first("max").alias("max"), F.first("weight").alias("weight"))
    return last.select("id", "key", "raw", "weight", rescale("raw", "norm", "max").alias("mark"))


def build_table(members: DataFrame, columns: DataFrame, threshold: float, folded: DataFrame | None = None) -> DataFrame:
    """One row per student: folded identity, marks per column (map), count, final and absences."""
    folded = folded_people(members) if folded is None else folded
    canon = folded.select("id", "canonical")
    known = ~F.col("name").isin(*UNKNOWN)
    merged = folded.groupBy(F.col("canonical").alias("id")).agg(
        F.coalesce(F.min_by(F.when(known, F.col("name")), F.when(known, F.col("place"))), F.min_by("name", "place")).alias("name"),
        F.coalesce(F.min_by("email", F.when(F.col("email") != "", F.col("place"))), F.lit("")).alias("email"),
        F.count("*").alias("n_ids"))
    gone = members.filter("id <> '' AND absent").join(canon, "id").join(columns.select("path", "label"), "path") \
        .groupBy(F.col("canonical").alias("id")).agg(F.array_sort(F.collect_set("label")).alias("absent_in"))
    per = cohort_marks(members, columns, folded).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.bround("mark", 3)))).alias("notes"),
        F.map_from_entries(F.collect_list(F.struct("key", F.bround("raw", 2)))).alias("raws"),
        F.count("*").alias("n_columns"), F.bround(weighted_mean(threshold), 2).alias("final"))
    table = merged.join(per, "id", "left").join(gone, "id", "left")
    return table.select("id", "name", "email", "n_ids", "notes", "raws", F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
                        "final", F.coalesce("absent_in", F.array().cast("array<string>")).alias("absent_in"))


def unlinked(members: DataFrame) -> DataFrame:
    """Copies without a number: counted apart, never merged into anybody."""
    return members.agg(F.count_if((F.col("id") == "") & ~F.col("absent")).alias("n_unlinked"))


def shown_table(members: DataFrame, columns: DataFrame, threshold: float) -> DataFrame:
    """``build_table`` as it is shown: by name, with ``also_id`` (folded identifiers, first met first) and, last, one row
    for the unlinked copies, if there are any, that carries their number in ``unlinked``."""
    folded = folded_people(members)
    # a number has at most as many folded endings as digits
    also = folded.filter("id <> canonical").groupBy(F.col("canonical").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("also_id"))
    none = F.array().cast("array<string>")
    table = build_table(members, columns, threshold, folded).join(also, "id", "left").select(
        "id", "name", "email", F.coalesce("also_id", none).alias("also_id"), "notes", "raws", "n_columns", "final", "absent_in",
        F.lit(None).cast("bigint").alias("unlinked"))
    # Fixed value: the name shown for copies without a student.
    label = F.concat(F.lit("("), F.col("n_unlinked").cast("string"), F.lit(" copie(s) non reliée(s))"))
    marks = F.create_map().cast("map<string,double>")
    loose = unlinked(members).filter("n_unlinked > 0").select(
        F.lit("").alias("id"), label.alias("name"), F.lit("").alias("email"), none.alias("also_id"), marks.alias("notes"), marks.alias("raws"),
        F.lit(0).cast("bigint").alias("n_columns"), F.lit(None).cast("double").alias("final"), none.alias("absent_in"),
        F.col("n_unlinked").alias("unlinked"))
    return table.unionByName(loose).orderBy(F.col("unlinked").isNotNull(), "name", "id")


def cohort_roster(members: DataFrame) -> DataFrame:
    """First appearance of each identifier, its name split at the first blank."""
    first = members.filter("id <> ''").groupBy("id").agg(
        F.min_by(F.struct("name", "email"), F.struct("exam_ord", "ord")).alias("f"))
    parts = F.split("f.name", " ", 2)
    return first.select("id", F.get(parts, F.lit(0)).alias("nom"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("prenom"),
                        F.col("f.email").alias("email"))


def cohort_export(table: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Wide rows for the file: ``ABS`` if expected and absent, blank if not concerned."""
    def cell(values, key, label):
        missing = F.when(F.array_contains("absent_in", label), "ABS").otherwise("")
        return F.coalesce(F.element_at(values, F.lit(key)).cast("string"), missing)

    wide = []
    for key, label in columns:
        wide += [cell("raws", key, label).alias(f"{label}_brut"), cell("notes", key, label).alias(label)]
    return table.select(
        F.col("id").alias("id_canonique"), F.col("name").alias("nom_prenom"), F.col("email").alias("courriel"), *wide,
        F.coalesce(F.col("final").cast("string"), F.lit("")).alias("note_finale"), F.array_join("absent_in", ";").alias("absent_de"))


def cohort_summary(table: DataFrame, n_columns: int, n_unlinked: DataFrame) -> DataFrame:
    table = durable(table.select("n_columns", "final"))
    stats = series_stats(table, [], "final")
    counts = table.agg(
        F.count("*").alias("n_students"), F.count_if(F.col("n_columns") == n_columns).alias("n_complete"),
        F.count_if((F.col("n_columns") > 0) & (F.col("n_columns") < n_columns)).alias("n_partial"))
    counts = counts.withColumn("n_unlinked", n_unlinked.scalar())
    packed = stats.select(F.struct(*stats.columns).alias("s"))
    return counts.withColumn("s", packed.scalar()).select("n_students", "n_complete", "n_partial", "n_unlinked", "s.*")


def calibration_series(marks: DataFrame) -> DataFrame:
    """Column marks (already capped) in long form, ready for the histogram."""
    return marks.select("id", "key", F.bround("mark", 3).alias("mark"))


def candidates(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Exams present but not listed."""
    return found.join(listed.select("path"), "path", "left_anti")
