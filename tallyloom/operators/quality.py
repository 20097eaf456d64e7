"""Data-quality reports: layout, roster, versions and imported reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import roster


def layout_consistency(layout: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions without boxes, unequal numbers of boxes and answers, boxes without a question.

    ``layout(copy, q, n_boxes)``, ``questions(copy, q, n_answers)``.
    """
    both = layout.join(questions, ["copy", "q"], "full")
    issue = F.when(F.col("n_boxes").isNull(), "missing_in_layout").when(F.col("n_answers").isNull(), "surplus_in_layout") \
        .when(F.col("n_boxes") != F.col("n_answers"), "box_count")
    return both.select("copy", "q", issue.alias("issue"), "n_boxes", "n_answers").filter("issue IS NOT NULL")


def roster_check(students: DataFrame, id_width: int, load_error: str = "") -> DataFrame:
    """Level and findings of a student list: FAIL when it cannot be used, WARN when links are ambiguous."""
    size = students.agg(F.count("*").alias("n"))
    error = F.lit(load_error)
    head = size.select(
        F.when(error != "", "FAIL").when(F.col("n") == 0, "WARN").otherwise("OK").alias("level"),
        F.when(error != "", "load_error").when(F.col("n") == 0, "empty").otherwise("students").alias("finding"), F.col("n"))
    notes = roster.warnings(students, id_width).select(F.lit("WARN").alias("level"), F.col("warning").alias("finding"), "n")
    return head.unionByName(notes)


def answer_sheets(boxes: DataFrame) -> DataFrame:
    """Pages that carry answer boxes, per copy, and whether one sheet holds them all."""
    per = boxes.groupBy("copy", "page").agg(F.count("*").alias("n_boxes"))
    return per.groupBy("copy").agg(
        F.count("*").alias("n_pages"), F.sum("n_boxes").alias("n_boxes"), F.min("page").alias("first_page"),
        F.when(F.count("*") == 1, "OK").otherwise("WARN").alias("level"))


def version_check(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """Versions of each subject with their copies and maximum; more than one deserves a look.

    ``ranges(subject, vid, first_copy, last_copy)``, ``totals(vid, total_max)``.
    """
    sizes = ranges.groupBy("subject").agg(F.count("*").alias("n_versions"))
    return ranges.join(totals, "vid", "left").join(sizes, "subject").select(
        "subject", "vid", "first_copy", "last_copy", "total_max", F.when(F.col("n_versions") > 1, "WARN").otherwise("OK").alias("level"))


def printed_code(bits: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Is the printed page code described by the layout?"""
    n_ids = page_ids.agg(F.count("*"))
    return bits.agg(F.count("*").alias("n_bits")).withColumn("n_page_ids", n_ids.scalar()).withColumn(
        "level", F.when((F.col("n_bits") > 0) & (F.col("n_page_ids") > 0), "OK").otherwise("WARN"))


def validate_reviewed(rows: DataFrame, options: DataFrame) -> dict[str, DataFrame]:
    """Reviewed answers before import: letters outside the options are dropped with a warning.

    ``rows(copy_key, student_id, q, letters)`` with ``letters`` an array; a number must be four digits or ``?``.
    """
    allowed = options.groupBy("q").agg(F.collect_set("ch").alias("_ok"))
    joined = rows.join(allowed, "q")
    upper = F.transform("letters", lambda x: F.upper(F.trim(x)))
    cleaned = joined.select("copy_key", "student_id", "q", F.array_intersect(upper, "_ok").alias("letters"), F.array_except(upper, "_ok").alias("_bad"))
    letters = cleaned.select("copy_key", "q", F.explode("_bad").alias("detail")).withColumn("warning", F.lit("letter outside the options"))
    numbers = rows.select("copy_key", "student_id").distinct().filter((F.col("student_id") != "") & ~F.col("student_id").rlike("^[0-9?]{4}$"))
    numbers = numbers.select("copy_key", F.lit(None).cast("int").alias("q"), F.col("student_id").alias("detail"), F.lit("malformed number").alias("warning"))
    return {"answers": cleaned.drop("_bad"), "warnings": letters.unionByName(numbers)}
