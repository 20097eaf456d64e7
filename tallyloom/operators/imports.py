"""Marks imported from header-less sheets: column detection, linking and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import coerce_float
from tallyloom.functions.text import cell_text, strip
from tallyloom.operators import identity, roster, similarity
from tallyloom.session import durable

NAME_MIN = 0.70
NAME_CONFIDENT = 0.90
COLUMN_DEFAULTS = {"norm": 20.0, "max": 20.0, "weight": 1.0}


def _cells(table: DataFrame) -> DataFrame:
    return table.select("path", "row_no", F.posexplode("cells").alias("col", "raw")).filter(F.coalesce("raw", F.lit("")) != "")


def resolve_ids(raws: DataFrame, students: DataFrame) -> DataFrame:
    """``(raw, student_id)`` of the distinct join cells in number mode: full number, else a unique ending."""
    reads = raws.select("raw").distinct().withColumn("read", cell_text("raw")).filter("read <> ''")
    full = students.select(F.col("id").alias("_full")).distinct()
    linked = identity.by_id(reads, students, "read").join(full, F.col("read") == F.col("_full"), "left")
    return linked.select("raw", F.coalesce("_full", "matched_id").alias("student_id")).filter("student_id IS NOT NULL")


def resolve_names(raws: DataFrame, index: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(path, raw, student_id)`` in name mode: an override wins, a null one ignores the row."""
    asked = raws.select("path", strip(F.col("raw")).alias("raw")).filter("raw <> ''").distinct()
    fixed = asked.join(overrides.select("path", "raw", F.col("id").alias("student_id")), ["path", "raw"])
    free = asked.join(overrides, ["path", "raw"], "left_anti")
    fuzzy = free.join(similarity.by_name(free, index, NAME_MIN).select("raw", F.col("id").alias("student_id")), "raw")
    return fixed.filter("student_id IS NOT NULL").unionByName(fuzzy.select("path", "raw", "student_id"))


def analyze_table(table: DataFrame, students: DataFrame) -> DataFrame:
    """Guessed structure of each sheet, one row per column.

    A number column holds full numbers or four-digit endings; names are tried only on columns
    with three values or more that are mostly not numbers.
    """
    cells = _cells(table).withColumn("read", cell_text("raw")).withColumn("number", coerce_float("raw"))
    endings = students.filter(F.length("id") >= 4).select(F.right("id", F.lit(4)).alias("read"))
    known = students.select(F.col("id").alias("read")).union(endings).distinct().withColumn("_hit", F.lit(True))
    # read five times below, so the narrow form is written once; texts stay only for cells that are no number
    cells = durable(cells.join(known, "read", "left").select(
        "path", "row_no", "col", F.when(F.col("number").isNull(), F.col("raw")).alias("raw"),
        F.col("number").isNotNull().alias("number"), F.coalesce("_hit", F.lit(False)).alias("_hit")))
    per = durable(cells.groupBy("path", "col").agg(
        F.count("*").alias("filled"), F.count_if("number").alias("numeric"), F.count_if("_hit").alias("id_hits")))
    wordy = per.filter((F.col("filled") >= 3) & (F.col("numeric") <= F.col("filled") * 0.5)).select("path", "col")
    words = cells.join(wordy, ["path", "col"], "left_semi").filter(F.coalesce(strip(F.col("raw")), F.lit("")) != "")
    named = similarity.by_name(words, roster.name_index(students), NAME_MIN).select("raw", F.lit(True).alias("_named"))
    words = words.join(named, "raw")
    name_hits = words.groupBy("path", "col").agg(F.count("*").alias("name_hits"))
    per = per.join(name_hits, ["path", "col"], "left").fillna(0, ["name_hits"])

    def best(hits: str):
        return F.max_by("col", F.struct(hits, -F.col("col")))

    join = per.groupBy("path").agg(
        F.max("id_hits").alias("_i"), F.max("name_hits").alias("_n"), best("id_hits").alias("_ic"), best("name_hits").alias("_nc"))
    by_number = (F.col("_i") >= 5) & (F.col("_i") >= F.col("_n"))
    join = join.select("path", F.when(by_number, "id").otherwise("name").alias("join_mode"),
                       F.when(by_number, F.col("_ic")).otherwise(F.col("_nc")).alias("join_col"))
    id_rows = cells.filter("_hit").join(join.filter("join_mode = 'id'"), "path").filter("col = join_col").select("path", "row_no")
    name_rows = words.join(join.filter("join_mode = 'name'"), "path").filter("col = join_col").select("path", "row_no")
    starts = roster.first_run(id_rows.unionByName(name_rows), ["path"])
    join = join.join(starts, "path", "left").fillna(0, ["data_start"])
    region = cells.join(join.select("path", "data_start"), "path").filter(F.col("row_no") >= F.col("data_start"))
    stats = region.groupBy("path", "col").agg(F.count("*").alias("nonnull"), F.count_if("number").alias("_num"))
    out = per.join(join, "path").join(stats, ["path", "col"], "left").fillna(0, ["nonnull", "_num"])
    share = F.coalesce(F.try_divide(F.col("_num"), F.col("nonnull")), F.lit(0.0))
    grade = (F.col("col") != F.col("join_col")) & (F.col("nonnull") >= 3) & (share >= 0.6)
    return out.select("path", "col", "join_mode", "join_col", "data_start", "nonnull", F.round(share, 2).alias("numeric_ratio"),
                      (F.col("id_hits") >= 3).alias("looks_id"), (F.col("name_hits") >= 3).alias("looks_name"), grade.alias("looks_grade"))


def series(table: DataFrame, files: DataFrame, columns: DataFrame, links: DataFrame) -> DataFrame:
    """Marks of every (file, column) in long form; the last row of a student wins.

    ``files(path, join_col, data_start)``, ``columns(path, idx, label)``, ``links(path, raw, student_id)``.
    """
    rows = table.join(files, "path").filter(F.col("row_no") >= F.col("data_start"))
    long = rows.join(columns, "path").select(
        "path", "idx", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Colonne "), (F.col("idx") + 1).cast("string"))).alias("name"),
        "row_no", strip(F.get("cells", F.col("join_col"))).alias("raw"), coerce_float(F.get("cells", F.col("idx"))).alias("value"))
    linked = long.filter("value IS NOT NULL").join(links, ["path", "raw"])
    return linked.groupBy("path", "idx", "name", "student_id").agg(F.max_by("value", "row_no").alias("value"))


def match_report(raws: DataFrame, index: DataFrame, overrides: DataFrame) -> dict[str, DataFrame]:
    """Diagnosis of a name column: counts per file, and each doubtful row with its closest students.

    ``raws(path, row_no, raw)``; scores in [0.70, 0.90) are ambiguous.
    """
    rows = raws.withColumn("raw", strip(F.col("raw"))).filter("raw <> ''")
    ruled = overrides.select("path", "raw", F.col("id").alias("_ov"), F.lit(True).alias("_ruled"))
    auto = similarity.by_name(rows, index, NAME_MIN).select("raw", F.col("id").alias("auto_id"), F.col("score"))
    judged = rows.join(ruled, ["path", "raw"], "left").join(auto, "raw", "left")
    status = F.when(F.col("_ruled"), F.when(F.col("_ov").isNull(), "ignored").otherwise("matched")) \
        .when(F.col("score") >= NAME_CONFIDENT, "matched").when(F.col("auto_id").isNotNull(), "ambiguous").otherwise("unmatched")
    judged = judged.withColumn("status", status)
    counts = judged.groupBy("path", "status").agg(F.count("*").alias("n"))
    doubtful = judged.filter(F.col("status").isin("ambiguous", "unmatched"))
    near = similarity.candidates(doubtful, index).groupBy("raw").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", F.round("score", 2).alias("score")))).alias("candidates"))
    problems = doubtful.join(near, "raw", "left").select(
        "path", "row_no", "raw", "status", F.when(F.col("status") == "ambiguous", F.col("auto_id")).alias("auto_id"), "candidates")
    resolved = judged.filter("_ruled").select("path", "raw", F.col("_ov").alias("target")).distinct()
    return {"counts": counts, "problems": problems, "resolved": resolved}


def id_match_report(raws: DataFrame, students: DataFrame) -> DataFrame:
    """Counts of a number column per file: matched and unmatched non-blank cells."""
    rows = raws.filter(strip(F.col("raw")) != "")
    judged = rows.join(resolve_ids(rows, students), "raw", "left")
    return judged.groupBy("path").agg(
        F.count("student_id").alias("n_matched"), F.count_if(F.col("student_id").isNull()).alias("n_unmatched"))


def id_match_problems(raws: DataFrame, students: DataFrame) -> DataFrame:
    """``(path, row_no, raw)`` of the non-blank cells of a number column that name no student."""
    rows = raws.filter(strip(F.col("raw")) != "")
    return rows.join(resolve_ids(rows, students).select("raw"), "raw", "left_anti").select("path", "row_no", "raw")


def upsert_grade_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column settings after (re)adding files: replaced by path, old parameters kept by index.

    Rows are ``(path, idx, label, norm, max, weight)``; null parameters of a new row take the
    old value, else the default.
    """
    kept = old.join(new.select("path").distinct(), "path", "left_anti")
    prev = old.select("path", "idx", *[F.col(c).alias(f"_{c}") for c in COLUMN_DEFAULTS])
    fresh = new.join(prev, ["path", "idx"], "left").select(
        "path", "idx", "label", *[F.coalesce(c, f"_{c}", F.lit(d)).alias(c) for c, d in COLUMN_DEFAULTS.items()])
    return kept.select("path", "idx", "label", *COLUMN_DEFAULTS).unionByName(fresh)


def remove_grade_files(settings: DataFrame, removed: DataFrame) -> DataFrame:
    return settings.join(removed.select("path").distinct(), "path", "left_anti")


def edit_overrides(overrides: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual name links after edits: a number forces it, null ignores the row, an empty text resets it."""
    kept = overrides.select("path", "raw", "id").join(edits.select("path", "raw").distinct(), ["path", "raw"], "left_anti")
    return kept.unionByName(edits.filter("id IS NULL OR id <> ''").select("path", "raw", "id"))
