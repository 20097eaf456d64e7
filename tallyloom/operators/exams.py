"""Many exams in one pass: scoring, question statistics and review by a composite key.

All tables carry ``exam``; questions are told apart by (exam, q), versions by (exam, grp). What one exam would read back as a single
value (the blank score of its common questions, the groups in use) is a small table by exam here, met by equality joins that
adaptive execution broadcasts while it is small and splits where one exam holds a large share of the copies. No group
ever holds the copies of an exam: they are reduced per copy or to counts per distinct score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import questions as single
from tallyloom.operators.review import CELL, structural_reason
from tallyloom.operators.scoring import belongs, bit_of, question_key, question_score

QUESTION = ("exam", "q")


def question_keys(questions: DataFrame, options: DataFrame) -> DataFrame:
    """``scoring.question_key`` of every question of every exam."""
    return question_key(questions, options, by=QUESTION)


def score_questions(ticks: DataFrame, options: DataFrame, key: DataFrame) -> DataFrame:
    """Score of every question of every copy with at least one valid tick: ``ticks(exam, copy_key, q, ch)``."""
    bits = options.select(*QUESTION, "ch", bit_of(F.col("pos")).alias("bit"))
    picked = ticks.select("exam", "copy_key", "q", "ch").join(bits, [*QUESTION, "ch"]).groupBy("exam", "copy_key", "q").agg(F.bit_or("bit").alias("picked"))
    return picked.join(key, list(QUESTION)).select(
        "exam", "copy_key", "q", F.col("grp").alias("q_grp"), "picked", "max_score", "blank_score", question_score(F.col("picked")).alias("score"))


def by_copy_group(key: DataFrame, copies: DataFrame) -> DataFrame:
    """Key rows under every copy group (``copy_grp``) that carries them: of its own exam, common questions included."""
    used = copies.select("exam", F.col("grp").alias("copy_grp")).distinct()
    return key.join(used, "exam").filter(belongs(F.col("grp"), F.col("copy_grp")))


def score_copies(copies: DataFrame, scored: DataFrame, key: DataFrame, total_floor: float | None = None) -> DataFrame:
    """Mark of every copy ``copies(exam, copy_key, grp)``: the blank score of its version and what each answer changes."""
    base = by_copy_group(key.select("exam", "grp", "blank_score"), copies).groupBy("exam", F.col("copy_grp").alias("grp")).agg(F.sum("blank_score").alias("_base"))
    moved = F.when(belongs(F.col("q_grp"), F.col("grp")), F.col("score") - F.col("blank_score"))
    sums = copies.select("exam", "copy_key", "grp").join(scored.select("exam", "copy_key", "q_grp", "score", "blank_score"), ["exam", "copy_key"], "left") \
        .groupBy("exam", "copy_key", "grp").agg(F.coalesce(F.sum(moved), F.lit(0.0)).alias("_moved"))
    total = F.round(F.col("_moved") + F.coalesce("_base", F.lit(0.0)), 4)
    return sums.join(base, ["exam", "grp"], "left").select("exam", "copy_key", "grp", F.greatest(total, F.lit(total_floor).cast("double")).alias("total"))


def version_totals(key: DataFrame, copies: DataFrame) -> DataFrame:
    """Maximum of every version in use, common questions included."""
    return by_copy_group(key.select("exam", "grp", "max_score"), copies).groupBy("exam", F.col("copy_grp").alias("grp")).agg(F.round(F.sum("max_score"), 6).alias("total_max"))


def score_distribution(copies: DataFrame, scored: DataFrame, key: DataFrame) -> DataFrame:
    """``(exam, q, score, n)``: copies with each score of each question they carry; blank ones are counted, not listed."""
    answered = scored.join(copies.select("exam", "copy_key", "grp"), ["exam", "copy_key"]).filter(belongs(F.col("q_grp"), F.col("grp"))) \
        .groupBy("exam", "q", "score").agg(F.count("*").alias("n"))
    sizes = copies.groupBy("exam", "grp").agg(F.count("*").alias("n_copies"))
    carried = by_copy_group(key.select("exam", "q", "grp", "blank_score"), sizes).join(sizes.withColumnRenamed("grp", "copy_grp"), ["exam", "copy_grp"]) \
        .groupBy("exam", "q", "blank_score").agg(F.sum("n_copies").alias("n_copies"))
    done = answered.groupBy("exam", "q").agg(F.sum("n").alias("n_done"))
    blanks = carried.join(done, list(QUESTION), "left").select(
        "exam", "q", F.col("blank_score").alias("score"), (F.col("n_copies") - F.coalesce("n_done", F.lit(0))).alias("n"))
    return answered.unionByName(blanks.filter("n > 0")).groupBy("exam", "q", "score").agg(F.sum("n").alias("n"))


def question_stats(distribution: DataFrame, key: DataFrame) -> DataFrame:
    """``questions.question_stats`` of every question of every exam."""
    return single.question_stats(distribution, key, by=QUESTION)


def structural_flags(copies: DataFrame, current: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """``(exam, copy_key, q, reason)`` of single questions with no or several valid ticks."""
    picked = current.join(options.select(*QUESTION, "ch"), [*QUESTION, "ch"]).groupBy("exam", "copy_key", "q").agg(F.count("*").alias("n"))
    asked = copies.select("exam", "copy_key", F.col("grp").alias("copy_grp")).join(
        by_copy_group(questions.filter("qtype = 'single'").select("exam", "q", "qtype", "grp"), copies).drop("grp"), ["exam", "copy_grp"])
    return asked.join(picked, ["exam", "copy_key", "q"], "left").select(
        "exam", "copy_key", "q", structural_reason("qtype", "n").alias("reason")).filter("reason IS NOT NULL")


def judged_cells(copies: DataFrame, flags: DataFrame, reviewed: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Flagged cells that are options of the questions their copy carries, each open or not; flags and marks are by copy."""
    valid = options.select(*QUESTION, "ch").join(questions.select(*QUESTION, F.col("grp").alias("q_grp")), list(QUESTION))
    cells = flags.join(copies.select("exam", "copy_key", "grp", "validated"), "copy_key").join(valid, [*QUESTION, "ch"]).filter(belongs(F.col("q_grp"), F.col("grp")))
    seen = reviewed.select(*CELL).withColumn("_seen", F.lit(True))
    return cells.join(seen, CELL, "left").select(
        "exam", *CELL, "reasons", "proba", (F.col("validated") | F.coalesce("_seen", F.lit(False))).alias("reviewed"))


def exam_progress(copies: DataFrame, reviews: DataFrame) -> DataFrame:
    """Copies, copies with something to look at, and open items of every exam."""
    joined = copies.select("exam", "copy_key").join(reviews.select("copy_key", "n_open"), "copy_key", "left")
    return joined.groupBy("exam").agg(F.count("*").alias("n_copies"), F.count("n_open").alias("n_listed"), F.coalesce(F.sum("n_open"), F.lit(0)).alias("n_open"))
