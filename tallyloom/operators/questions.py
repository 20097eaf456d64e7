"""Statistics of questions, of bank entries over projects, and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.scoring import belongs, key_by_copy_group, mask_letters

PERFECT = 1e-9


def score_distribution(copies: DataFrame, scored: DataFrame, key: DataFrame) -> DataFrame:
    """``(q, score, n)``: how many copies that carry a question got each score, blanks included.

    Blank answers all get the same score, so they are a count per question, not rows:
    copies of the version less the answered ones. This is the whole list of scores in a
    form whose size does not grow with the copies.
    """
    answered = scored.join(copies.select("copy_key", "grp"), "copy_key").filter(belongs(F.col("q_grp"), F.col("grp"))) \
        .groupBy("q", "score").agg(F.count("*").alias("n"))
    sizes = copies.groupBy("grp").agg(F.count("*").alias("n_copies"))
    carried = key_by_copy_group(key.select("q", "grp", "blank_score"), sizes).join(sizes.withColumnRenamed("grp", "copy_grp"), "copy_grp") \
        .groupBy("q", "blank_score").agg(F.sum("n_copies").alias("n_copies"))
    done = answered.groupBy("q").agg(F.sum("n").alias("n_done"))
    blanks = carried.join(done, "q", "left").select(
        "q", F.col("blank_score").alias("score"), (F.col("n_copies") - F.coalesce("n_done", F.lit(0))).alias("n"))
    return answered.unionByName(blanks.filter("n > 0")).groupBy("q", "score").agg(F.sum("n").alias("n"))


def question_stats(distribution: DataFrame, key: DataFrame, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """Evaluations, perfect answers, mean normalised (may be negative) and raw score per question, told apart by ``by``."""
    joined = distribution.join(key.select(*by, "max_score").filter("max_score > 0"), list(by))
    total = F.sum(F.col("n") * F.col("score"))
    return joined.groupBy(*by, "max_score").agg(
        F.sum("n").alias("n_eval"),
        F.coalesce(F.sum(F.when(F.col("score") >= F.col("max_score") - PERFECT, F.col("n"))), F.lit(0)).alias("n_perfect"),
        total.alias("sum_score"), (total / F.sum("n")).alias("mean_score")).withColumn(
            "sum_normalized", F.col("sum_score") / F.col("max_score")).withColumn(
                "mean_normalized", F.col("mean_score") / F.col("max_score"))


def rank_questions(stats: DataFrame, by: str = "success", descending: bool = True) -> DataFrame:
    """Ordered by success, number or evaluations; questions without a mean come last."""
    column = {"success": "mean_normalized", "number": "q", "evaluations": "n_eval"}[by]
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return stats.orderBy(order, "q")


def normalized_bin(value: Column) -> Column:
    """Bin 0..14 of a normalised score clipped to [-0.5, 1]."""
    clipped = F.greatest(F.lit(-0.5), F.least(F.lit(1.0), value))
    return F.greatest(F.lit(0), F.least(F.lit(14), F.floor((clipped + 0.5) * 10 + 1e-9).cast("int")))


def normalized_histogram(distribution: DataFrame, key: DataFrame) -> DataFrame:
    joined = distribution.join(key.select("q", "max_score").filter("max_score > 0"), "q")
    return joined.groupBy("q", normalized_bin(F.col("score") / F.col("max_score")).alias("bin")).agg(F.sum("n").alias("n"))


def bank_sync(stats: DataFrame, instances: DataFrame) -> DataFrame:
    """Exam statistics per bank entry, over all its instances in the exam (``instances(q, bank_id)``)."""
    return instances.join(stats, "q").groupBy("bank_id").agg(
        F.sum("n_eval").alias("n_eval"), F.sum("sum_normalized").alias("sum_normalized"),
        F.sum("n_perfect").alias("n_perfect"), F.max("max_score").alias("max_score_at_sync"))


EVAL_KEY = ["question_id", "user_id", "project_name"]


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str] = EVAL_KEY) -> DataFrame:
    """Replace the rows of the same key, never add to them; running it twice changes nothing."""
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def stats_summary(evals: DataFrame) -> DataFrame:
    """Totals of each question over the projects that evaluated it."""
    used = evals.filter("n_eval > 0")
    n = F.sum("n_eval")
    return used.groupBy("question_id").agg(
        n.alias("n_eval"), F.sum("n_perfect").alias("n_perfect"), F.sum("sum_normalized").alias("sum_normalized"),
        F.try_divide(F.sum("sum_normalized"), n).alias("mean_normalized"), F.count("*").alias("n_projects"))


def global_eval_stats(evals: DataFrame) -> DataFrame:
    """Distinct users and projects and totals per question.

    The key is collapsed level by level, so a popular question is reduced before it meets in one task.
    """
    by_project = evals.groupBy(*EVAL_KEY).agg(F.sum("n_eval").alias("n"), F.sum("n_perfect").alias("p"), F.sum("sum_normalized").alias("s"))
    by_user = by_project.groupBy("question_id", "user_id").agg(
        F.count("*").alias("projects"), F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"))
    return by_user.groupBy("question_id").agg(
        F.count("*").alias("n_users"), F.sum("projects").alias("n_projects"), F.sum("n").alias("n_eval"),
        F.sum("p").alias("n_perfect"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean_normalized"))


def rating_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("question_id").agg(
        F.avg("stars").alias("avg_stars"), F.count("stars").alias("n_ratings"),
        F.count_if(F.coalesce("favorite", F.lit(False))).alias("n_favorites"))


def student_card(detail: DataFrame, key: DataFrame, diffs: DataFrame) -> DataFrame:
    """Per copy and question: ticked and right letters, score, maximum and whether two readings differ.

    ``detail`` comes from :func:`tallyloom.operators.scoring.copy_questions`; ``diffs(copy_key, q)``.
    """
    marked = diffs.select("copy_key", "q").distinct().withColumn("has_diff", F.lit(True))
    rows = detail.join(key.select("q", "opts"), "q").join(marked, ["copy_key", "q"], "left")
    return rows.select("copy_key", "q", mask_letters("picked").alias("selected"), mask_letters("correct_mask").alias("correct"),
                       "score", "max_score", F.coalesce("has_diff", F.lit(False)).alias("has_diff"))


def card_totals(card: DataFrame) -> DataFrame:
    return card.groupBy("copy_key").agg(
        F.round(F.sum("score"), 4).alias("total"), F.round(F.sum("max_score"), 6).alias("total_max"),
        F.count_if("has_diff").alias("n_diff"))


RATING_KEY = ["question_id", "user_id"]


def merge_ratings(stored: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Partial updates: given fields replace the stored ones; stars outside 1..5 are rejected."""
    bad = (F.col("stars") < 1) | (F.col("stars") > 5)
    good = changes.filter(~F.coalesce(bad, F.lit(False)))
    fresh = good.select(*RATING_KEY, F.col("stars").alias("_s"), F.col("favorite").alias("_f"))
    merged = stored.join(fresh, RATING_KEY, "full").select(
        *RATING_KEY, F.coalesce("_s", "stars").alias("stars"), F.coalesce("_f", "favorite", F.lit(False)).alias("favorite"))
    return {"ratings": merged, "rejected": changes.filter(bad)}


def merge_tags(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Personal tags replaced per (question, user); an empty list removes the row."""
    cleaned = changes.withColumn("tags", F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda x: F.trim(x)), lambda x: x != ""))))
    return upsert(stored, cleaned, RATING_KEY).filter(F.size("tags") > 0)
