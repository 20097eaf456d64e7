"""Tables behind the announcement of marks, and the accounting of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import coerce_float, general_text, score_text
from tallyloom.functions.text import render, strip
from tallyloom.operators.marks import ABSENT

# Fields a template may use.
FIELDS = ("name", "full_name", "email", "id", "score", "max_score", "date", "sender")


def _judged(report: DataFrame) -> DataFrame:
    """Report rows with their mark and the first reason not to write to them."""
    clean = report.select(
        strip(F.coalesce("id", F.lit(""))).alias("id"), F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.lit("?")).alias("full_name"),
        strip(F.coalesce("email", F.lit(""))).alias("email"), strip(F.coalesce("mark", F.lit(""))).alias("raw"))
    clean = clean.withColumn("score", coerce_float("raw"))
    reason = F.when(F.col("email") == "", "no address") \
        .when(F.col("score").isNull(), F.when(F.upper("raw") == ABSENT, "absent (ABS)").otherwise("no mark"))
    return clean.withColumn("reason", reason)


def recipients(report: DataFrame, students: DataFrame, floor_at_zero: bool = True) -> DataFrame:
    """Who can be written to: address, mark (never announced below 0) and first name from the roster."""
    good = _judged(report).filter("reason IS NULL").join(students.select("id", F.trim("prenom").alias("_first")).dropDuplicates(["id"]), "id", "left")
    score = F.greatest("score", F.lit(0.0)) if floor_at_zero else F.col("score")
    return good.select("id", "email", "full_name", F.coalesce(F.nullif("_first", F.lit("")), "full_name").alias("first_name"), score.alias("score"))


def skipped(report: DataFrame) -> DataFrame:
    """Everybody left out and the first reason why."""
    return _judged(report).filter("reason IS NOT NULL").select("id", "full_name", "reason")


def announced_max(subject_total: DataFrame, columns: DataFrame, threshold: float) -> DataFrame:
    """Scale of the announced mark: the subject total, else the weighted mean of the maxima, capped."""
    mean = F.try_divide(F.sum(F.col("max") * F.col("weight")), F.sum("weight"))
    fallback = columns.agg(F.least(F.coalesce(mean, F.lit(20.0)), F.lit(float(threshold))))
    best = subject_total.agg(F.max(F.when(F.col("total_max") > 0, F.col("total_max"))).alias("t"))
    return best.select(F.coalesce("t", fallback.scalar()).alias("max_score"))


def messages(people: DataFrame, subject: str, body: str, max_score: Column, date: str, sender: str, decimals: int = 2) -> DataFrame:
    """Rendered subject and body of each message; the template is checked once, before any row."""
    fields = {"name": F.col("first_name"), "full_name": F.col("full_name"), "email": F.col("email"), "id": F.col("id"),
              "score": score_text("score", decimals), "max_score": general_text(max_score), "date": F.lit(date), "sender": F.lit(sender)}
    return people.select("id", "email", render(subject, fields).alias("subject"), render(body, fields).alias("body"))


def default_subject(date: str) -> str:
    date = (date or "").strip()
    return f"MCQ results — {date}" if date else "MCQ results"


def pending(people: DataFrame, log: DataFrame) -> DataFrame:
    """Recipients whose address was not logged as sent."""
    return people.join(log.filter("status = 'ok'").select("email").distinct(), "email", "left_anti")


def usage_totals(calls: DataFrame, prices: DataFrame, default_price: tuple[float, float]) -> DataFrame:
    """Calls, tokens and cost by backend and model, with the totals of each alone (null for the other) and the grand total.

    ``calls(backend, model, input_tokens, output_tokens, cache_creation, cache_read, cost)``;
    ``prices(model, price_in, price_out)`` per million tokens fills an unknown cost.
    """
    joined = calls.join(prices, "model", "left")
    price_in, price_out = F.coalesce("price_in", F.lit(default_price[0])), F.coalesce("price_out", F.lit(default_price[1]))
    estimate = (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6
    costed = joined.withColumn("cost", F.coalesce("cost", estimate))
    return costed.cube("backend", "model").agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_creation").alias("cache_creation"), F.sum("cache_read").alias("cache_read"), F.sum("cost").alias("cost"))
