"""Writers. A single output file is made only where a person downloads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Comma-separated file with a header; ``single_file`` is for exports small enough to be mailed."""
    (rows.coalesce(1) if single_file else rows).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_labeled_cells(data: DataFrame, path: str, form: str = "parquet") -> DataFrame:
    """Write the training set (parquet, or CSV where parquet is not wanted) and return its summary."""
    writer = data.write.mode("overwrite")
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
    return dataset_summary(data)


def dataset_summary(data: DataFrame) -> DataFrame:
    """Labels, filled share and distinct copies per source."""
    per_copy = data.groupBy("source", "copy_key").agg(F.count("*").alias("n"), F.sum("label").alias("filled"))
    return per_copy.groupBy("source").agg(F.sum("n").alias("n"), F.sum("filled").alias("n_filled"), F.count("*").alias("n_copies"))


def wide_scores(details: DataFrame, questions: list[int]) -> DataFrame:
    """Ticked and right letters and score of each question in its own columns; blank where a copy lacks it.

    ``details(batch, page, q, selected, correct, score, error)``; an error row keeps its message.
    """
    pivoted = details.groupBy("batch", "page").pivot("q", questions).agg(
        F.first("selected").alias("selected"), F.first("correct").alias("correct"), F.first("score").alias("score"))
    errors = details.filter("error IS NOT NULL").groupBy("batch", "page").agg(F.min("error").alias("error"))
    named = pivoted.select("batch", "page", *[F.col(f"{q}_{c}").alias(f"Q{q}_{c}") for q in questions for c in ("selected", "correct", "score")])
    return named.join(errors, ["batch", "page"], "left")


def append_log(rows: DataFrame, path: str) -> None:
    """Append notification log rows; details are cut to 200 characters, as the log keeps them."""
    rows.select("ts", "email", "name", "score", "status", F.substring("detail", 1, 200).alias("detail")).write.mode("append").parquet(path)
