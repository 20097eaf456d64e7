"""Copies and subjects stored as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numbers import frac
from tallyloom.schemas import BY_QUESTION, COPY, SUBJECT

PAGE_FILE = r"([^/]+)/page_(\d+)\.json$"


def parse_copies(documents: DataFrame) -> dict[str, DataFrame]:
    """``documents(path, json)`` to copies placed by batch and page; unreadable documents are listed apart."""
    placed = documents.select(
        "path", F.regexp_extract("path", PAGE_FILE, 1).alias("batch"), F.regexp_extract("path", PAGE_FILE, 2).cast("int").alias("page"),
        F.from_json("json", COPY, {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("json").isNull().alias("_broken"))
    copies = placed.filter("NOT _broken").select("batch", "page", "d.*")
    renamed = copies.select("batch", "page", *[F.col(c).alias(c.lstrip("_")) for c in copies.columns if c not in ("batch", "page")])
    return {"copies": numbered_questions(renamed), "unreadable": placed.filter("_broken").select("path", "batch", "page")}


def numbered_questions(copies: DataFrame) -> DataFrame:
    """Questions of the maps as numbers; entries under other keys are dropped."""
    maps = [c for c in BY_QUESTION if c in copies.columns]
    return copies.withColumns({
        c: F.transform_keys(F.map_filter(c, lambda k, v: k.try_cast("int").isNotNull()), lambda k, v: k.cast("int")) for c in maps})


def read_copies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every ``<batch>/page_NNN.json`` under ``root``."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "page_*.json").option("recursiveFileLookup", True).text(root)
    return parse_copies(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def answer_key(subjects: DataFrame) -> dict[str, DataFrame]:
    """``subjects(subject, json)`` to question and option tables; only multiple-choice blocks are scored, in document order."""
    blocks = subjects.select("subject", F.from_json("json", SUBJECT).alias("s")).select("subject", F.filter("s.blocks", lambda b: b["kind"] == "question_qcm").alias("b"))
    rows = blocks.select("subject", F.posexplode("b").alias("i", "b")).select("subject", (F.col("i") + 1).alias("q"), "b.group", "b.data.*")
    questions = rows.select(
        "subject", "q", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("qtype", F.lit("mult")).alias("qtype"), "value",
        frac("floor").alias("lo"), frac("ceiling").alias("hi"), F.coalesce("group", F.lit("")).alias("grp"), F.col("_bank_id").alias("bank_id"))
    options = rows.select("subject", "q", F.posexplode("answers").alias("pos", "a")).select(
        "subject", "q", (F.col("pos") + 1).alias("pos"), F.coalesce("a.correct", F.lit(False)).alias("correct"), F.col("a.bareme").alias("pts"))
    return {"questions": questions, "options": options}


def read_subjects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    files = spark.read.option("wholetext", True).text(path)
    return answer_key(files.select(F.col("_metadata.file_path").alias("subject"), F.col("value").alias("json")))
