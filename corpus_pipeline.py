"""From raw documents to packed training sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, packing, quality, secret_scan, simhash
from tallyloom.session import scratch_folder

MASK = "[SECRET]"


#: words whose ids one worker keeps while packing, and the bytes of text it encodes at a time; the stages share their workers' memory
PACK_CACHE, PACK_BYTES = 150_000, 1 << 18


def beside_text(docs: DataFrame) -> DataFrame:
    """``text`` and, as one column ``own_columns``, everything of ``docs``, so that no operator's column meets one of the same name."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own_columns"), docs["text"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules predict to be good.

    Null and empty texts are scored as empty; repeated rows are judged alike; an empty table gives none; columns keep their values.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.train(docs.select("doc_id", "text"), labels)
    return quality.add_score(beside_text(docs), rules).where("predicted = 1").select("own_columns.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), that of the smallest id.

    Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: as ``simhash.keep_one`` states.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have none and stay; repeated rows are judged alike; an empty table gives none; columns keep their values.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_overlaps(beside_text(docs), benchmark).where(F.size("hits") == 0).select("own_columns.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``MASK`` and the length counted anew.

    A null text stays null, and its length null; repeated rows are masked alike; an empty table gives none; other columns keep their values.
    """
    found = secret_scan.scan(beside_text(docs), mask=MASK)
    changed = {"text": F.col("masked"), "n_chars": F.char_length("masked")}
    return found.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col("own_columns").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, with their ids; nulls, repeated rows and other columns as ``packing.pack`` states."""
    return packing.pack(docs, cached=PACK_CACHE, most_bytes=PACK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("pack", pack),
]

#: the learnt rules and the tokenizer's ids have no SQL form; tests compare every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    folder = scratch_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        # Spark drops the shuffles and checkpoints of a finished stage when the driver collects its garbage
        spark.sparkContext._jvm.java.lang.System.gc()
    return STAGES[-1][1](spark, docs, sf_dir)
