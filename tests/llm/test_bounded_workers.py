"""Workers that hold little at a time give the same rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import packing

FOLDER = "/root/testdata/sf0.001"


def rows_of(pieces):
    return sorted(pieces.select("doc_id", "start", "length", F.md5("ids").alias("ids"), "doc_tokens").collect())


def test_packing_a_little_text_at_a_time_loses_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000)], docs.schema))
    want = rows_of(packing.pack(docs))
    assert rows_of(packing.pack(docs, cached=50, most_bytes=64)) == want
    assert rows_of(corpus_pipeline.pack(spark, docs, FOLDER)) == want
