"""Queries of this package with production parameters, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, decontaminate, html_extract, lm_score, merkle, packing, pii, quality, secret_scan, sentence_pieces, simhash, token_counts, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: key of the registered query; a real run takes its own from a secret store
PSEUDONYM_KEY = b"tallyloom registered query"


def op1_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.train(docs, table(spark, folder, "labels"))
    return quality.add_score(docs, rules).select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lm_score.score(docs)


def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents").select("doc_id", "text"))
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.report(decontaminate.find_overlaps(docs, table(spark, folder, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.digest(secret_scan.scan(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = sentence_pieces.encode(docs, decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = whitening.transform(vectors, whitening.fit(vectors))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, merkle.lower_plain(docs["text"])).otherwise(docs["text"])
    return merkle.prove(merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered}))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pseudonyms, op2_quality, op3_lm_score, op4_pack, op5_neighbours, op6_decontaminate, op7_main_text, op8_secret_scan, op9_token_counts, op10_simhash,
                           op11_sentencepiece, op12_whitening, op13_merkle)
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
TWINS: dict[str, str] = {
    "op6_decontaminate": f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS pattern
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows)),
found AS (SELECT r, i, p.k, item FROM places p JOIN windows x ON p.k = x.k AND array_to_string(w[i:i + p.k - 1], ' ') = pattern),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_merkle": f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text,
         CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown
  FROM documents),
fields AS (SELECT r, doc_id, lang, concat({_FIELD.format("CAST(doc_id AS VARCHAR)")}, {_FIELD.format("source")}, {_FIELD.format("lang")}, {_FIELD.format("CAST(n_chars AS VARCHAR)")}) AS head,
                  {_FIELD.format("text")} AS body, {_FIELD.format("shown")} AS other FROM docs),
digests AS (SELECT r, doc_id, lang, sha256(head || body) AS leaf, sha256(head || other) AS presented FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM digests),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS d, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(d, '' ORDER BY place)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
tops AS (
  SELECT 0 AS level, tree AS place, d, (SELECT count(DISTINCT tree) FROM leaves) AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(d, '' ORDER BY place)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, place // 8, n),
every AS (SELECT tree, level, place, d, n FROM nodes UNION ALL SELECT -1, level, place, d, n FROM tops),
sides AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
         coalesce(string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.place),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY above, level) AS step, before, after FROM (
    SELECT l.r, 0 AS above, s.level, before, after FROM leaves l JOIN sides s ON s.tree = l.tree AND s.place = l.place // CAST(pow(8, s.level) AS BIGINT)
    UNION ALL
    SELECT l.r, 1, s.level, before, after FROM leaves l JOIN sides s ON s.tree = -1 AND s.place = l.tree // CAST(pow(8, s.level) AS BIGINT))),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS last FROM steps GROUP BY r),
folds AS (
  SELECT r, CAST(0 AS BIGINT) AS step, presented AS d FROM leaves
  UNION ALL
  SELECT f.r, s.step, sha256(before || d || after) FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step + 1)
SELECT doc_id, leaf, t.d AS subroot, o.d AS root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = o.d AS verified
FROM leaves l JOIN tops t ON t.level = 0 AND t.place = l.tree JOIN (SELECT d FROM tops WHERE n = 1) o ON true
LEFT JOIN proofs p USING (r) JOIN folds f ON f.r = l.r AND f.step = coalesce(last, 0)""",
}
