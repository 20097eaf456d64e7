"""Scalar expressions, each as a projection over a whole table."""

from pyspark.sql import functions as F

from tallyloom.functions import answers, numbers, text
from tallyloom.plans.registry import query, view

view("fx_block", """
SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'question_qcm' WHEN 1 THEN 'question_open' WHEN 2 THEN 'answerbox'
         WHEN 3 THEN 'text' WHEN 4 THEN 'question_freeform' ELSE 'spacer' END AS kind,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_name, ' of the', chr(10), ' ', p_type, ' made by ', p_brand, ' for every size') END AS statement,
       CASE WHEN p_partkey % 8 = 0 THEN '' ELSE lower(p_brand) END AS tag,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS title,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_type, '  ', p_name) END AS tex
FROM {part}""")

view("fx_fraction", """
SELECT l_orderkey AS a, l_linenumber AS b,
       CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(l_linenumber AS STRING), '/', CAST(l_suppkey % 4 AS STRING))
            WHEN 2 THEN concat('-1/', CAST(1 + l_suppkey % 5 AS STRING)) WHEN 3 THEN CAST(l_discount AS STRING) ELSE 'x/2' END AS txt
FROM {lineitem}""")


@query("b1_norm_name", """
SELECT conv_id, turn, trim(lower(regexp_replace(strip_accents(text), '[^a-zA-Z]+', ' ', 'g'))) AS norm FROM conversations""")
def b1(t):
    return t.conversations.select("conv_id", "turn", text.norm_name("text").alias("norm"))


@query("b2_cell_text", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR)
       ELSE regexp_replace(CAST(c_acctbal AS VARCHAR), '^(\\d+)\\.0$', '\\1') END AS cell FROM customer""")
def b2(t):
    typed = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 "))
    raw = F.when(F.col("c_custkey") % 2 == 0, typed).otherwise(F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", text.cell_text(raw).alias("cell"))


@query("b3_coerce_float", """
SELECT row_no, TRY_CAST(replace(trim(mark_cell), ',', '.') AS DOUBLE) AS mark FROM fx_import""")
def b3(t):
    return t.fx_import.select("row_no", numbers.coerce_float("mark_cell").alias("mark"))


@query("b4_frac", """
WITH f AS (SELECT txt, count(*) AS n FROM fx_fraction GROUP BY 1),
v AS (SELECT txt, n, CASE WHEN contains(txt, '/')
    THEN TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(txt, '/', 2) AS DOUBLE), 0)
    ELSE TRY_CAST(txt AS DOUBLE) END AS value FROM f)
SELECT txt, n, value, coalesce(value, 0.0) AS value_or_zero FROM v""")
def b4(t):
    return t.fx_fraction.groupBy("txt").agg(F.count("*").alias("n")).select(
        "txt", "n", numbers.frac("txt").alias("value"), numbers.frac_or_zero("txt").alias("value_or_zero"))


@query("b5_fold", """
SELECT doc_id, md5(trim(lower(regexp_replace(strip_accents(text), '\\s+', ' ', 'g')))) AS digest FROM documents""")
def b5(t):
    return t.documents.select("doc_id", F.md5(text.fold("text").cast("binary")).alias("digest"))


@query("b6_slug", """
SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (
SELECT doc_id, substr(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'),
   '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 50) AS s FROM documents)""")
def b6(t):
    return t.documents.select("doc_id", text.slug("text").alias("slug"))


@query("b7_id_pieces", """
SELECT copy_key, right(true_id, 4) AS last4, right(true_id, 3) AS last3,
       CASE WHEN length(student_id) < 7 THEN lpad(student_id, 7, '0') ELSE student_id END AS padded,
       ltrim(student_id, '0') AS stripped FROM fx_copy""")
def b7(t):
    return t.fx_copy.select("copy_key", numbers.suffix("true_id", 4).alias("last4"), numbers.suffix("true_id", 3).alias("last3"),
                            numbers.zfill("student_id", 7).alias("padded"), numbers.strip_zeros("student_id").alias("stripped"))


@query("b8_rescale", """
SELECT o_orderkey, CASE WHEN norm = 0 THEN 0.0 ELSE least(o_totalprice / norm, 1.0) * 20.0 END AS mark
FROM (SELECT *, CAST(1000 * (o_orderkey % 400) AS DOUBLE) AS norm FROM orders)""")
def b8(t):
    norm = (1000 * (F.col("o_orderkey") % 400)).cast("double")
    return t.orders.select("o_orderkey", numbers.rescale("o_totalprice", norm, F.lit(20.0)).alias("mark"))


@query("b10_match_answer", """
SELECT conv_id, turn, lower(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) = 'yes' AS is_exact,
       contains(lower(answer), 'tion') OR contains(lower(answer), 'eau') AS has_part,
       regexp_matches(answer, '^[A-Z].*\\.$') AS has_shape, false AS no_choice
FROM fx_free_answer""")
def b10(t):
    return t.fx_free_answer.select(
        "conv_id", "turn", answers.match_answer("answer", ["Yes"]).alias("is_exact"),
        answers.match_answer("answer", ["tion", "EAU"], "contains").alias("has_part"),
        answers.match_answer("answer", ["(", r"^[A-Z].*\.$"], "regex").alias("has_shape"),
        answers.match_answer("answer", ["", None]).alias("no_choice"))


@query("b10_match_numeric", """
SELECT row_no, coalesce(abs(TRY_CAST(replace(mark_cell, ',', '.') AS DOUBLE) - 5000.0) <= 2500.0, false)
     OR coalesce(abs(TRY_CAST(replace(mark_cell, ',', '.') AS DOUBLE) - 100.5) <= 2500.0, false) AS hit FROM fx_import""")
def b10_numeric(t):
    return t.fx_import.select("row_no", answers.match_answer(
        "mark_cell", ["5 000", "100,5", "n/a"], "numeric_tol", tolerance=2500).alias("hit"))


@query("b11_open_answer_score", """
SELECT conv_id, turn, CASE WHEN contains(lower(answer), 'tion') THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS score,
       round(length(answer) / 997.0, 3) AS confidence FROM fx_free_answer""")
def b11(t):
    score, level = answers.open_answer_score(
        answers.match_answer("answer", ["tion"], "contains"), 2.5, F.length("answer") / 997.0)
    return t.fx_free_answer.select("conv_id", "turn", score.alias("score"), level.alias("confidence"))


@query("b12_validators", """
SELECT p_partkey, regexp_full_match(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7 + CAST(p_partkey % 2 AS INT)), '[0-9a-f]{8}') AS bank_ok,
       p_partkey % 3 = 0 AS category_ok, regexp_full_match(replace(p_brand, '#', '.'), '[A-Za-z0-9_][A-Za-z0-9._ -]*') AS batch_ok,
       lower(p_type) IN ('draft', 'public', 'archived') AS status_ok FROM part""")
def b12(t):
    digest = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    bank = F.substring(digest, F.lit(1), (7 + F.col("p_partkey") % 2).cast("int"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    category = F.when(F.col("p_partkey") % 3 == 0, uuid).otherwise(digest)
    return t.part.select("p_partkey", text.is_bank_id(bank).alias("bank_ok"), text.is_category_id(category).alias("category_ok"),
                         text.is_batch_name(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("batch_ok"), text.is_status(F.lower("p_type")).alias("status_ok"))


@query("b13_clean_name", """
SELECT doc_id, CASE WHEN length(n) BETWEEN 1 AND 80 THEN n END AS name, CASE WHEN length(n) BETWEEN 1 AND 80 THEN lower(n) END AS sibling
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents)""")
def b13(t):
    return t.documents.select("doc_id", text.clean_name("text").alias("name"), text.sibling_key("text").alias("sibling"))


@query("b14_page_filter", """
SELECT copy_key FROM fx_copy WHERE page BETWEEN 10 AND 500 OR page = 7 OR page BETWEEN 900 AND 1000""")
def b14(t):
    return t.fx_copy.filter(text.page_filter("page", "10-500,7, 900-1000")).select("copy_key")


@query("b15_uncertainty", """
SELECT copy_key, q, ch, CASE WHEN proba > 0.9 THEN 0.5 ELSE 1.0 - abs(2.0 * proba - 1.0) END AS doubt FROM fx_cell""")
def b15(t):
    return t.fx_cell.select("copy_key", "q", "ch", numbers.uncertainty(F.when(F.col("proba") <= 0.9, F.col("proba"))).alias("doubt"))


@query("b16_cell_key", """
SELECT q || '_' || ch AS cell, q, ch, count(*) AS n FROM fx_response GROUP BY 1, 2, 3""")
def b16(t):
    keyed = t.fx_tick.distinct().groupBy(text.cell_key("q", "ch").alias("cell")).agg(F.count("*").alias("n"))
    number, letter = text.split_cell_key("cell")
    return keyed.select("cell", number.alias("q"), letter.alias("ch"), "n")


@query("b17_score_text", """
SELECT c_custkey, regexp_replace(CASE WHEN contains(s, '.') THEN rtrim(s, '0') ELSE s END, '\\.$', '') AS shown,
       CAST(c_custkey % 1000 AS VARCHAR) || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS top
FROM (SELECT c_custkey, printf('%.2f', c_acctbal) AS s FROM customer)""")
def b17(t):
    top = (F.col("c_custkey") % 1000) + (F.col("c_custkey") % 4) / 4.0
    return t.customer.select("c_custkey", numbers.score_text("c_acctbal").alias("shown"), numbers.general_text(top).alias("top"))


@query("b18_clip", """
SELECT doc_id, CASE WHEN length(s) > 140 THEN rtrim(substr(s, 1, 140)) || '…' ELSE s END AS clipped
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)""")
def b18(t):
    return t.documents.select("doc_id", text.clip("text", 140).alias("clipped"))


@query("b19_auto_title", """
WITH s AS (SELECT *, trim(regexp_replace(coalesce(statement, ''), '\\s+', ' ', 'g')) AS st,
                  trim(regexp_replace(coalesce(tex, ''), '\\s+', ' ', 'g')) AS tx FROM fx_block),
c AS (SELECT *, nullif(CASE WHEN length(st) > 60 THEN substr(st, 1, 60) || '…' ELSE st END, '') AS cst,
             nullif(CASE WHEN length(tx) > 60 THEN substr(tx, 1, 60) || '…' ELSE tx END, '') AS ctx FROM s)
SELECT id, CASE kind WHEN 'answerbox' THEN coalesce(nullif(title, ''), 'Zone de réponse')
     WHEN 'text' THEN coalesce(ctx, 'Bloc texte') WHEN 'question_qcm' THEN coalesce(cst, nullif(tag, ''), 'QCM')
     WHEN 'question_open' THEN coalesce(cst, nullif(tag, ''), 'Question ouverte')
     WHEN 'question_freeform' THEN coalesce(cst, nullif(tag, ''), 'Question libre') ELSE kind END AS title FROM c""")
def b19(t):
    return t.fx_block.select("id", text.auto_title("kind", "statement", "tag", "title", "tex").alias("title"))


@query("b20_render", """
SELECT id, 'Dear ' || prenom || ', mark $' || id || ' for ' || nom || '.' AS body FROM fx_roster""")
def b20(t):
    return t.fx_roster.select("id", text.render(
        "Dear ${first}, mark $$$id for $full.", {"first": F.col("prenom"), "id": F.col("id"), "full": F.col("nom")}).alias("body"))


@query("b21_bits_to_int", """
SELECT l_orderkey, CAST(sum(CASE WHEN r > 0.5 THEN 1 << (7 - l_linenumber) ELSE 0 END) AS BIGINT) AS code
FROM (SELECT l_orderkey, l_linenumber, max(l_discount * 10) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def b21(t):
    bits = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_discount") * 10).alias("r"))
    return bits.groupBy("l_orderkey").agg(numbers.bits_to_int("r", "l_linenumber", 7, 0.5).alias("code"))


@query("b22_search_text", """
SELECT id, trim(lower(regexp_replace(concat_ws(' ', nullif(statement, ''), nullif(tex, ''), nullif(tag, ''), nullif(title, '')), '\\s+', ' ', 'g'))) AS search
FROM fx_block""")
def b22(t):
    return t.fx_block.select("id", text.search_text("statement", "tex", "tag", "title").alias("search"))
