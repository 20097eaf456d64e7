"""Adapter views: the assessment data model expressed over the given tables."""

from tallyloom.plans.registry import view

view("fx_roster", """
SELECT CAST(10000 + c_custkey AS STRING) AS id, c_name AS nom, c_mktsegment AS prenom,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('u', CAST(c_custkey AS STRING), '@x.org') END AS email,
       c_custkey AS ord
FROM {customer}
UNION ALL SELECT CAST(5000000 + s_suppkey AS STRING), s_name, 'GUEST', concat('g', CAST(s_suppkey AS STRING), '@x.org'), 1000000000 + s_suppkey
FROM {supplier}""")

view("fx_copy", """
SELECT o_orderkey AS copy_key, substr(o_orderpriority, 1, 1) AS batch, o_orderkey AS page,
       CASE WHEN o_orderkey % 2 = 0 THEN 'morning' ELSE 'afternoon' END AS grp,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(10000 + o_custkey AS STRING)
            WHEN 1 THEN right(CAST(10000 + o_custkey AS STRING), 4)
            WHEN 2 THEN right(CAST(10000 + o_custkey AS STRING), 3)
            ELSE concat('?', right(CAST(10000 + o_custkey AS STRING), 3)) END AS student_id,
       CAST(10000 + o_custkey AS STRING) AS true_id
FROM {orders}""")

view("fx_response", """
SELECT DISTINCT l_orderkey AS copy_key, l_linenumber AS q,
       substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) AS ch
FROM {lineitem}""")

# the readings as they come, repeats included
view("fx_tick", """
SELECT l_orderkey AS copy_key, l_linenumber AS q,
       substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) AS ch
FROM {lineitem}""")

view("fx_question", """
SELECT * FROM (VALUES (1,'single','1',NULL,NULL,''), (2,'mult','0',-0.5,NULL,''), (3,'single','2',NULL,1.5,'morning'),
  (4,'mult','0',NULL,NULL,'morning'), (5,'single','1/2',NULL,NULL,'afternoon'), (6,'mult','0',-1.0,0.5,'afternoon'),
  (7,'single','1',NULL,NULL,'')) AS t(q, qtype, pts, lo, hi, grp)""")

_OPTIONS = ", ".join(f"({q}, {pos}, '{ch}')" for q in range(1, 8) for pos, ch in enumerate("ABCD", 1))
view("fx_option", f"""
SELECT q, pos, ch, (pos + q) % 4 IN (0, CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END) AS correct,
       CASE WHEN q % 2 = 1 THEN '0' WHEN (pos + q) % 4 IN (0, 1) THEN '1/2' ELSE '-1/2' END AS pts
FROM (VALUES {_OPTIONS}) AS o(q, pos, ch)""")

view("fx_cell", """
SELECT l_orderkey AS copy_key, l_linenumber AS q, substr('ABCD', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) AS ch,
       max(l_discount * 10) AS ratio, max(l_tax * 12.5) AS proba,
       max(CASE WHEN l_partkey % 20 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity / 50 END) AS masked,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS truth
FROM {lineitem} GROUP BY 1, 2, 3""")

view("fx_exam_mark", """
SELECT o_orderstatus AS path, CAST(10000 + o_custkey AS STRING) AS id, floor(max(o_totalprice) / 1000) / 16 AS raw
FROM {orders} GROUP BY 1, 2""")

view("fx_import", """
SELECT c_custkey AS row_no, right(CAST(10000 + c_custkey AS STRING), 4) AS join_cell,
       CASE WHEN c_custkey % 11 = 0 THEN '' ELSE replace(CAST(c_acctbal AS STRING), '.', ',') END AS mark_cell
FROM {customer}""")

view("fx_bank", """
SELECT CAST(p_partkey AS STRING) AS bank_id,
       CASE p_size % 3 WHEN 0 THEN 'question_qcm' WHEN 1 THEN 'question_open' ELSE 'text' END AS kind,
       p_name AS title, lower(p_type) AS ptype, p_brand AS brand,
       concat('user', CAST(p_partkey % 10 AS STRING)) AS author,
       CASE WHEN p_partkey % 97 = 96 THEN 'missing' WHEN p_partkey % 5 IN (1, 2) THEN CAST(p_partkey - 1 AS STRING) ELSE '' END AS variant_of,
       p_partkey AS ord
FROM {part}""")

view("fx_category", """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name, r_regionkey AS position FROM {region}
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, n_nationkey FROM {nation}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), s_name, CAST(s_suppkey % 7 AS INT) FROM {supplier}""")

view("fx_question_category", """
SELECT DISTINCT CAST(l_partkey AS STRING) AS bank_id, concat('s', CAST(l_suppkey AS STRING)) AS category_id
FROM {lineitem}""")

view("fx_eval", """
SELECT l_partkey AS question_id, l_suppkey AS user_id, l_returnflag AS project_name, count(*) AS n_eval,
       CAST(sum(CASE WHEN l_discount < 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS n_perfect, sum(l_quantity / 50) AS sum_normalized
FROM {lineitem} GROUP BY 1, 2, 3""")

view("fx_rating", """
SELECT event_id % 200 AS question_id, user_id,
       max(CASE WHEN event_type IN ('view', 'purchase') THEN 1 + CAST(floor(value) AS INT) % 5 END) AS stars,
       max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 AS favorite
FROM {events} GROUP BY 1, 2""")

view("fx_edit", """
SELECT ts, event_id, user_id AS copy_key, CAST(1 + event_id % 7 AS INT) AS q,
       substr('ABCD', CAST(floor(abs(value)) AS INT) % 4 + 1, 1) AS ch
FROM {events} WHERE event_type = 'click'""")

view("fx_free_answer", """
SELECT conv_id, turn, text AS answer FROM {conversations}""")

view("fx_intensity", """
SELECT vec_id AS cell_key, embedding AS pixels FROM {embeddings}""")
