"""Question bank, notification and quality queries; the bank is the parts."""

from pyspark.sql import functions as F

from tallyloom.operators import bank, notify, quality, roster, scoring, tree, variants
from tallyloom.plans.marks_plans import exam_rows
from tallyloom.plans.registry import query, view
from tallyloom.plans.scoring_plans import item_key
from tallyloom.session import scratch_folder
from tallyloom.sources import documents, sinks, tables

view("fx_entry", """
SELECT b.*, CASE b.ord % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' ELSE 'public' END AS status, concat(ptype, ';', brand, ';') AS tag_text,
  (b.ord * 7919) % 1000003 AS modified_at, CAST(b.ord AS BIGINT) AS created_at, concat('Énoncé ', title, ' ', brand) AS statement, 'v1' AS tex, lower(brand) AS tag FROM {fx_bank} b""")
view("fx_tw_head", """
SELECT b.bank_id, b.ord AS created_at, CASE WHEN b.ord % 97 = 96 THEN b.bank_id WHEN b.ord % 5 = 1 THEN CAST(b.ord - 1 AS VARCHAR)
  WHEN b.ord % 5 = 2 THEN CASE WHEN (b.ord - 1) % 97 = 96 THEN CAST(b.ord - 1 AS VARCHAR) ELSE CAST(b.ord - 2 AS VARCHAR) END ELSE b.bank_id END AS head FROM {fx_bank} b""")


def entries(t):
    return t.fx_entry.withColumn("tags", F.filter(F.split("tag_text", ";"), lambda x: x != "")).drop("tag_text")


def heads(t):
    return variants.normalize(t.fx_bank.select("bank_id", "variant_of", F.col("ord").alias("created_at")))


def index(t):
    return bank.bank_index(entries(t), t.fx_eval)


view("fx_tw_index", """
SELECT e.*, trim(lower(regexp_replace(strip_accents(concat_ws(' ', statement, tex, tag, title)), '\\s+', ' ', 'g'))) AS text, coalesce(s.n, 0) AS n_eval, coalesce(s.p, 0) AS n_perfect, coalesce(s.k, 0) AS n_projects
FROM {fx_entry} e LEFT JOIN (SELECT CAST(question_id AS VARCHAR) AS q, CAST(sum(n_eval) AS BIGINT) AS n, CAST(sum(n_perfect) AS BIGINT) AS p, count(*) AS k FROM {fx_eval} GROUP BY 1) s ON s.q = e.bank_id""")


@query("a14_bank_index", "SELECT bank_id, kind, title, tag_text AS tags, author, modified_at, created_at, variant_of, text, n_eval, n_perfect, n_projects FROM fx_tw_index")
def a14(t):
    return index(t).withColumn("tags", F.concat(F.array_join("tags", ";"), F.lit(";")))


@query("l1_list_questions", """
WITH m AS (SELECT DISTINCT h.head FROM fx_tw_index i JOIN fx_tw_head h ON h.bank_id = i.bank_id WHERE kind = 'question_qcm' AND contains(author, 'user') AND (contains(text, 'enonce') OR contains(lower(title), 'enonce')))
SELECT i.bank_id, modified_at, (SELECT count(*) FROM fx_tw_head k WHERE k.head = i.bank_id AND k.bank_id <> i.bank_id) AS n_variants FROM fx_tw_index i JOIN m ON m.head = i.bank_id ORDER BY modified_at DESC""")
def l1(t):
    condition = bank.by_kind("question_qcm") & bank.by_author("USER") & bank.by_text("ÉNONCÉ")
    return bank.list_questions(index(t), condition).select("bank_id", "modified_at", "n_variants")


@query("l1_list_flat", "SELECT bank_id, modified_at FROM fx_tw_index WHERE kind = 'text'")
def l1_flat(t):
    return bank.list_questions(index(t), bank.by_kind("text"), flat=True).select("bank_id", "modified_at")


@query("l2_kind_author", "SELECT bank_id FROM fx_entry WHERE kind = 'question_open' AND contains(lower(author), 'er3')")
def l2(t):
    return entries(t).filter(bank.by_kind("question_open") & bank.by_author(" ER3 ")).select("bank_id")


@query("l3_tags", "SELECT bank_id FROM fx_entry WHERE ptype IN ('economy', 'small') OR lower(brand) = 'brand#7'")
def l3(t):
    return entries(t).filter(bank.by_tags(["ECONOMY", "Small", "brand#7", ""])).select("bank_id")


@query("l4_text_search", "SELECT bank_id FROM fx_tw_index WHERE contains(text, 'enonce blue') OR contains(lower(title || ' ' || ptype || ' ' || brand), 'enonce blue')")
def l4(t):
    return index(t).filter(bank.by_text("énoncé  BLUE")).select("bank_id")


@query("l4_text_online", "SELECT bank_id FROM fx_entry WHERE contains(lower(title), 'red') OR contains(lower(statement), 'red')")
def l4_online(t):
    return entries(t).filter(bank.by_text_online(" Red ")).select("bank_id")


view("fx_tw_closure", """
SELECT id, id AS ancestor, 0 AS distance FROM {fx_category} UNION ALL SELECT id, parent_id, 1 FROM {fx_category} WHERE parent_id IS NOT NULL
UNION ALL SELECT c.id, p.parent_id, 2 FROM {fx_category} c JOIN {fx_category} p ON p.id = c.parent_id WHERE p.parent_id IS NOT NULL""")


@query("l5_in_category", "SELECT DISTINCT b.bank_id FROM fx_bank b JOIN fx_question_category l ON l.bank_id = b.bank_id JOIN fx_tw_closure c ON c.id = l.category_id WHERE c.ancestor = 'r2'")
def l5(t):
    return bank.in_category(t.fx_bank, t.fx_question_category, tree.closure(t.fx_category), "r2", check_id=False).select("bank_id")


@query("l5_in_category_only", "SELECT DISTINCT b.bank_id FROM fx_bank b JOIN fx_question_category l ON l.bank_id = b.bank_id WHERE l.category_id = 's3'")
def l5_only(t):
    return bank.in_category(t.fx_bank, t.fx_question_category, tree.closure(t.fx_category), "s3", below=False, check_id=False).select("bank_id")


@query("l6_uncategorized", """
SELECT bank_id FROM fx_bank WHERE bank_id NOT IN (SELECT bank_id FROM fx_question_category WHERE category_id IN (SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 8000))""")
def l6(t):
    living = t.supplier.filter("s_acctbal > 8000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return bank.uncategorized(t.fx_bank, t.fx_question_category, living).select("bank_id")


@query("l7_visible", "SELECT bank_id FROM fx_entry WHERE status = 'public' OR author = 'user3'")
def l7(t):
    return bank.visible(entries(t), "user3").select("bank_id")


@query("l7_visible_links", "SELECT bank_id, category_id FROM fx_question_category WHERE bank_id IN (SELECT bank_id FROM fx_entry WHERE status = 'public' OR author = 'user3')")
def l7_links(t):
    return bank.visible_links(t.fx_question_category, bank.visible(entries(t), "user3"))


@query("l8_restricted", """
SELECT bank_id FROM fx_bank WHERE ord IN (SELECT question_id FROM fx_rating WHERE favorite) AND ord IN (SELECT question_id FROM fx_rating WHERE stars >= 3) AND bank_id IN (SELECT bank_id FROM fx_question_category)""")
def l8(t):
    liked = t.fx_rating.filter("favorite").select(F.col("question_id").cast("string").alias("bank_id"))
    tagged = t.fx_rating.filter("stars >= 3").select(F.col("question_id").cast("string").alias("bank_id"))
    return bank.restricted(t.fx_bank, liked, tagged, t.fx_question_category).select("bank_id")


@query("l9_first_rows", "SELECT bank_id, modified_at, (SELECT count(*) FROM fx_entry) > 100 AS truncated FROM fx_entry ORDER BY modified_at DESC, bank_id LIMIT 100")
def l9(t):
    return bank.page_rows(entries(t).select("bank_id", "modified_at"), [F.desc("modified_at"), "bank_id"], 100)


@query("l9_second_page", """
SELECT bank_id, modified_at, (SELECT count(*) FROM fx_entry) > 120 AS truncated FROM fx_entry ORDER BY modified_at DESC, bank_id LIMIT 60 OFFSET 60""")
def l9_second(t):
    return bank.page_rows(entries(t).select("bank_id", "modified_at"), [F.desc("modified_at"), "bank_id"], 60, 1)


@query("l10_facets", "SELECT tag, count(*) AS n FROM (SELECT ptype AS tag FROM fx_entry UNION ALL SELECT brand FROM fx_entry) WHERE tag <> '' GROUP BY 1")
def l10(t):
    return bank.facets(entries(t))


@query("l11_normalize_variants", "SELECT bank_id, head, created_at FROM fx_tw_head")
def l11(t):
    return heads(t)


@query("l11_corrections", """
SELECT b.bank_id, CASE WHEN h.head = b.bank_id THEN '' ELSE h.head END AS variant_of FROM fx_bank b JOIN fx_tw_head h ON h.bank_id = b.bank_id WHERE b.variant_of <> CASE WHEN h.head = b.bank_id THEN '' ELSE h.head END""")
def l11_corrections(t):
    return variants.corrections(t.fx_bank, heads(t))


@query("l12_members", """
SELECT head, bank_id, row_number() OVER (PARTITION BY head ORDER BY CASE WHEN bank_id = head THEN 0 ELSE 1 END, created_at) - 1 AS place FROM fx_tw_head""")
def l12(t):
    return variants.members(heads(t))


def _attach(t):
    asked = t.supplier.select(((F.col("s_suppkey") * 10) + F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)).cast("string").alias("bank_id"),
                              F.when(F.col("s_suppkey") % 4 == 1, "none").otherwise(((F.col("s_suppkey") * 10) + F.when(F.col("s_suppkey") % 4 == 0, 0).otherwise(6)).cast("string")).alias("head_id"))
    return variants.attach(heads(t), asked)


_ATTACH = """
WITH a AS (SELECT CAST(s_suppkey * 10 + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS bank_id, CASE WHEN s_suppkey % 4 = 1 THEN 'none' ELSE CAST(s_suppkey * 10 + CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 6 END AS VARCHAR) END AS head_id FROM supplier),
j AS (SELECT a.*, o.head AS own, g.head AS target FROM a LEFT JOIN fx_tw_head o ON o.bank_id = a.bank_id LEFT JOIN fx_tw_head g ON g.bank_id = a.head_id),
r AS (SELECT *, CASE WHEN own IS NULL OR target IS NULL THEN 'unknown question' WHEN target = bank_id OR own = target THEN 'already in this group' END AS reason FROM j) """


@query("l13_attach", _ATTACH + """
SELECT bank_id, target AS variant_of FROM r WHERE reason IS NULL UNION ALL SELECT h.bank_id, r.target FROM r JOIN fx_tw_head h ON h.head = r.bank_id AND h.bank_id <> h.head WHERE reason IS NULL""")
def l13(t):
    return _attach(t)["changes"]


@query("l13_attach_refused", _ATTACH + "SELECT bank_id, head_id, reason FROM r WHERE reason IS NOT NULL")
def l13_refused(t):
    return _attach(t)["refused"]


@query("l13_detach", """
SELECT h.bank_id, CASE WHEN h.head = h.bank_id THEN 'refused' ELSE 'detached' END AS outcome FROM fx_tw_head h WHERE h.created_at IN (SELECT s_suppkey * 5 + s_suppkey % 2 FROM supplier)""")
def l13_detach(t):
    asked = t.supplier.select((F.col("s_suppkey") * 5 + F.col("s_suppkey") % 2).cast("string").alias("bank_id"))
    out = variants.detach(heads(t), asked.join(t.fx_bank.select("bank_id"), "bank_id", "left_semi"))
    return out["changes"].select("bank_id", F.lit("detached").alias("outcome")).unionByName(out["refused"].select("bank_id", F.lit("refused").alias("outcome")))


@query("l13_promote_on_delete", """
WITH k AS (SELECT h.* FROM fx_tw_head h JOIN supplier s ON CAST(s_suppkey * 5 AS VARCHAR) = h.head WHERE h.bank_id <> h.head AND h.bank_id NOT IN (SELECT CAST(s_suppkey * 5 AS VARCHAR) FROM supplier)), l AS (SELECT head, arg_min(bank_id, created_at) AS leader FROM k GROUP BY 1)
SELECT k.bank_id, CASE WHEN k.bank_id = l.leader THEN '' ELSE l.leader END AS variant_of FROM k JOIN l ON l.head = k.head""")
def l13_promote(t):
    return variants.promote_on_delete(heads(t), t.supplier.select((F.col("s_suppkey") * 5).cast("string").alias("bank_id")))


@query("l14_fold", """
WITH i AS (SELECT b.bank_id, h.head FROM fx_bank b JOIN fx_tw_head h ON h.bank_id = b.bank_id WHERE b.kind <> 'text')
SELECT i.bank_id, (SELECT count(*) FROM i k WHERE k.head = i.bank_id AND k.bank_id <> k.head) AS n_variants FROM i WHERE i.head = i.bank_id OR i.head NOT IN (SELECT bank_id FROM i)""")
def l14(t):
    return variants.fold(t.fx_bank.filter("kind <> 'text'").select("bank_id"), heads(t))


@query("l14_expand_matches", "SELECT DISTINCT h.head AS bank_id FROM fx_tw_head h JOIN fx_bank b ON b.bank_id = h.bank_id WHERE b.brand = 'Brand#3'")
def l14_expand(t):
    return variants.expand_matches(heads(t), t.fx_bank.filter("brand = 'Brand#3'"))


@query("l15_paths", """
SELECT c.id, 1 + (p.id IS NOT NULL)::INT + (g.id IS NOT NULL)::INT AS depth, concat_ws('/', g.name, p.name, c.name) AS path FROM fx_category c LEFT JOIN fx_category p ON p.id = c.parent_id LEFT JOIN fx_category g ON g.id = p.parent_id""")
def l15(t):
    return tree.paths(t.fx_category, tree.closure(t.fx_category)).select("id", "depth", F.array_join("path", "/").alias("path"))


# chains of ten levels
view("fx_deep_category", """
SELECT concat('p', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_partkey % 10 <> 0 THEN concat('p', CAST(p_partkey - 1 AS STRING)) END AS parent_id,
       p_name AS name, p_size AS position FROM {part}""")
_DEEP = """
WITH RECURSIVE w AS (SELECT id, id AS ancestor, 0 AS distance FROM fx_deep_category
  UNION ALL SELECT w.id, p.parent_id, w.distance + 1 FROM w JOIN fx_deep_category p ON p.id = w.ancestor WHERE p.parent_id IS NOT NULL)"""


@query("l16_deep_closure", f"{_DEEP.strip()} SELECT id, ancestor, distance FROM w")
def l16_deep(t):
    return tree.closure(t.fx_deep_category)


@query("l15_deep_paths", f"""{_DEEP.strip()}
SELECT w.id, CAST(count(*) AS INT) AS depth, string_agg(p.name, '/' ORDER BY distance DESC) AS path FROM w JOIN fx_deep_category p ON p.id = w.ancestor GROUP BY 1""")
def l15_deep(t):
    return tree.paths(t.fx_deep_category, tree.closure(t.fx_deep_category)).select("id", "depth", F.array_join("path", "/").alias("path"))


@query("l16_closure", "SELECT id, ancestor, distance FROM fx_tw_closure")
def l16(t):
    return tree.closure(t.fx_category)


@query("l16_subtree_heights", "SELECT ancestor AS id, max(distance) + 1 AS height FROM fx_tw_closure GROUP BY 1")
def l16_heights(t):
    return tree.subtree_heights(tree.closure(t.fx_category))


@query("l17_check_moves", """
WITH m AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, CASE n_nationkey % 5 WHEN 0 THEN 's' || CAST(n_nationkey AS VARCHAR) WHEN 1 THEN 'zz' WHEN 2 THEN NULL WHEN 3 THEN 'n' || CAST(n_nationkey AS VARCHAR) ELSE 's2' END AS new_parent FROM nation)
SELECT m.id, m.new_parent, CASE WHEN m.new_parent IS NOT NULL AND p.id IS NULL THEN 'unknown parent' WHEN EXISTS (SELECT 1 FROM fx_tw_closure c WHERE c.id = m.new_parent AND c.ancestor = m.id) THEN 'cycle'
  WHEN coalesce((SELECT count(*) FROM fx_tw_closure c WHERE c.id = m.new_parent), 0) + (SELECT max(distance) + 1 FROM fx_tw_closure c WHERE c.ancestor = m.id) > 4 THEN 'too deep' END AS reason
FROM m LEFT JOIN fx_category p ON p.id = m.new_parent""")
def l17(t):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("n"), k.cast("string"))
    target = F.when(k % 5 == 0, F.concat(F.lit("s"), k.cast("string"))).when(k % 5 == 1, "zz").when(k % 5 == 3, name).when(k % 5 == 4, "s2")
    moves = t.nation.select(name.alias("id"), target.alias("new_parent"))
    return tree.check_moves(t.fx_category, moves, tree.closure(t.fx_category), max_depth=4)


view("fx_badtree", """
SELECT id, parent_id, name, position FROM {fx_category} WHERE substr(id, 1, 1) <> 's'
UNION ALL SELECT concat('s', CAST(CASE WHEN s_suppkey % 10 = 2 THEN s_suppkey - 1 ELSE s_suppkey END AS STRING)), CASE s_suppkey % 10 WHEN 3 THEN 'zz' WHEN 4 THEN concat('s', CAST(s_suppkey AS STRING)) WHEN 5 THEN concat('s', CAST(s_suppkey + 1 AS STRING)) WHEN 6 THEN concat('s', CAST(s_suppkey - 1 AS STRING)) ELSE 'n1' END,
  CASE s_suppkey % 10 WHEN 7 THEN 'Same' WHEN 8 THEN ' ' ELSE s_name END, 0 FROM {supplier}""")


@query("l18_validate_nodes", """
WITH n AS (SELECT * FROM fx_badtree), k AS (SELECT s_suppkey AS k FROM supplier)
SELECT 's' || CAST(k AS VARCHAR) AS id, 'duplicate_id' AS violation FROM k WHERE k % 10 = 1 AND k + 1 IN (SELECT k FROM k) UNION ALL SELECT id, 'bad_name' FROM n WHERE trim(name) = ''
UNION ALL SELECT id, 'unknown_parent' FROM n WHERE parent_id = 'zz' UNION ALL SELECT id, 'self_parent' FROM n WHERE parent_id = id
UNION ALL SELECT 's' || CAST(k AS VARCHAR), 'cycle' FROM k WHERE k % 10 IN (5, 6)
UNION ALL SELECT id, 'sibling_name' FROM n WHERE name = 'Same' AND id <> (SELECT min(id) FROM n WHERE name = 'Same')""")
def l18(t):
    return tree.validate_nodes(t.fx_badtree, check_ids=False)


@query("l19_annotate", """
SELECT c.id, c.parent_id, c.name, 1 + (p.id IS NOT NULL)::INT + (g.id IS NOT NULL)::INT AS depth, concat_ws('/', g.name, p.name, c.name) AS path, (SELECT count(*) FROM fx_question_category l WHERE l.category_id = c.id) AS n_direct,
  coalesce(t.n, 0) AS n_total, false AS orphan
FROM fx_category c LEFT JOIN fx_category p ON p.id = c.parent_id LEFT JOIN fx_category g ON g.id = p.parent_id LEFT JOIN (SELECT k.ancestor, count(DISTINCT l.bank_id) AS n FROM fx_tw_closure k JOIN fx_question_category l ON l.category_id = k.id GROUP BY 1) t ON t.ancestor = c.id""")
def l19(t):
    return tree.annotate(t.fx_category, t.fx_question_category).withColumn("path", F.array_join("path", "/"))


view("fx_assigned", """
SELECT CAST(p_partkey AS STRING) AS bank_id, concat('s', CAST(p_size AS STRING), ';zz;n', CAST(p_partkey % 30 AS STRING), ';s', CAST(p_size AS STRING), ';r1') AS cat_text FROM {part}""")


@query("l20_sanitize_assignment", """
SELECT bank_id, coalesce(string_agg(c, ';' ORDER BY pos), '') AS categories FROM (SELECT bank_id, c, min(pos) AS pos FROM (SELECT bank_id, unnest(split(cat_text, ';')) AS c, unnest(range(1, 6)) AS pos FROM fx_assigned) WHERE c IN (SELECT id FROM fx_category) GROUP BY 1, 2) GROUP BY 1""")
def l20(t):
    asked = t.fx_assigned.select("bank_id", F.split("cat_text", ";").alias("categories"))
    return tree.sanitize_assignment(asked, t.fx_category, check_ids=False).select("bank_id", F.array_join("categories", ";").alias("categories"))


@query("l21_create_category", """
WITH a AS (SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'zz' ELSE 'n' || CAST(s_nationkey AS VARCHAR) END AS parent_id, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 4 = 3 THEN upper(s_name) ELSE 'New ' || s_name END AS name FROM supplier)
SELECT a.id, a.parent_id, nullif(a.name, '') AS name, r.reason, CASE WHEN r.reason IS NULL THEN coalesce((SELECT max(position) + 1 FROM fx_category s WHERE s.parent_id IS NOT DISTINCT FROM a.parent_id), 0) END AS position FROM a
JOIN (SELECT a.id, CASE WHEN a.name = '' THEN 'bad name' WHEN a.parent_id = 'zz' THEN 'unknown parent' WHEN EXISTS (SELECT 1 FROM fx_category s WHERE s.parent_id IS NOT DISTINCT FROM a.parent_id AND lower(s.name) = lower(a.name)) THEN 'sibling name' END AS reason FROM a) r ON r.id = a.id""")
def l21(t):
    k = F.col("s_suppkey")
    parent = F.when(k % 4 == 1, "zz").when(k % 4 > 1, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    name = F.when(k % 7 == 0, "").when(k % 4 == 3, F.upper("s_name")).otherwise(F.concat(F.lit("New  "), "s_name"))
    asked = t.supplier.select(F.concat(F.lit("c"), k.cast("string")).alias("id"), parent.alias("parent_id"), name.alias("name"))
    return tree.create_categories(t.fx_category, asked, tree.closure(t.fx_category))


@query("l21_update_category", "SELECT id, CASE WHEN id LIKE 's%' THEN 'r1' ELSE parent_id END AS parent_id, CASE WHEN id LIKE 's%' THEN 'X ' || id ELSE name END AS name, position FROM fx_category")
def l21_update(t):
    moves = t.fx_category.filter("id LIKE 's%'").select("id", F.lit("r1").alias("new_parent"), F.concat(F.lit(" X  "), "id").alias("new_name"))
    return tree.apply_moves(t.fx_category, moves)


def _deleted(t):
    return t.nation.filter("n_regionkey = 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).union(
        t.supplier.filter("s_nationkey = 4").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))


@query("l21_delete_reparent", """
WITH g AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 4)
SELECT c.id, CASE WHEN c.parent_id IN (SELECT id FROM g) THEN (SELECT p.parent_id FROM fx_category p WHERE p.id = c.parent_id) ELSE c.parent_id END AS parent_id, name FROM fx_category c WHERE id NOT IN (SELECT id FROM g)""")
def l21_delete(t):
    return tree.delete_categories(t.fx_category, t.fx_question_category, _deleted(t), "reparent")["nodes"].drop("position")


@query("l21_delete_reparent_links", """
WITH g AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 4)
SELECT DISTINCT bank_id, CASE WHEN category_id IN (SELECT id FROM g) THEN (SELECT p.parent_id FROM fx_category p WHERE p.id = category_id) ELSE category_id END AS category_id FROM fx_question_category""")
def l21_delete_links(t):
    return tree.delete_categories(t.fx_category, t.fx_question_category, _deleted(t), "reparent")["links"]


@query("l21_delete_refused", """
WITH g AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 4)
SELECT id, c AS n_children, q AS n_questions FROM (SELECT g.id, (SELECT count(*) FROM fx_category k WHERE k.parent_id = g.id) AS c, (SELECT count(DISTINCT bank_id) FROM fx_question_category l WHERE l.category_id = g.id) AS q FROM g) WHERE c > 0 OR q > 0""")
def l21_refused(t):
    return tree.delete_categories(t.fx_category, t.fx_question_category, _deleted(t))["refused"]


def _assign(t, remove):
    asked = t.lineitem.select(
        F.when(F.col("l_linenumber") == 1, "none").otherwise(F.col("l_partkey").cast("string")).alias("bank_id"),
        F.when(F.col("l_linenumber") == 2, "zz").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("category_id"))
    return tree.assign_category(t.fx_question_category, t.fx_bank, t.fx_category, asked, remove, check_ids=False)


_ASSIGN = """
WITH a AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'none' ELSE CAST(l_partkey AS VARCHAR) END AS bank_id, CASE WHEN l_linenumber = 2 THEN 'zz' ELSE 's' || CAST(l_suppkey AS VARCHAR) END AS category_id FROM lineitem),
j AS (SELECT a.*, l.bank_id IS NOT NULL AS held, c.id IS NULL AS nocat, b.bank_id IS NULL AS noq FROM a LEFT JOIN fx_question_category l ON l.bank_id = a.bank_id AND l.category_id = a.category_id LEFT JOIN fx_category c ON c.id = a.category_id LEFT JOIN fx_bank b ON b.bank_id = a.bank_id) """


@query("l22_assign_category", _ASSIGN + """
SELECT bank_id, category_id, CASE WHEN nocat THEN 'unknown category' WHEN noq THEN 'unknown question' WHEN held THEN 'unchanged' ELSE 'changed' END AS status FROM j""")
def l22(t):
    return _assign(t, False)["judged"]


@query("l22_remove_category", _ASSIGN + "SELECT bank_id, category_id FROM fx_question_category l WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.bank_id = l.bank_id AND j.category_id = l.category_id AND NOT nocat AND NOT noq)")
def l22_remove(t):
    return _assign(t, True)["links"]


@query("l23_from_blocks", """
WITH s AS (SELECT *, trim(regexp_replace(coalesce(statement, ''), '\\s+', ' ', 'g')) AS st, trim(regexp_replace(coalesce(tex, ''), '\\s+', ' ', 'g')) AS tx FROM fx_block WHERE kind <> 'spacer'),
c AS (SELECT *, nullif(CASE WHEN length(st) > 60 THEN substr(st, 1, 60) || '…' ELSE st END, '') AS cst, nullif(CASE WHEN length(tx) > 60 THEN substr(tx, 1, 60) || '…' ELSE tx END, '') AS ctx FROM s)
SELECT CAST(id AS VARCHAR) AS bank_id, kind, trim(CASE WHEN id % 4 = 1 THEN 'Given' ELSE CASE kind WHEN 'answerbox' THEN coalesce(nullif(title, ''), 'Zone de réponse') WHEN 'text' THEN coalesce(ctx, 'Bloc texte')
  WHEN 'question_qcm' THEN coalesce(cst, nullif(tag, ''), 'QCM') WHEN 'question_open' THEN coalesce(cst, nullif(tag, ''), 'Question ouverte') ELSE coalesce(cst, nullif(tag, ''), 'Question libre') END END) AS title, 'a;b' AS tags, 1 AS version FROM c""")
def l23(t):
    blocks = t.fx_block.select(F.col("id").cast("string").alias("bank_id"), "kind", "statement", "tag", "title", "tex", F.lit("2024-01-01T00:00:00").alias("now"),
                               F.when(F.col("id") % 4 == 1, " Given ").otherwise("  ").alias("given_title"), F.array(F.lit(" a "), F.lit(""), F.lit("b")).alias("tags"))
    return bank.from_blocks(blocks, "project", "someone").select("bank_id", "kind", "title", F.array_join("tags", ";").alias("tags"), "version")


@query("l23_save", "SELECT bank_id, CASE WHEN kind = 'text' THEN 'new ' || title ELSE title END AS title FROM fx_entry UNION ALL SELECT 'x' || bank_id, title FROM fx_entry WHERE kind = 'question_qcm'")
def l23_save(t):
    base = t.fx_entry.select("bank_id", "title", "kind")
    fresh = base.filter("kind = 'text'").withColumn("title", F.concat(F.lit("new "), "title")).unionByName(base.filter("kind = 'question_qcm'").withColumn("bank_id", F.concat(F.lit("x"), "bank_id")))
    return bank.save(base, fresh).drop("kind")


@query("l24_normalize_online", """
SELECT p_partkey, coalesce(s_name, '') AS author, coalesce(c.cats, '') AS categories FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150
LEFT JOIN (SELECT bank_id, string_agg(category_id, ';' ORDER BY category_id) AS cats FROM fx_question_category GROUP BY 1) c ON c.bank_id = CAST(p_partkey AS VARCHAR)""")
def l24(t):
    rows = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("bank_id"), (F.col("p_partkey") % 150).alias("author_id"))
    profiles = t.supplier.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("display_name"))
    return bank.normalize_online(rows, profiles, t.fx_question_category).select("p_partkey", "author", F.array_join("categories", ";").alias("categories"))


def _mapped(t):
    return t.fx_bank.filter("brand = 'Brand#5'").select("bank_id")


_NEWID = "regexp_replace(md5('bank:' || bank_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query("l25_migrate", f"SELECT bank_id, {_NEWID} AS new_id FROM fx_bank WHERE brand <> 'Brand#5'")
def l25(t):
    return bank.migrate(t.fx_bank, _mapped(t)).select("bank_id", "new_id")


@query("l25_migrate_category_conflicts", """
SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'o' || CAST(n_nationkey AS VARCHAR) AS other_id FROM nation WHERE n_regionkey = 3""")
def l25_conflicts(t):
    online = t.fx_category.filter("id LIKE 'r%'").select("id", "parent_id", "name").unionByName(t.nation.filter("n_regionkey = 3").select(
        F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.lower("n_name").alias("name")))
    return bank.migrate_categories(t.fx_category, online)["conflicts"]


@query("l25_create", """
SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, 'r' || CAST(n_regionkey AS VARCHAR) AS parent_id, n_name AS name, CASE WHEN n_regionkey <> 3 THEN 1 END AS level, CASE WHEN n_regionkey = 3 THEN 'sibling name' END AS reason FROM nation
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), s_name, CASE WHEN n_regionkey <> 3 THEN 2 END, CASE WHEN n_regionkey = 3 THEN 'parent refused' END FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def l25_create(t):
    online = t.fx_category.filter("id LIKE 'r%'").select("id", "parent_id", "name").unionByName(t.nation.filter("n_regionkey = 3").select(
        F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.lower("n_name").alias("name")))
    return bank.creation_order(t.fx_category, online)


@query("l25_migrate_evals", f"SELECT {_NEWID} AS question_id, user_id, project_name, n_eval FROM (SELECT CAST(question_id AS VARCHAR) AS bank_id, * FROM fx_eval) WHERE bank_id IN (SELECT bank_id FROM fx_bank WHERE brand <> 'Brand#5')")
def l25_evals(t):
    evals = t.fx_eval.select(F.col("question_id").cast("string").alias("question_id"), "user_id", "project_name", "n_eval")
    return bank.migrate_evals(evals, bank.migrate(t.fx_bank, _mapped(t)))


@query("l26_repoint", f"SELECT l_orderkey, l_linenumber, CASE WHEN m THEN {_NEWID} ELSE bank_id END AS bank_id, m AS patched FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS bank_id, CAST(l_partkey AS VARCHAR) IN (SELECT bank_id FROM fx_bank WHERE brand <> 'Brand#5') AS m FROM lineitem)")
def l26(t):
    blocks = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("bank_id"))
    return bank.repoint(blocks, bank.migrate(t.fx_bank, _mapped(t)))


@query("l27_update_content", "SELECT bank_id, CASE WHEN kind = 'text' THEN upper(title) ELSE title END AS title, CASE WHEN kind = 'text' THEN 2 ELSE 1 END AS version, CASE WHEN kind = 'text' THEN 2000000 ELSE modified_at END AS modified_at FROM fx_entry")
def l27(t):
    stored = entries(t).withColumn("version", F.lit(1)).select("bank_id", "title", "tags", "version", "modified_at")
    changes = entries(t).filter("kind = 'text'").select("bank_id", F.upper("title").alias("title"), F.lit(None).cast("array<string>").alias("tags"), F.lit(2000000).cast("bigint").alias("now"))
    return bank.update_content(stored, changes).drop("tags")


@query("l27_change_status", "SELECT bank_id, CASE WHEN ord % 6 = 0 THEN 'public' WHEN ord % 6 = 1 THEN 'archived' ELSE status END AS status FROM fx_entry")
def l27_status(t):
    stored = t.fx_entry.select("bank_id", "status", "ord")
    changes = stored.filter("ord % 6 < 3").select("bank_id", F.when(F.col("ord") % 6 == 0, "public").when(F.col("ord") % 6 == 1, "archived").otherwise("lost").alias("status"))
    return bank.change_status(stored, changes)["questions"].select("bank_id", "status")


# ------------------------------------------------------------ notifications (M)

view("fx_report", """
SELECT CAST(10000 + c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat('u', CAST(c_custkey AS STRING), '@x.org') END AS email,
  CASE WHEN c_custkey % 11 = 0 THEN 'abs' WHEN c_custkey % 13 = 0 THEN '' ELSE replace(CAST(c_acctbal AS STRING), '.', ',') END AS mark FROM {customer}""")


def _people(t):
    return notify.recipients(t.fx_report, t.fx_roster)


view("fx_tw_recipient", """
SELECT p.id, p.email, p.name AS full_name, r.prenom AS first_name, greatest(CAST(replace(mark, ',', '.') AS DOUBLE), 0) AS score FROM {fx_report} p JOIN {fx_roster} r ON r.id = p.id WHERE trim(p.email) <> '' AND mark NOT IN ('', 'abs')""")


@query("m1_recipients", "SELECT * FROM fx_tw_recipient")
def m1(t):
    return _people(t)


@query("m2_skipped", "SELECT id, name AS full_name, CASE WHEN trim(email) = '' THEN 'no address' WHEN mark = 'abs' THEN 'absent (ABS)' ELSE 'no mark' END AS reason FROM fx_report WHERE trim(email) = '' OR mark IN ('', 'abs')")
def m2(t):
    return notify.skipped(t.fx_report)


@query("m3_announced_max", """
SELECT e.path, CASE WHEN total_max > 0 THEN total_max ELSE least(18.0::DOUBLE, (SELECT sum(coalesce(max, 20) * coalesce(weight, 1)) / sum(coalesce(weight, 1)) FROM fx_grade_col)) END AS max_score FROM (SELECT 'all' AS path, max(total_max) FILTER (total_max > 0) AS total_max FROM fx_exam) e""")
def m3(t):
    columns = t.fx_grade_col.fillna({"max": 20.0, "weight": 1.0})
    return notify.announced_max(t.fx_exam.select("total_max"), columns, 18.0).select(F.lit("all").alias("path"), "max_score")


@query("m3_announced_max_fallback", "SELECT round(least(18.0::DOUBLE, sum(coalesce(max, 20) * coalesce(weight, 1)) / sum(coalesce(weight, 1))), 6) AS max_score FROM fx_grade_col")
def m3_fallback(t):
    columns = t.fx_grade_col.fillna({"max": 20.0, "weight": 1.0})
    return notify.announced_max(t.fx_exam.select(F.lit(0.0).alias("total_max")), columns, 18.0).select(F.round("max_score", 6).alias("max_score"))


@query("m4_messages", """
SELECT id, email, 'Results for ' || first_name AS subject, 'Dear ' || first_name || ', you have ' || regexp_replace(rtrim(printf('%.2f', score), '0'), '\\.$', '') || ' / 31.5 (5$ fee). S' AS body FROM fx_tw_recipient""")
def m4(t):
    return notify.messages(_people(t), "Results for $name", "Dear ${name}, you have $score / $max_score (5$$ fee). $sender", F.lit(31.5), "today", "S")


view("fx_sent", """
SELECT concat('u', CAST(user_id AS STRING), '@x.org') AS email, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM {events} WHERE event_type IN ('error', 'signup')""")


@query("m5_pending", "SELECT id, email FROM fx_tw_recipient WHERE email NOT IN (SELECT email FROM fx_sent WHERE status = 'ok')")
def m5(t):
    return notify.pending(_people(t), t.fx_sent).select("id", "email")


@query("m6_append_log", """
SELECT email, full_name AS name, score, status, substr(detail, 1, 200) AS detail FROM (SELECT *, CASE WHEN score > 5000 THEN 'ok' ELSE 'failed' END AS status, repeat(full_name, 20) AS detail FROM fx_tw_recipient)
UNION ALL SELECT email, full_name, score, 'ok', 'sent again' FROM fx_tw_recipient WHERE score <= 5000""")
def m6(t):
    path = scratch_folder(t.spark, "log")
    status = F.when(F.col("score") > 5000, "ok").otherwise("failed")
    sent = _people(t).select(F.lit("2024-01-01T08:00:00").alias("ts"), "email", F.col("full_name").alias("name"), "score", status.alias("status"), F.repeat("full_name", F.lit(20)).alias("detail"))
    sinks.append_log(sent, path)
    sinks.append_log(sent.filter("status = 'failed'").withColumn("status", F.lit("ok")).withColumn("detail", F.lit("sent again")), path)
    return t.spark.read.parquet(path).drop("ts")


view("fx_call", """
SELECT event_type AS backend, concat('m', CAST(user_id % 4 AS STRING)) AS model, CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, CAST(floor(value) AS BIGINT) AS cache_creation,
  CAST(event_id % 5 AS BIGINT) AS cache_read, CASE WHEN event_id % 3 = 0 THEN value / 1000 END AS cost FROM {events}""")


@query("m7_usage_totals", """
WITH c AS (SELECT *, coalesce(cost, (input_tokens * CASE model WHEN 'm0' THEN 1 WHEN 'm1' THEN 3 ELSE 2 END + output_tokens * CASE model WHEN 'm0' THEN 5 WHEN 'm1' THEN 15 ELSE 10 END) / 1e6) AS k FROM fx_call)
SELECT backend, model, count(*) AS n_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(cache_read) AS BIGINT) AS cache_read, round(sum(k), 6) AS cost
FROM c GROUP BY CUBE (backend, model)""")
def m7(t):
    prices = t.region.filter("r_regionkey < 2").select(
        F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model"), F.when(F.col("r_regionkey") == 0, 1.0).otherwise(3.0).alias("price_in"),
        F.when(F.col("r_regionkey") == 0, 5.0).otherwise(15.0).alias("price_out"))
    return notify.usage_totals(t.fx_call, prices, (2.0, 10.0)).withColumn("cost", F.round("cost", 6))


# ------------------------------------------------------------ quality (O)


@query("o1_layout_consistency", """
WITH l AS (SELECT l_orderkey AS copy, l_linenumber AS q, count(*) AS n_boxes FROM lineitem GROUP BY 1, 2), k AS (SELECT c.copy_key AS copy, q.q, CAST(q.q % 3 + 1 AS BIGINT) AS n_answers FROM fx_copy c JOIN fx_question q ON q.grp IN ('', c.grp))
SELECT * FROM (SELECT coalesce(l.copy, k.copy) AS copy, coalesce(l.q, k.q) AS q, CASE WHEN l.q IS NULL THEN 'missing_in_layout' WHEN k.q IS NULL THEN 'surplus_in_layout' WHEN n_boxes <> n_answers THEN 'box_count' END AS issue, n_boxes, n_answers
 FROM l FULL JOIN k ON k.copy = l.copy AND k.q = l.q) WHERE issue IS NOT NULL""")
def o1(t):
    layout = t.lineitem.groupBy(F.col("l_orderkey").alias("copy"), F.col("l_linenumber").alias("q")).agg(F.count("*").alias("n_boxes"))
    asked = scoring.key_by_copy_group(t.fx_question.select("q", "grp"), t.fx_copy).select("q", "copy_grp")
    carried = t.fx_copy.select(F.col("copy_key").alias("copy"), F.col("grp").alias("copy_grp")).join(asked, "copy_grp")
    return quality.layout_consistency(layout, carried.select("copy", "q", (F.col("q") % 3 + 1).cast("bigint").alias("n_answers")))


@query("o2_roster_check", """
SELECT 'OK' AS level, 'students' AS finding, (SELECT count(*) FROM fx_roster) AS n
UNION ALL SELECT 'WARN', 'homonyms', (SELECT count(DISTINCT nom || ' ' || prenom) FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY ord) AS rn FROM fx_tw_norm) WHERE rn > 1)
UNION ALL SELECT 'WARN', 'collisions', (SELECT count(*) FROM (SELECT right(id, 2) FROM fx_roster GROUP BY 1 HAVING count(*) > 1))""")
def o2(t):
    return quality.roster_check(t.fx_roster, 2)


@query("o3_answer_sheets", """
SELECT copy, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_boxes, min(page) AS first_page, CASE WHEN count(*) = 1 THEN 'OK' ELSE 'WARN' END AS level FROM (SELECT l_orderkey AS copy, l_linenumber % 3 AS page, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def o3(t):
    return quality.answer_sheets(t.lineitem.select(F.col("l_orderkey").alias("copy"), (F.col("l_linenumber") % 3).alias("page")))


@query("o3_version_check", """
WITH r AS (SELECT *, CAST(sum(greatest(1, num_copies)) OVER (PARTITION BY subject ORDER BY ord) AS BIGINT) AS hi FROM fx_version)
SELECT r.subject, r.vid, hi - greatest(1, num_copies) + 1 AS first_copy, hi AS last_copy, round((SELECT sum(max_score) FROM fx_tw_item i WHERE i.grp IN ('', r.grp)), 6) AS total_max,
  CASE WHEN count(*) OVER (PARTITION BY subject) > 1 THEN 'WARN' ELSE 'OK' END AS level FROM r""")
def o3_versions(t):
    totals = scoring.version_total_max(item_key(t), t.fx_version.select("vid", "grp")).select("vid", "total_max")
    ranges = scoring.version_copy_ranges(t.fx_version).select("subject", "vid", "first_copy", "last_copy")
    return quality.version_check(ranges, totals)


@query("o3_printed_code", "SELECT (SELECT count(*) FROM fx_bit) AS n_bits, (SELECT count(*) FROM fx_known_code) AS n_page_ids, 'OK' AS level")
def o3_code(t):
    return quality.printed_code(t.fx_bit, t.fx_known_code)


def _reviewed_import(t):
    letters = F.array(F.lower(F.col("ch")), F.when(F.col("copy_key") % 5 == 0, "Z").otherwise(" a "))
    rows = t.fx_response.join(t.fx_copy.select("copy_key", F.col("student_id")), "copy_key").withColumn("letters", letters)
    return quality.validate_reviewed(rows.select("copy_key", "student_id", "q", "letters"), t.fx_option)


@query("o4_reviewed_warnings", """
SELECT r.copy_key, r.q, 'Z' AS detail, 'letter outside the options' AS warning FROM fx_response r JOIN fx_copy c ON c.copy_key = r.copy_key WHERE r.copy_key % 5 = 0
UNION ALL SELECT DISTINCT c.copy_key, NULL, student_id, 'malformed number' FROM fx_copy c JOIN fx_response r ON r.copy_key = c.copy_key WHERE NOT regexp_full_match(student_id, '[0-9?]{4}')""")
def o4(t):
    return _reviewed_import(t)["warnings"]


@query("o4_reviewed_answers", """
SELECT r.copy_key, c.student_id, r.q, CASE WHEN r.copy_key % 5 = 0 OR r.ch = 'A' THEN r.ch ELSE r.ch || 'A' END AS letters FROM fx_response r JOIN fx_copy c ON c.copy_key = r.copy_key""")
def o4_answers(t):
    return _reviewed_import(t)["answers"].withColumn("letters", F.array_join("letters", ""))


# ------------------------------------------------------------ sources and sinks (A)


def _documents(t):
    """Copies of the exam as the JSON documents they are stored in; one in a hundred is cut short."""
    per = t.fx_tick.groupBy("copy_key", "q").agg(F.array_sort(F.collect_set("ch")).alias("l")).groupBy("copy_key").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("q").cast("string"), "l"))).alias("answers"))
    joined = t.fx_copy.join(per, "copy_key")
    text = F.to_json(F.struct("student_id", "answers", F.array(F.lit("validated")).alias("_flags")))
    path = F.concat(F.lit("root/"), "batch", F.lit("/page_"), F.lpad(F.col("page").cast("string"), 8, "0"), F.lit(".json"))
    return joined.select(path.alias("path"), F.when(F.col("page") % 100 == 0, F.substring(text, 1, 20)).otherwise(text).alias("json"))


@query("a1_read_copies", """
SELECT c.batch, CAST(c.page AS INT) AS page, c.student_id, 'validated' AS flags, r.q, string_agg(r.ch, '' ORDER BY r.ch) AS letters FROM fx_copy c JOIN fx_response r ON r.copy_key = c.copy_key WHERE c.page % 100 <> 0 GROUP BY 1, 2, 3, 5""")
def a1(t):
    copies = documents.parse_copies(_documents(t))["copies"]
    return scoring.explode_answers(copies, ["batch", "page", "student_id", "flags"]).select(
        "batch", "page", "student_id", F.array_join("flags", ";").alias("flags"), "q", F.array_join("letters", "").alias("letters"))


@query("a1_unreadable_copies", "SELECT DISTINCT c.batch, CAST(c.page AS INT) AS page FROM fx_copy c JOIN lineitem ON l_orderkey = c.copy_key WHERE c.page % 100 = 0")
def a1_unreadable(t):
    return documents.parse_copies(_documents(t))["unreadable"].select("batch", "page")


view("fx_line", """
SELECT concat('f', CAST(c_nationkey AS STRING)) AS src, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS line_no,
  CASE c_nationkey % 4 WHEN 0 THEN concat(c_name, ';', CAST(c_acctbal AS STRING), ';', c_mktsegment) WHEN 1 THEN concat(c_name, ',', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ';' ELSE '' END)
   WHEN 2 THEN concat(c_name, '|', c_mktsegment) ELSE c_name END AS line FROM {customer}""")
view("fx_tw_sniff", """
WITH h AS (SELECT * FROM {fx_line} WHERE line_no < 10 AND trim(line) <> ''), d AS (SELECT * FROM (VALUES (0, ';'), (1, ','), (2, chr(9)), (3, '|')) t(i, d)),
c AS (SELECT src, i, d, length(line) - length(replace(line, d, '')) AS n FROM h, d), m AS (SELECT src, i, d, n, count(*) AS k FROM c WHERE n > 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k DESC, n DESC, i) AS rn FROM m)
SELECT s.src, coalesce(b.d, ',') AS delimiter FROM (SELECT DISTINCT src FROM {fx_line}) s LEFT JOIN b ON b.src = s.src AND b.rn = 1""")


@query("a2_sniff_delimiter", "SELECT src, delimiter FROM fx_tw_sniff")
def a2(t):
    return tables.sniff_delimiter(t.fx_line)


@query("a3_split_lines", """
WITH c AS (SELECT l.src, line_no, string_split(line, delimiter) AS c FROM fx_line l JOIN fx_tw_sniff s ON s.src = l.src), w AS (SELECT src, max(len(c)) AS w FROM c GROUP BY 1)
SELECT c.src, line_no AS row_no, w.w AS n_cells, nullif(c[1], '') AS c0, nullif(c[2], '') AS c1 FROM c JOIN w ON w.src = c.src""")
def a3(t):
    out = tables.split_lines(t.fx_line, tables.sniff_delimiter(t.fx_line))
    return out.select("src", "row_no", F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"))


# delimited files with quoted separators, doubled quotes and, in every third row, a line end and a further cell
view("fx_csv", """
SELECT c_custkey AS k, concat(c_name, '; "', c_mktsegment, '"') AS label, CASE WHEN c_custkey % 3 = 0 THEN concat(CAST(c_nationkey AS STRING), '@', c_mktsegment) ELSE '' END AS place FROM {customer}""")


@query("a3_read_table", """
SELECT row_number() OVER (ORDER BY k) - 1 AS row_no, CAST(4 AS BIGINT) AS n_cells, CAST(k AS VARCHAR) AS c0, label AS c1, replace(nullif(place, ''), '@', chr(10)) AS c2, CASE WHEN place <> '' THEN 'end' END AS c3 FROM fx_csv""")
def a3_read(t):
    path = scratch_folder(t.spark, "sheet")
    quoted = F.concat(F.lit('"'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"'))
    rest = F.when(F.col("place") == "", "").otherwise(F.concat(F.lit('"'), F.replace("place", F.lit("@"), F.lit("\n")), F.lit('";end')))
    line = F.concat_ws(";", F.col("k").cast("string"), quoted, rest)
    t.fx_csv.repartitionByRange("k").sortWithinPartitions("k").select(line.alias("value")).write.text(path)
    out = tables.read_table(t.spark, path)
    return out.select("row_no", F.size("cells").cast("bigint").alias("n_cells"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])


@query("a4_select_sheet", "SELECT 'named' AS asked, row_no, line FROM fx_sheet_line WHERE sheet = 'MACHINERY' UNION ALL SELECT 'first', row_no, line FROM fx_sheet_line WHERE sheet = (SELECT min(sheet) FROM fx_sheet_line)")
def a4(t):
    named = tables.select_sheet(t.fx_sheet_line, "MACHINERY").select(F.lit("named").alias("asked"), "row_no", "line")
    return named.unionByName(tables.select_sheet(t.fx_sheet_line).select(F.lit("first").alias("asked"), "row_no", "line"))


def _subjects(t):
    """Subjects as documents of at most twenty blocks: neighbouring parts, in key order."""
    options = t.fx_item_option.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "correct", "pts"))),
                                                          lambda o: F.struct(o["correct"].alias("correct"), o["pts"].alias("bareme"))).alias("answers"))
    joined = t.fx_item.join(options, "q").join(t.part.select(F.col("p_partkey").alias("q"), "p_size"), "q")
    block = F.struct(F.when(F.col("p_size") % 5 == 0, "text").otherwise("question_qcm").alias("kind"), F.col("grp").alias("group"),
                     F.struct(F.concat(F.lit("t"), F.col("q").cast("string")).alias("tag"), "qtype", "value", F.col("lo").cast("string").alias("floor"), "answers").alias("data"))
    subject = F.concat(F.lit("s"), F.floor(F.col("q") / 20).cast("string"))
    return joined.groupBy(subject.alias("subject")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("q", block.alias("b")))), lambda x: x["b"]).alias("blocks"))).alias("json"))


_KEY = """WITH i AS (SELECT 's' || CAST(CAST(floor(i.q / 20) AS BIGINT) AS VARCHAR) AS subject, i.q AS k, qtype, value, lo, grp FROM fx_item i JOIN part ON p_partkey = i.q WHERE p_size % 5 <> 0 AND i.q IN (SELECT q FROM fx_item_option)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY k) AS INT) AS q FROM i) """


@query("a5_answer_key_questions", _KEY + "SELECT subject, q, 't' || CAST(k AS VARCHAR) AS tag, qtype, value, lo, grp FROM n")
def a5(t):
    return documents.answer_key(_subjects(t))["questions"].select("subject", "q", "tag", "qtype", "value", "lo", "grp")


@query("a5_answer_key_options", _KEY + "SELECT n.subject, n.q, CAST(row_number() OVER (PARTITION BY n.k ORDER BY o.pos) AS INT) AS pos, o.correct, o.pts FROM n JOIN fx_item_option o ON o.q = n.k")
def a5_options(t):
    return documents.answer_key(_subjects(t))["options"]


@query("a7_copy_files", """
SELECT copy, 'batch' || any_value(b) AS batch, max(p) AS scan_page FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY ord DESC) AS rn FROM (SELECT o_custkey AS copy, o_orderkey AS ord, substr(o_orderpriority, 1, 1) AS b, CAST(o_orderkey % 500 AS INT) AS p FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 2 = 1)) WHERE rn = 1 GROUP BY 1""")
def a7(t):
    key = F.col("o_orderkey")
    src = F.when(key % 9 == 0, "unreadable.jpg").otherwise(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("_scan.pdf-page-"), (key % 500).cast("string"), F.lit("-x.jpg")))
    return tables.copy_files(t.orders.select(F.col("o_custkey").alias("copy"), key.alias("ord"), src.alias("src"), (key % 2).alias("page")))


view("fx_file", """
SELECT o_custkey AS project, CASE o_orderkey % 7 WHEN 0 THEN 'exam.pdf' WHEN 1 THEN concat('scan', CAST(o_orderkey AS STRING), '.PDF') WHEN 2 THEN 'DOC-sujet.pdf' WHEN 3 THEN 'lot-corrige-v2.pdf' WHEN 4 THEN concat('sujets', CAST(o_orderkey AS STRING), '.pdf') WHEN 5 THEN 'notes.txt' ELSE concat('a', CAST(o_orderkey AS STRING), '.pdf') END AS name FROM {orders}""")


@query("a8_discover_scans", """
WITH e AS (SELECT c_custkey AS project, 'listed' || CAST(c_custkey AS VARCHAR) || '.pdf' AS name FROM customer WHERE c_acctbal > 8000), x AS (SELECT o_custkey AS project, 'a' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS name FROM orders WHERE o_totalprice > 400000)
SELECT project, name FROM (SELECT * FROM e UNION ALL SELECT f.* FROM fx_file f WHERE f.project NOT IN (SELECT project FROM e) AND (name LIKE 'scan%' OR name LIKE 'sujets%' OR name LIKE 'a%')) u WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project = u.project AND x.name = u.name)""")
def a8(t):
    listed = t.customer.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("project"), F.concat(F.lit("listed"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("name"))
    dropped = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("project"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("name"))
    return tables.discover_scans(t.fx_file, listed, dropped)


@query("a11_wide_scores", "SELECT c.batch, c.page, " + ", ".join(
    f"max(sel) FILTER (q = {q}) AS \"Q{q}_selected\", max(correct) FILTER (q = {q}) AS \"Q{q}_correct\", max(score) FILTER (q = {q}) AS \"Q{q}_score\"" for q in range(1, 8)) + """,
  max(CASE WHEN c.page % 50 = 0 THEN 'unreadable' END) AS error FROM fx_tw_score s JOIN fx_copy c ON c.copy_key = s.copy_key GROUP BY 1, 2""")
def a11(t):
    from tallyloom.plans.marks_plans import _card
    details = _card(t).join(t.fx_copy.select("copy_key", "batch", "page"), "copy_key").withColumn("error", F.when(F.col("page") % 50 == 0, "unreadable"))
    return sinks.wide_scores(details, list(range(1, 8)))
