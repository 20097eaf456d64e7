"""Category tree: closure, checks, annotation and edits. Rows are ``(id, parent_id, name, position)``.

Six levels are a rule for new and moved nodes; what is stored is read whatever its depth. Siblings and subtrees stay
rows whatever their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_name, is_bank_id, is_category_id, sibling_key
from tallyloom.operators.variants import follow
from tallyloom.session import durable

MAX_DEPTH = 6


def _parent():
    return F.nullif("parent_id", F.lit(""))


def closure(nodes: DataFrame) -> DataFrame:
    """``(id, ancestor, distance)`` up to the root, with each node as its own ancestor at distance 0.

    Pointer doubling: every round doubles the distance that is covered, whatever the depth of the tree. A walk that enters a
    cycle meets each node of it once, at its first distance; a parent that does not exist ends the walk.
    """
    base = nodes.select("id", _parent().alias("up")).filter("id IS NOT NULL").distinct()
    jump = durable(base.join(base.select(F.col("id").alias("up")).distinct(), "up", "left_semi").filter("id <> up").select("id", "up"))
    closed, known, reach = durable(base.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct()), None, 1
    while not jump.isEmpty():  # only a cycle keeps pointers open for ever
        size = closed.count()
        if size == known:
            break
        known = size
        further = jump.join(closed.select(F.col("id").alias("up"), "ancestor", "distance"), "up").select(
            "id", "ancestor", (F.col("distance") + reach).alias("distance"))
        closed = durable(closed.unionByName(further).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        jump = durable(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")))
        reach *= 2
    return closed


def paths(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """1-based depth, names from the root and the sort key of prefix order, for each node."""
    info = nodes.select(F.col("id").alias("ancestor"), "name", F.coalesce("position", F.lit(0)).cast("int").alias("position"))
    joined = closed.join(info, "ancestor")
    # one row per level above the node
    chain = F.array_sort(F.collect_list(F.struct(
        (-F.col("distance")).alias("d"), "position", F.lower("name").alias("k"), F.col("ancestor").alias("a"), "name")))
    return joined.groupBy("id").agg(chain.alias("c")).select(
        "id", F.size("c").alias("depth"), F.transform("c", lambda x: x["name"]).alias("path"),
        F.transform("c", lambda x: F.struct(x["position"], x["k"], x["a"])).alias("sort_key"))


def descendants(closed: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    found = closed.join(roots.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return (found if include_self else found.filter("distance > 0")).select("ancestor", "id")


def subtree_heights(closed: DataFrame) -> DataFrame:
    return closed.groupBy(F.col("ancestor").alias("id")).agg((F.max("distance") + 1).alias("height"))


def check_moves(nodes: DataFrame, moves: DataFrame, closed: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Verdict of each move ``(id, new_parent)``: accepted, or the reason of the refusal. A null parent is the root."""
    depths = closed.groupBy("id").agg(F.count("*").alias("depth"))
    info = nodes.select("id", "name", _parent().alias("old_parent"))
    heights = subtree_heights(closed)
    joined = moves.join(info, "id", "left").join(heights, "id", "left") \
        .join(depths.select(F.col("id").alias("new_parent"), F.col("depth").alias("_base")), "new_parent", "left")
    inside = closed.select(F.col("id").alias("new_parent"), F.col("ancestor").alias("id"), F.lit(True).alias("_inside"))
    joined = joined.join(inside, ["new_parent", "id"], "left")
    siblings = nodes.select(_parent().alias("_p"), sibling_key("name").alias("_k"), F.col("id").alias("_other"))
    clash = joined.join(siblings, joined["new_parent"].eqNullSafe(siblings["_p"]) & (sibling_key("name") == F.col("_k")) & (F.col("id") != F.col("_other"))) \
        .select("id", "new_parent").distinct().withColumn("_clash", F.lit(True))
    joined = joined.join(clash.select(F.col("id").alias("_ci"), F.col("new_parent").alias("_cp"), "_clash"),
                         (F.col("id") == F.col("_ci")) & F.col("new_parent").eqNullSafe(F.col("_cp")), "left")
    moved = ~F.col("new_parent").eqNullSafe(F.col("old_parent"))
    reason = F.when(F.col("name").isNull(), "unknown category") \
        .when(moved & F.col("new_parent").isNotNull() & F.col("_base").isNull(), "unknown parent") \
        .when(moved & F.coalesce("_inside", F.lit(False)), "cycle") \
        .when(moved & (F.coalesce("_base", F.lit(0)) + F.col("height") > max_depth), "too deep") \
        .when(F.coalesce("_clash", F.lit(False)), "sibling name")
    return joined.select("id", "new_parent", reason.alias("reason"))


def validate_nodes(nodes: DataFrame, max_depth: int = MAX_DEPTH, check_ids: bool = True) -> DataFrame:
    """Every broken rule as ``(id, violation)``; an empty result is a valid tree."""
    base = nodes.select("id", _parent().alias("parent_id"), "name")
    found = []
    if check_ids:
        found.append(base.filter(~is_category_id("id")).select("id", F.lit("bad_id").alias("violation")))
    found.append(base.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("violation")))
    found.append(base.filter(clean_name("name").isNull()).select("id", F.lit("bad_name").alias("violation")))
    unique = base.groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = unique.select(F.col("id").alias("parent_id"), F.lit(True).alias("_ok"))
    placed = durable(unique.join(known, "parent_id", "left"))
    found.append(placed.filter("parent_id IS NOT NULL AND _ok IS NULL").select("id", F.lit("unknown_parent").alias("violation")))
    found.append(placed.filter("parent_id = id").select("id", F.lit("self_parent").alias("violation")))
    pointers = placed.select("id", F.when(F.col("_ok"), F.col("parent_id")).otherwise(F.col("id")).alias("next"), F.col("id").alias("ord"))
    rooted = follow(pointers)
    found.append(rooted.filter("cyclic").select("id", F.lit("cycle").alias("violation")))
    acyclic = unique.join(rooted.filter("NOT cyclic").select("id"), "id", "left_semi")
    depths = closure(acyclic).groupBy("id").agg(F.count("*").alias("depth"))
    found.append(depths.filter(F.col("depth") > max_depth).select("id", F.lit("too_deep").alias("violation")))
    keyed = base.withColumn("k", sibling_key("name"))
    first = keyed.groupBy("parent_id", "k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    clash = keyed.join(first, keyed["parent_id"].eqNullSafe(first["parent_id"]) & (keyed["k"] == first["k"])).filter(F.col("id") != F.col("first"))
    found.append(clash.select("id", F.lit("sibling_name").alias("violation")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def annotate(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes in prefix order with depth, path, direct questions and distinct questions of the subtree."""
    closed = closure(nodes)
    shape = paths(nodes, closed)
    pairs = links.select("bank_id", F.col("category_id").alias("id")).distinct()
    direct = pairs.groupBy("id").agg(F.count("*").alias("n_direct"))
    # a question met in several subcategories counts once: pairs first, then their number
    total = pairs.join(closed, "id").select("ancestor", "bank_id").distinct().groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_total"))
    known = nodes.select(F.col("id").alias("_up"))
    orphan = nodes.filter(_parent().isNotNull()).join(known, F.col("parent_id") == F.col("_up"), "left_anti").select("id", F.lit(True).alias("orphan"))
    out = nodes.join(shape, "id").join(direct, "id", "left").join(total, "id", "left").join(orphan, "id", "left")
    return out.orderBy(F.coalesce("orphan", F.lit(False)), "sort_key").select(
        "id", "parent_id", "name", "depth", "path", F.coalesce("n_direct", F.lit(0)).alias("n_direct"),
        F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


def sanitize_assignment(questions: DataFrame, nodes: DataFrame, check_ids: bool = True) -> DataFrame:
    """Valid, living categories of each question, without repeats, in order of appearance."""
    long = questions.select("bank_id", F.posexplode("categories").alias("pos", "id"))
    if check_ids:
        long = long.filter(is_category_id("id"))
    kept = long.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("bank_id", "id").agg(F.min("pos").alias("pos"))
    lists = kept.groupBy("bank_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("_c"))
    return questions.join(lists, "bank_id", "left").withColumn("categories", F.coalesce("_c", F.array().cast("array<string>"))).drop("_c")


# ------------------------------------------------------------ edits


def create_categories(nodes: DataFrame, requests: DataFrame, closed: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Verdict and position of each new node ``(id, parent_id, name)``, placed last among its siblings."""
    asked = requests.select("id", _parent().alias("parent_id"), clean_name("name").alias("name"))
    depths = closed.groupBy("id").agg(F.count("*").alias("_depth")).withColumnRenamed("id", "parent_id")
    siblings = nodes.select(_parent().alias("_p"), sibling_key("name").alias("_k"), F.coalesce("position", F.lit(0)).alias("_pos"))
    last = siblings.groupBy("_p").agg(F.max("_pos").alias("_last"))
    taken = siblings.select(F.col("_p").alias("_tp"), "_k").distinct().withColumn("_taken", F.lit(True))
    joined = asked.join(depths, "parent_id", "left").join(last, F.col("parent_id").eqNullSafe(F.col("_p")), "left") \
        .join(taken, F.col("parent_id").eqNullSafe(F.col("_tp")) & (sibling_key("name") == F.col("_k")), "left")
    reason = F.when(F.col("name").isNull(), "bad name") \
        .when(F.col("parent_id").isNotNull() & F.col("_depth").isNull(), "unknown parent") \
        .when(F.coalesce("_depth", F.lit(0)) + 1 > max_depth, "too deep").when(F.col("_taken"), "sibling name")
    return joined.select("id", "parent_id", "name", reason.alias("reason"), F.when(reason.isNull(), F.coalesce(F.col("_last") + 1, F.lit(0))).alias("position"))


def apply_moves(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """New parents and names: ``accepted(id, new_parent, new_name)``; a null name keeps the old one."""
    joined = nodes.join(accepted.withColumn("_hit", F.lit(True)), "id", "left")
    return joined.select("id", F.when(F.col("_hit"), F.col("new_parent")).otherwise(F.col("parent_id")).alias("parent_id"),
                         F.coalesce(clean_name("new_name"), "name").alias("name"), "position")


def delete_categories(nodes: DataFrame, links: DataFrame, removed: DataFrame, mode: str = "refuse") -> dict[str, DataFrame]:
    """Remove nodes; never a question. ``refuse`` keeps non-empty ones, ``reparent`` lifts children and questions.

    The removed nodes are single deletions: none is the parent of another.
    """
    if mode not in ("refuse", "reparent"):
        raise ValueError(f"unknown mode {mode!r}")
    gone = removed.select("id").distinct()
    children = nodes.join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    held = links.join(gone.select(F.col("id").alias("category_id")), "category_id", "left_semi").groupBy(F.col("category_id").alias("id")).agg(F.count_distinct("bank_id").alias("n_questions"))
    sized = gone.join(children, "id", "left").join(held, "id", "left").fillna(0, ["n_children", "n_questions"])
    if mode == "refuse":
        refused = sized.filter("n_children > 0 OR n_questions > 0")
        gone = sized.filter("n_children = 0 AND n_questions = 0").select("id")
    else:
        refused = sized.filter("false")
    target = nodes.join(gone, "id", "left_semi").select(F.col("id").alias("_gone"), _parent().alias("_up"))
    kept = nodes.join(gone, "id", "left_anti").join(target, F.col("parent_id") == F.col("_gone"), "left")
    kept = kept.select("id", F.when(F.col("_gone").isNotNull(), F.col("_up")).otherwise(F.col("parent_id")).alias("parent_id"), "name", "position")
    lifted = links.join(target, F.col("category_id") == F.col("_gone"), "left").select(
        "bank_id", F.when(F.col("_gone").isNotNull(), F.col("_up")).otherwise(F.col("category_id")).alias("category_id"))
    return {"nodes": kept, "links": lifted.filter("category_id IS NOT NULL").distinct(), "refused": refused, "removed": sized.join(gone, "id", "left_semi")}


def assign_category(links: DataFrame, questions: DataFrame, nodes: DataFrame, requests: DataFrame, remove: bool = False,
                    check_ids: bool = True) -> dict[str, DataFrame]:
    """Bulk add or remove ``(bank_id, category_id)``: real changes, skipped and malformed requests."""
    asked = requests.select("bank_id", "category_id").distinct()
    known = questions.select("bank_id").distinct().withColumn("_q", F.lit(True))
    living = nodes.select(F.col("id").alias("category_id")).distinct().withColumn("_c", F.lit(True))
    held = links.select("bank_id", "category_id").distinct().withColumn("_held", F.lit(True))
    joined = asked.join(known, "bank_id", "left").join(living, "category_id", "left").join(held, ["bank_id", "category_id"], "left")
    malformed = ~is_bank_id("bank_id") if check_ids else F.lit(False)
    has = F.coalesce("_held", F.lit(False))
    status = F.when(malformed, "malformed").when(F.col("_c").isNull(), "unknown category").when(F.col("_q").isNull(), "unknown question") \
        .when(has if not remove else ~has, "unchanged").otherwise("changed")
    judged = joined.withColumn("status", status)
    changed = judged.filter("status = 'changed'").select("bank_id", "category_id")
    base = links.select("bank_id", "category_id").distinct()
    new = base.join(changed, ["bank_id", "category_id"], "left_anti") if remove else base.unionByName(changed)
    return {"links": new, "judged": judged.select("bank_id", "category_id", "status")}
