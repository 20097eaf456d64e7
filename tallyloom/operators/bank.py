"""Question bank: search, facets, visibility, upserts and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import CATEGORY_ID, auto_title, fold, is_status, search_text
from tallyloom.operators import variants
from tallyloom.session import durable


def bank_index(questions: DataFrame, evals: DataFrame) -> DataFrame:
    """Browse fields of each question with its search text and totals, ready to be stored."""
    used = evals.filter("n_eval > 0").groupBy(F.col("question_id").cast("string").alias("bank_id")).agg(
        F.sum("n_eval").alias("n_eval"), F.sum("n_perfect").alias("n_perfect"), F.count("*").alias("n_projects"))
    text = search_text("statement", "tex", "tag", "title")
    fields = questions.select("bank_id", "kind", "title", "tags", "author", "modified_at", "created_at", "variant_of", text.alias("text"))
    return fields.join(used, "bank_id", "left").fillna(0, ["n_eval", "n_perfect", "n_projects"])


# ------------------------------------------------------------ filters


def by_kind(kind: str) -> Column:
    return F.col("kind") == kind


def by_author(author: str) -> Column:
    return F.contains(F.lower("author"), F.lit(author.strip().lower()))


def by_tags(tags: list[str]) -> Column:
    wanted = F.array(*[F.lit(t.lower()) for t in tags if t])
    return F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), wanted)


def by_text(needle: str) -> Column:
    """Folded needle in the stored text, or in the folded title and tags."""
    folded = fold(F.lit(needle))
    shown = fold(F.concat_ws(" ", "title", F.array_join("tags", " ")))
    return F.contains("text", folded) | F.contains(shown, folded)


def by_text_online(needle: str) -> Column:
    """Title or statement, case ignored but not accents."""
    wanted = needle.strip().lower()
    return F.contains(F.lower("title"), F.lit(wanted)) | F.contains(F.lower("statement"), F.lit(wanted))


def in_category(questions: DataFrame, links: DataFrame, closed: DataFrame, category: str, below: bool = True, check_id: bool = True) -> DataFrame:
    """Questions of a node, with its subtree unless told otherwise; a malformed identifier raises."""
    import re
    if check_id and not re.match(CATEGORY_ID, category or ""):
        raise ValueError(f"bad category identifier: {category!r}")
    if below:
        nodes = closed.filter(F.col("ancestor") == category).select(F.col("id").alias("category_id"))
        hits = links.join(nodes, "category_id", "left_semi")
    else:
        hits = links.filter(F.col("category_id") == category)
    return questions.join(hits.select("bank_id"), "bank_id", "left_semi")


def uncategorized(questions: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Questions without a living category; links to removed nodes do not count."""
    living = links.join(nodes.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    return questions.join(living.select("bank_id"), "bank_id", "left_anti")


def visible(questions: DataFrame, user: str) -> DataFrame:
    """Public questions and the reader's own."""
    return questions.filter((F.col("status") == "public") | (F.col("author") == user))


def visible_links(links: DataFrame, seen: DataFrame) -> DataFrame:
    return links.join(seen.select("bank_id"), "bank_id", "left_semi")


def restricted(questions: DataFrame, *id_sets: DataFrame) -> DataFrame:
    """Intersection of identifier sets (favourites, a personal tag, a category); an empty set empties it."""
    for ids in id_sets:
        questions = questions.join(ids.select("bank_id"), "bank_id", "left_semi")
    return questions


def list_questions(index: DataFrame, condition: Column | None = None, flat: bool = False) -> DataFrame:
    """Filtered list, newest first: flat, or folded into the groups that a match touches."""
    matched = index if condition is None else index.filter(condition)
    if flat:
        return matched.orderBy(F.desc("modified_at"), "bank_id")
    normal = variants.normalize(index.select("bank_id", "variant_of", "created_at"))
    keep = variants.expand_matches(normal, matched)
    folded = variants.fold(index, normal).join(keep, "bank_id", "left_semi")
    return folded.orderBy(F.desc("modified_at"), "bank_id")


def page_rows(rows: DataFrame, order: list, size: int, number: int = 0) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in the order of ``order``, each row saying whether more follow.

    ``order`` must break every tie, so that pages are disjoint and together give all rows.
    """
    more = rows.agg(F.count("*") > (number + 1) * size)
    return rows.orderBy(*order).offset(number * size).limit(size).withColumn("truncated", more.scalar())


def facets(questions: DataFrame) -> DataFrame:
    """Distinct tags over all the questions, variants included."""
    return questions.select(F.explode("tags").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.lower("tag"), "tag")


# ------------------------------------------------------------ writing


def from_blocks(blocks: DataFrame, project: str, author: str) -> DataFrame:
    """New bank rows from exam blocks: default title, trimmed tags, version 1; other kinds are refused."""
    kinds = ("text", "question_qcm", "question_open", "question_freeform", "answerbox")
    title = F.trim(F.coalesce(F.nullif(F.trim("given_title"), F.lit("")), auto_title("kind", "statement", "tag", "title", "tex")))
    tags = F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != "")
    return blocks.filter(F.col("kind").isin(*kinds)).select(
        "bank_id", "kind", "statement", "tag", "tex", title.alias("title"), tags.alias("tags"), F.lit(author).alias("author"), F.lit("").alias("variant_of"),
        F.lit(1).alias("version"), F.lit(project).alias("source_project"), F.col("now").alias("created_at"), F.col("now").alias("modified_at"))


def save(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the questions of the same identifier, add the others."""
    return stored.join(fresh.select("bank_id"), "bank_id", "left_anti").unionByName(fresh)


def strip_private(data: str) -> Column:
    """Fields of a ``map`` column without the private ones (leading underscore)."""
    return F.map_filter(data, lambda k, v: ~k.startswith("_"))


def normalize_online(rows: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Online rows in the local form: author name and category list joined in."""
    names = profiles.select("author_id", F.col("display_name").alias("author"))
    lists = links.groupBy("bank_id").agg(F.array_sort(F.collect_set("category_id")).alias("categories"))
    return rows.join(names, "author_id", "left").join(lists, "bank_id", "left").withColumn("author", F.coalesce("author", F.lit(""))) \
        .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def migrate(questions: DataFrame, mapping: DataFrame, seed: str = "bank") -> DataFrame:
    """Questions not moved yet with their new, deterministic identifier; running again moves nothing more."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), "bank_id").cast("binary"))
    new_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return questions.filter("bank_id <> ''").join(mapping.select("bank_id"), "bank_id", "left_anti").select(
        "*", new_id.alias("new_id"))


def migrate_categories(nodes: DataFrame, online: DataFrame) -> dict[str, DataFrame]:
    """Nodes to create (identifiers kept) and sibling names already taken by another online node."""
    missing = nodes.join(online.select("id"), "id", "left_anti")
    taken = online.select(F.coalesce("parent_id", F.lit("")).alias("_p"), F.lower("name").alias("_k"), F.col("id").alias("other_id"))
    joined = missing.join(taken, (F.coalesce("parent_id", F.lit("")) == F.col("_p")) & (F.lower("name") == F.col("_k")), "left")
    return {"create": joined.filter("other_id IS NULL").select(*nodes.columns), "conflicts": joined.filter("other_id IS NOT NULL").select("id", "name", "other_id")}


def creation_order(nodes: DataFrame, online: DataFrame) -> DataFrame:
    """``(id, parent_id, name, level, reason)`` of the nodes that are not online yet: a dry run of their creation.

    ``level`` counts the nodes to be made above a node and itself, so creating level after level meets every parent first; it is null
    for what cannot be created, with the reason: a sibling of that name is online, the parent exists nowhere, the node is
    its own ancestor, or a node above is refused. Pointer doubling: a row per node and round, as many rounds as the
    binary logarithm of the depth.
    """
    kept = nodes.select("id", F.nullif("parent_id", F.lit("")).alias("parent_id"), "name").filter("id IS NOT NULL").dropDuplicates(["id"])
    missing = kept.join(online.select("id"), "id", "left_anti")
    conflicts = migrate_categories(kept, online)["conflicts"].select("id", F.lit(True).alias("_taken")).distinct()
    made = missing.select(F.col("id").alias("parent_id"), F.lit(True).alias("_made"))
    there = online.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    placed = missing.join(made, "parent_id", "left").join(there, "parent_id", "left").join(conflicts, "id", "left")
    own = F.when(F.col("_taken"), "sibling name").when(F.col("parent_id").isNotNull() & F.col("_made").isNull() & F.col("_there").isNull(), "unknown parent")
    placed = durable(placed.select("id", "parent_id", "name", own.alias("own"), F.when(F.col("_made"), F.col("parent_id")).alias("up")))
    state = placed.select("id", "up", F.lit(1).cast("bigint").alias("depth"), F.col("own").isNotNull().alias("stopped"))
    rounds = max(1, placed.count()).bit_length()  # a pointer that is still open then goes in a circle
    for _ in range(rounds):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("stopped").alias("_stopped"))
        state = durable(state.join(above, "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("stopped") | F.coalesce("_stopped", F.lit(False))).alias("stopped")))
        if state.filter("up IS NOT NULL").isEmpty():
            break
    reason = F.coalesce("own", F.when(F.col("up").isNotNull(), "cycle"), F.when(F.col("stopped"), "parent refused"))
    return placed.drop("up").join(state, "id").select("id", "parent_id", "name", F.when(reason.isNull(), F.col("depth")).alias("level"), reason.alias("reason"))


def migrate_evals(evals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evaluations carried to the new identifiers."""
    return evals.join(mapping.select(F.col("bank_id").alias("question_id"), "new_id"), "question_id").drop("question_id").withColumnRenamed("new_id", "question_id")


def repoint(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Blocks with old identifiers replaced by the mapped ones."""
    joined = blocks.join(mapping.select("bank_id", "new_id"), "bank_id", "left")
    return joined.withColumn("patched", F.col("new_id").isNotNull()).withColumn("bank_id", F.coalesce("new_id", "bank_id")).drop("new_id")


def update_content(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Edited questions: given fields replace, the version grows, the edit time is set."""
    fresh = changes.select("bank_id", F.col("title").alias("_t"), F.col("tags").alias("_g"), F.col("now").alias("_now"))
    joined = stored.join(fresh, "bank_id", "left")
    hit = F.col("_now").isNotNull()
    return joined.select(*[c for c in stored.columns if c not in ("title", "tags", "version", "modified_at")],
                         F.coalesce("_t", "title").alias("title"), F.coalesce("_g", "tags").alias("tags"),
                         (F.col("version") + hit.cast("int")).alias("version"), F.when(hit, F.col("_now")).otherwise(F.col("modified_at")).alias("modified_at"))


def change_status(stored: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Status changes; unknown states are rejected."""
    good = changes.filter(is_status("status")).select("bank_id", F.col("status").alias("_s"))
    return {"questions": stored.join(good, "bank_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s"),
            "rejected": changes.filter(~is_status("status"))}
