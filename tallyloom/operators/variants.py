"""Groups of question variants: pointers repaired, heads, members and the changes that edits require.

Rows are ``(bank_id, variant_of, created_at)``. A group may be of any size, so its members stay
rows; they are never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import with_rank
from tallyloom.session import durable


def follow(pointers: DataFrame, order: str = "ord") -> DataFrame:
    """``(id, head, cyclic)`` of a table ``(id, next, ord)`` where a row without a valid pointer has ``next = id``.

    Pointer doubling: every round halves what is left of each path, and only rows that have not
    reached a head take part. A round that finishes nobody leaves cycles alone; those are closed on
    their oldest row, once the doubled steps cover all that is left.
    """
    state = durable(pointers.select("id", "next", F.struct(F.col(order).alias("ord"), F.col("id").alias("id")).alias("oldest")))
    heads = state.filter("id = next").select(F.col("id").alias("head"))
    done = durable(state.join(heads, state["next"] == heads["head"]).select("id", "head"))
    active = durable(state.join(heads, state["next"] == heads["head"], "left_anti"))
    left, steps, cyclic_only = active.count(), 1, False
    parts = [done.withColumn("cyclic", F.lit(False))]
    while left and not (cyclic_only and steps >= left):
        jump = active.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("oldest").alias("_o"))
        finished = done.select(F.col("id").alias("next"), "head")
        moved = active.join(jump, "next", "left").join(finished, "next", "left")
        moved = durable(moved.select("id", F.coalesce("_n", "next").alias("next"), F.least("oldest", F.coalesce("_o", "oldest")).alias("oldest"), "head"))
        reached = durable(moved.filter("head IS NOT NULL").select("id", "head"))
        active = durable(moved.filter("head IS NULL").drop("head"))
        now, steps = active.count(), steps * 2
        cyclic_only = cyclic_only or now == left
        if now != left:
            parts.append(reached.withColumn("cyclic", F.lit(False)))
            done = durable(done.unionByName(reached))
        left = now
    if left:
        ring = active.select(F.col("id").alias("next"), F.col("oldest.id").alias("head"))
        parts.append(active.join(ring, "next").select("id", "head", F.lit(True).alias("cyclic")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normalize(rows: DataFrame) -> DataFrame:
    """``(bank_id, head, created_at)``: dead and self pointers make heads, chains are flattened, cycles cut."""
    known = rows.select(F.trim("bank_id").alias("bank_id"), F.trim(F.coalesce("variant_of", F.lit(""))).alias("ptr"), "created_at").filter("bank_id <> ''")
    ids = known.select(F.col("bank_id").alias("ptr"), F.lit(True).alias("_ok"))
    valid = known.join(ids, "ptr", "left").select(
        F.col("bank_id").alias("id"), F.when(F.col("_ok"), F.col("ptr")).otherwise(F.col("bank_id")).alias("next"), F.col("created_at").alias("ord"))
    heads = follow(valid).select(F.col("id").alias("bank_id"), "head")
    return known.select("bank_id", "created_at").join(heads, "bank_id").select("bank_id", "head", "created_at")


def corrections(rows: DataFrame, normal: DataFrame) -> DataFrame:
    """Pointers whose stored value differs from the repaired one."""
    fixed = normal.select("bank_id", F.when(F.col("head") == F.col("bank_id"), "").otherwise(F.col("head")).alias("fixed"))
    return rows.join(fixed, "bank_id").filter(F.trim(F.coalesce("variant_of", F.lit(""))) != F.col("fixed")).select(
        "bank_id", F.col("fixed").alias("variant_of"))


def members(normal: DataFrame) -> DataFrame:
    """Group members in order: the head at 0, then its variants by age."""
    heads = normal.filter("bank_id = head").select("head", "bank_id", F.lit(0).cast("bigint").alias("place"))
    rest = with_rank(normal.filter("bank_id <> head"), ["created_at", "bank_id"], keys=["head"], name="place")
    return heads.unionByName(rest.select("head", "bank_id", "place"))


def attach(normal: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Make ``bank_id`` a variant of ``head_id``; its own variants follow. Only changed rows are returned."""
    own = normal.select("bank_id", F.col("head").alias("_own"))
    target = normal.select(F.col("bank_id").alias("head_id"), F.col("head").alias("_target"))
    judged = requests.join(own, "bank_id", "left").join(target, "head_id", "left")
    reason = F.when(F.col("_own").isNull() | F.col("_target").isNull(), "unknown question") \
        .when((F.col("_target") == F.col("bank_id")) | (F.col("_own") == F.col("_target")), "already in this group")
    judged = judged.withColumn("reason", reason)
    good = judged.filter("reason IS NULL")
    itself = good.select("bank_id", F.col("_target").alias("variant_of"))
    followers = normal.filter("bank_id <> head").join(good.select(F.col("bank_id").alias("head"), F.col("_target").alias("variant_of")), "head")
    return {"changes": itself.unionByName(followers.select("bank_id", "variant_of")),
            "refused": judged.filter("reason IS NOT NULL").select("bank_id", "head_id", "reason")}


def detach(normal: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """A variant becomes a question of its own; a head has nothing to detach."""
    judged = requests.join(normal.select("bank_id", "head"), "bank_id", "left").withColumn(
        "reason", F.when(F.col("head").isNull(), "unknown question").when(F.col("head") == F.col("bank_id"), "head of its group"))
    return {"changes": judged.filter("reason IS NULL").select("bank_id", F.lit("").alias("variant_of")),
            "refused": judged.filter("reason IS NOT NULL").select("bank_id", "reason")}


def promote_on_delete(normal: DataFrame, deleted: DataFrame) -> DataFrame:
    """What to write before heads disappear: the oldest variant leads, the others follow it."""
    kids = normal.filter("bank_id <> head").join(deleted.select(F.col("bank_id").alias("head")).distinct(), "head", "left_semi") \
        .join(deleted.select("bank_id").distinct(), "bank_id", "left_anti")
    leaders = kids.groupBy("head").agg(F.min_by("bank_id", F.struct("created_at", "bank_id")).alias("leader"))
    return kids.join(leaders, "head").select(
        "bank_id", F.when(F.col("bank_id") == F.col("leader"), "").otherwise(F.col("leader")).alias("variant_of"))


def fold(items: DataFrame, normal: DataFrame) -> DataFrame:
    """Heads of the list with the number of their variants in it; a variant whose head is not listed stays.

    The variants themselves are the rows of :func:`members`.
    """
    pointed = items.join(normal.select("bank_id", "head"), "bank_id")
    listed = items.select(F.col("bank_id").alias("head"), F.lit(True).alias("_listed"))
    placed = pointed.join(listed, "head", "left")
    folded = (F.col("bank_id") != F.col("head")) & F.coalesce("_listed", F.lit(False))
    counts = placed.filter(folded).groupBy("head").agg(F.count("*").alias("n_variants")).withColumnRenamed("head", "bank_id")
    return placed.filter(~folded).select(*items.columns).join(counts, "bank_id", "left").fillna(0, ["n_variants"])


def expand_matches(normal: DataFrame, matched: DataFrame) -> DataFrame:
    """Heads of the groups a search touches: a match on a variant brings its group."""
    return normal.join(matched.select("bank_id").distinct(), "bank_id", "left_semi").select(F.col("head").alias("bank_id")).distinct()
