"""Fuzzy name matching with the Ratcliff-Obershelp ratio, without comparing every pair.

The ratio cannot exceed 2*m/(la+lb), m being the number of characters two names have in
common (with repeats). A pair can reach the cutoff only if m is large enough, so names are
turned into (character, occurrence) tokens, sorted rarest first, and only the head of each
list needs to share a token (the classical prefix filter). The edit distance bounds the ratio too,
as a common part of m characters leaves at least la+lb-2*m edits. Neither filter loses a pair. Best
matches take the pairs of a read by falling bound: once ``n`` are found, their least ratio is the limit
that a bound must reach, so few pairs come to the exact ratio. Far below a level, reads that found
enough above it are done first.
"""

from __future__ import annotations

import difflib
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import norm_name
from tallyloom.session import durable

# Tuning constant: letters of normalised names from rare to frequent; only speed depends on it.
RARITY = "kwxyzjqfvbhgpmcdulotrnisae "
# Tuning constants: cutoffs tried before one that is lower by ``STEP`` or more (nearer ones cost a pass and save little);
# results do not depend on them.
LEVELS = (0.8, 0.6)
STEP = 0.19


def ratio(left: str, right: str):
    """Similarity of two text columns as the standard library measures it (argument order matters)."""

    # defined here so that it travels to the executors by value
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        out, matcher, last = [], difflib.SequenceMatcher(), None
        for a, b in zip(left, right):
            if b != last:
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(measure, T.DoubleType())(left, right)


def _prepare(names: DataFrame, column: str, cutoff: float, tag: str) -> DataFrame:
    name = F.col(column)
    size = F.length(name)
    place = F.sequence(F.lit(1), size)

    def token(i):
        char = F.substring(name, i, F.lit(1))
        nth = i - F.length(F.replace(F.substring(name, F.lit(1), i), char, F.lit("")))
        return (999 - nth) * 100 + F.instr(F.lit(RARITY), char)

    tokens = F.array_sort(F.transform(place, token))
    length = F.col(f"{tag}_len")
    needed = F.ceil(length * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int")
    return names.select(name.alias(f"{tag}_name"), size.alias(f"{tag}_len"), tokens.alias(f"{tag}_tok")) \
        .withColumn(f"{tag}_head", F.slice(f"{tag}_tok", F.lit(1), (length - needed + 1).cast("int")))


def candidate_pairs(reads: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """``(read, known, bound)``: the pairs of distinct normalised names whose bounds allow the cutoff; the ratio is at most ``bound``."""
    a = _prepare(reads.select("read").filter("read <> ''").distinct(), "read", cutoff, "a")
    b = _prepare(known.select("known").filter("known <> ''").distinct(), "known", cutoff, "b")
    # the admissible lengths join by equality too: a frequent token is split by length, and what is still large by the engine
    low = F.ceil(F.col("a_len") * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int")
    high = F.floor(F.col("a_len") * F.lit((2 - cutoff) / cutoff) + 1e-9).cast("int")
    a = a.withColumn("tok", F.explode("a_head")).withColumn("b_len", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    b = b.withColumn("tok", F.explode("b_head"))
    pairs = a.join(b, ["tok", "b_len"])
    # keep a pair only at its first shared token, then the bounds
    first = F.get(F.array_intersect("a_head", "b_head"), F.lit(0))
    both = F.col("a_len") + F.col("b_len")
    common = F.size(F.array_intersect("a_tok", "b_tok"))
    edits = F.levenshtein("a_name", "b_name")
    enough = common >= both * F.lit(cutoff / 2) - 1e-9
    close = edits <= both * F.lit(1 - cutoff) + 1e-9
    return pairs.filter((F.col("tok") == first) & enough).filter(close).select(
        F.col("a_name").alias("read"), F.col("b_name").alias("known"), (F.least(common * 2, both - edits) / both).alias("bound"))


def similar_pairs(reads: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """``(read, known, rank_score)`` for the pairs of distinct normalised names at or above ``cutoff``."""
    # pairs are distinct, so they spread evenly for the scoring, whatever token brought them together
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = candidate_pairs(reads, known, cutoff).select("read", "known").repartition(parts, "read", "known")
    return pairs.withColumn("rank_score", ratio("known", "read")).filter(F.col("rank_score") >= cutoff)


def best_pairs(pairs: DataFrame, n: int, cutoff: float) -> DataFrame:
    """``(read, known, rank_score, rank, score)``: the ``n`` best of each read at or above ``cutoff``, ties to the larger text.

    The pairs of a read are streamed through one task by falling ``bound`` and only ``n`` of them are held; reads
    are distinct, so none has more pairs than there are known names. ``score`` is measured the other way round, on the kept ones.
    """

    def rising(batches):
        matcher, read, best = difflib.SequenceMatcher(), None, []

        def finished():
            rows = []
            for rank, (value, known) in enumerate(sorted(best, reverse=True), 1):
                rows.append((read, known, value, rank, difflib.SequenceMatcher(None, read, known).ratio()))
            return rows

        for batch in batches:
            out = []
            for name, known, bound in zip(batch["read"], batch["known"], batch["bound"]):
                if name != read:
                    out += finished()
                    read, best = name, []
                    matcher.set_seq2(name)
                # an equal bound may still win by its text
                if len(best) == n and bound < best[0][0] - 1e-9:
                    continue
                matcher.set_seq1(known)
                value = matcher.ratio()
                if value < cutoff:
                    continue
                if len(best) < n:
                    heapq.heappush(best, (value, known))
                else:
                    heapq.heappushpop(best, (value, known))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(finished(), columns=columns)

    columns = ["read", "known", "rank_score", "rank", "score"]
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartition(parts, "read").sortWithinPartitions("read", F.desc("bound"))
    return ordered.mapInPandas(rising, "read string, known string, rank_score double, rank int, score double")


def closest(reads: DataFrame, known: DataFrame, n: int, cutoff: float) -> DataFrame:
    """The ``n`` best known names of each distinct read name, ties to the larger text.

    All pairs above a level are known when it is done, so ``n`` matches above it are final.
    """
    left, found = reads.select("read").distinct(), None
    for level in [c for c in LEVELS if c >= cutoff + STEP]:
        best = durable(best_pairs(candidate_pairs(left, known, level), n, level))
        done = best.filter(F.col("rank") == n).select("read")
        left = durable(left.join(done, "read", "left_anti"))
        best = best.join(done, "read", "left_semi")
        found = best if found is None else found.unionByName(best)
    best = best_pairs(candidate_pairs(left, known, cutoff), n, cutoff)
    return best if found is None else found.unionByName(best)


def by_name(raws: DataFrame, index: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """``(raw, id, score)`` of the best student for each distinct raw name; unmatched names are absent."""
    # both sides are used several times: the distinct names are written once
    named = durable(raws.select("raw").distinct().withColumn("read", norm_name("raw")))
    index = durable(index.select("norm", "id"))
    exact = named.join(index.withColumnRenamed("norm", "read"), "read").select("raw", "id", F.lit(1.0).alias("score"))
    left = named.join(index.select(F.col("norm").alias("read")), "read", "left_anti")
    best = closest(left, index.select(F.col("norm").alias("known")), 1, cutoff)
    fuzzy = left.join(best, "read").join(index.withColumnRenamed("norm", "known"), "known").select("raw", "id", "score")
    return exact.unionByName(fuzzy)


def candidates(raws: DataFrame, index: DataFrame, n: int = 5, cutoff: float = 0.4) -> DataFrame:
    """``(raw, rank, id, score)``: the ``n`` closest students of each distinct raw name."""
    named = durable(raws.select("raw").distinct().withColumn("read", norm_name("raw")))
    index = durable(index.select("norm", "id"))
    near = closest(named, index.select(F.col("norm").alias("known")), n, cutoff)
    return named.join(near, "read").join(index.withColumnRenamed("norm", "known"), "known").select("raw", "rank", "id", "score")


def by_edit_distance(raws: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """``(raw, id, distance)``: closest name within ``limit`` edits, all in the JVM.

    Deleting up to ``limit`` characters of both names must give a common text, so deletion
    variants join by equality. Their number grows with the length to the power of ``limit``, so more than two edits are refused.
    """
    if not 0 <= limit <= 2:
        raise ValueError("at most two edits")
    named = durable(raws.select("raw").distinct().withColumn("read", norm_name("raw")).filter("read <> ''"))
    index = durable(index.select("norm", "id"))
    a = _deletions(named.select(F.col("read").alias("name")).distinct(), limit)
    b = _deletions(index.select(F.col("norm").alias("name")).distinct(), limit).withColumnRenamed("name", "known")
    pairs = a.join(b, "variant").select(F.col("name").alias("read"), "known").distinct()
    near = pairs.withColumn("distance", F.levenshtein("read", "known")).filter(F.col("distance") <= limit)
    best = near.groupBy("read").agg(F.min(F.struct("distance", "known")).alias("b"))
    return named.join(best, "read").select("raw", F.col("b.distance").alias("distance"), F.col("b.known").alias("norm")) \
        .join(index, "norm").select("raw", "id", "distance")


def _deletions(names: DataFrame, limit: int) -> DataFrame:
    variants = F.array(F.col("name"))
    for _ in range(limit):
        variants = F.array_distinct(F.flatten(F.transform(variants, lambda v: F.concat(F.array(v), F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))),
            lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))))))
    return names.select("name", F.explode(variants).alias("variant"))
