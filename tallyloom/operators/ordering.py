"""Ranks, running sums and neighbours over a total order, without one task holding a whole group.

Rows are range-sorted, so that a key holding a large share of them spreads over many
partitions; only one small row per (partition, key) is then combined to carry the offsets.
The sorted rows are written to the shared checkpoint folder first: positions must not
change if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable

PART, SEQ = "_part", "_seq"


def _sorted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return durable(placed.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(SEQ)))


def _chunk_window(keys: list[str]):
    # one row per (partition, key): at most as many rows in a window as there are partitions
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART)


def with_rank(df: DataFrame, order: list, keys: list[str] = (), name: str = "rank") -> DataFrame:
    """1-based rank in the order of ``order`` inside ``keys`` (``order`` must break every tie)."""
    keys = list(keys)
    rows = _sorted(df, keys, order)
    chunks = rows.groupBy(*keys, PART).agg(F.count("*").alias("_n"), F.min(SEQ).alias("_first"))
    chunks = chunks.withColumn("_before", F.sum("_n").over(_chunk_window(keys)) - F.col("_n"))
    joined = _join_chunks(rows, chunks.drop("_n"), keys)
    rank = (F.col("_before") + F.col(SEQ) - F.col("_first") + 1).cast("bigint")
    return joined.select(*df.columns, rank.alias(name))


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    cond = rows[PART] == chunks[PART]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(chunks[k])
    side = chunks
    joined = rows.join(side, cond, "inner")
    for k in keys:
        joined = joined.drop(side[k])
    return joined.drop(side[PART])


def with_running_sums(df: DataFrame, order: list, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums, ``{new column: summed column}``, in the order of ``order`` inside ``keys``."""
    keys = list(keys)
    rows = _sorted(df, keys, order)
    inside = Window.partitionBy(*keys, PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    chunks = rows.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    chunks = chunks.select(*keys, PART, *[
        (F.sum(f"_t_{k}").over(_chunk_window(keys)) - F.col(f"_t_{k}")).alias(f"_t_{k}") for k in sums])
    local = rows.select("*", *[F.sum(v).over(inside).alias(f"_s_{k}") for k, v in sums.items()])
    joined = _join_chunks(local, chunks, keys)
    return joined.select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_t_{k}")).alias(k) for k in sums])


def with_neighbours(df: DataFrame, order: list, item: str, previous: str, following: str) -> DataFrame:
    """``item`` of the row before and after in one total order."""
    rows = _sorted(df, [], order)
    inside = Window.partitionBy(PART).orderBy(SEQ)
    ends = rows.groupBy(PART).agg(F.min_by(item, SEQ).alias("_head"), F.max_by(item, SEQ).alias("_tail"))
    across = _chunk_window([])
    ends = ends.select(PART, F.lag("_tail").over(across).alias("_tail"), F.lead("_head").over(across).alias("_head"))
    local = rows.select("*", F.lag(item).over(inside).alias("_lag"), F.lead(item).over(inside).alias("_lead"))
    joined = _join_chunks(local, ends, [])
    return joined.select(*df.columns, F.coalesce("_lag", "_tail").alias(previous), F.coalesce("_lead", "_head").alias(following))
