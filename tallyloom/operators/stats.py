"""Descriptive statistics of series whose groups may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import with_running_sums
from tallyloom.session import durable


def order_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact ``median`` (mean of the two middles) and ``upper_median`` of each group.

    Equal values are counted first, then a distributed running count finds the middle ones:
    no group is held by one task, unlike an exact percentile aggregate.
    """
    return _middles(_counted(df, keys, value), keys)


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))


def _middles(counted: DataFrame, keys: list[str]) -> DataFrame:
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    running = with_running_sums(counted, ["_v"], keys, {"_hi": "_n"})
    joined = running.join(totals, keys) if keys else running.withColumn("_total", totals.scalar())
    low_place = F.floor((F.col("_total") + 1) / 2)
    high_place = F.floor(F.col("_total") / 2) + 1

    def holds(place):
        return (place <= F.col("_hi")) & (place > F.col("_hi") - F.col("_n"))

    middle = joined.filter(holds(low_place) | holds(high_place))
    low, high = F.min("_v"), F.max("_v")
    # one row (both places on one value) or two rows per group
    return middle.groupBy(*keys).agg(((low + high) / 2).alias("median"), high.alias("upper_median"))


def series_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population variance and deviation, median, minimum and maximum per group."""
    # the data is read once: everything follows from the counts of distinct values
    counted = durable(_counted(df, keys, value))
    n = F.sum("_n")
    basics = counted.groupBy(*keys).agg(
        F.coalesce(n, F.lit(0)).alias("n"), (F.sum(F.col("_n") * F.col("_v")) / n).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    mean = F.col("mean") if keys else basics.select("mean").scalar()
    spread = (counted.join(basics.select(*keys, "mean"), keys) if keys else counted).select(
        *keys, "_n", (F.col("_n") * (F.col("_v") - mean) * (F.col("_v") - mean)).alias("_s"))
    spread = spread.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("variance"))
    medians = _middles(counted, keys).drop("upper_median")
    if keys:
        joined = basics.join(spread, keys).join(medians, keys)
    else:
        joined = basics.withColumn("variance", spread.scalar()).withColumn("median", medians.scalar())
    zero = F.lit(0.0)
    return joined.select(*keys, "n", F.coalesce("mean", zero).alias("mean"), F.coalesce("variance", zero).alias("variance"),
                         F.sqrt(F.coalesce("variance", zero)).alias("std"), F.coalesce("median", zero).alias("median"),
                         F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"))
