"""Labels, splits and evaluation of the tick decision; comparison of two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordering import with_rank, with_running_sums
from tallyloom.session import durable

CELL = ["copy_key", "q", "ch"]
# Slices, bins and bands of the reports.
AMBIGUOUS_ZONE, NEAR_MARGIN = (0.20, 0.45), 0.10
RATIO_BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.8), (0.8, 1.0))
BANDS, PROXIMITY = (0.04, 0.06, 0.08, 0.10), 0.08


# ------------------------------------------------------------ labels and splits


def manual_truth(zones: DataFrame) -> DataFrame:
    """Truth of hand-checked zones: the manual mark, else the black share where it was only measured."""
    share = F.try_divide(F.col("black"), F.col("total"))
    truth = F.when(F.col("manual").isin(0, 1), F.col("manual") == 1).when((F.col("manual") == -1) & (F.col("total") > 0), share >= 0.5)
    return zones.filter(F.col("type") == 4).withColumn("truth", truth).filter("truth IS NOT NULL")


def human_labels(copies: DataFrame, current: DataFrame, reviewed: DataFrame, cells: DataFrame) -> DataFrame:
    """Labels of cells a person saw: all of a validated copy, else the reviewed or edited ones.

    ``cells(copy_key, q, ch)`` are the option cells of the copies. All that is known of a cell meets in one aggregation of bits.
    """
    rows = cells.select(*CELL, F.lit(1).alias("s"))
    for source, bit in ((current, 2), (reviewed, 4)):
        rows = rows.unionByName(source.select(*CELL, F.lit(bit).alias("s")))
    has = lambda bit: F.col("s").bitwiseAND(F.lit(bit)) != 0
    known = rows.groupBy(*CELL).agg(F.bit_or("s").alias("s")).filter(has(1))
    joined = known.join(copies.select("copy_key", "validated"), "copy_key").filter(F.col("validated") | has(4))
    return joined.select(*CELL, has(2).cast("int").alias("label"), F.when(F.col("validated"), "ui_validated").otherwise("ui_reviewed").alias("source"))


def label_precedence(human: DataFrame, manual: DataFrame) -> DataFrame:
    """A person's label wins over the old manual truth."""
    old = manual.select(*CELL, F.col("label").alias("_l"))
    return human.join(old, CELL, "full").select(*CELL, F.coalesce("label", "_l").alias("label"), F.coalesce("source", F.lit("amc_manual")).alias("source"))


def build_dataset(labels: DataFrame, features: DataFrame) -> DataFrame:
    return labels.join(features, CELL)


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def split_by_copy(data: DataFrame, test_share: float = 0.20, seed: int = 42) -> DataFrame:
    """Adds ``is_test``; a copy is never split. The first share of the copies in hash order is the test set."""
    copies = data.select("copy_key").distinct().withColumn("_h", hash_order("copy_key", seed))
    ranked = with_rank(copies, ["_h", "copy_key"], name="_rank")
    n_test = F.greatest(F.lit(1), F.floor(F.count("*") * test_share))
    limit = data.select("copy_key").distinct().agg(n_test)
    chosen = ranked.withColumn("is_test", F.col("_rank") <= limit.scalar()).select("copy_key", "is_test")
    return data.join(chosen, "copy_key")


def assign_folds(data: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold of each copy: copies by size then hash, dealt in turn, so that folds are balanced."""
    sizes = data.groupBy("copy_key").agg(F.count("*").alias("n_cells")).withColumn("_h", hash_order("copy_key", seed))
    ranked = with_rank(sizes, [F.desc("n_cells"), "_h", "copy_key"], name="_rank")
    return ranked.select("copy_key", "n_cells", ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def baseline_predict(data: DataFrame) -> DataFrame:
    return data.withColumn("prediction", (F.col("ratio") > F.col("threshold")).cast("int"))


# ------------------------------------------------------------ scores


def _confusion() -> list[Column]:
    t, p = F.col("label") == 1, F.col("prediction") == 1
    return [F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
            F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def _scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = counts.select(
        *keys, "n", "tp", "fp", "fn", "tn", ratio(tp + tn, F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision_filled"),
        ratio(tp, tp + fn).alias("recall_filled"), ratio(tn, tn + fn).alias("precision_empty"), ratio(tn, tn + fp).alias("recall_empty"))
    return out.withColumn("f1_filled", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("f1_empty", ratio(2 * tn, 2 * tn + fp + fn))


def evaluate(predicted: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Accuracy, confusion counts and per-class precision, recall and F1."""
    keys = list(keys)
    return _scores(predicted.groupBy(*keys).agg(*_confusion()) if keys else predicted.agg(*_confusion()), keys)


def evaluate_slices(predicted: DataFrame) -> DataFrame:
    """The same scores on all cells, on the ambiguous zone and near the threshold."""
    slices = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("ratio").between(*AMBIGUOUS_ZONE), "ambiguous"),
        F.when(F.abs(F.col("ratio") - F.col("threshold")) < NEAR_MARGIN, "near")))
    return evaluate(predicted.withColumn("slice", F.explode(slices)), ["slice"])


def benchmark(predicted: DataFrame) -> DataFrame:
    """Match, false positives and negatives overall (null copy) and per copy."""
    hit = F.col("label") == F.col("prediction")
    return predicted.rollup("copy_key").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_match"), F.count_if(~hit & (F.col("prediction") == 1)).alias("n_fp"),
        F.count_if(~hit & (F.col("prediction") == 0)).alias("n_fn")).withColumn("accuracy", F.col("n_match") / F.col("n"))


def worst_copies(report: DataFrame, n: int = 15) -> DataFrame:
    return report.filter("copy_key IS NOT NULL").orderBy("accuracy", "copy_key").limit(n)


def mismatch_bins(predicted: DataFrame) -> DataFrame:
    wrong = predicted.filter(F.col("label") != F.col("prediction"))
    place = F.lit(None).cast("double")
    for low, high in reversed(RATIO_BINS):
        place = F.when((F.col("ratio") >= low) & (F.col("ratio") < high), low).otherwise(place)
    return wrong.withColumn("bin", place).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction") == 1).alias("n_fp"), F.count_if(F.col("prediction") == 0).alias("n_fn"))


# ------------------------------------------------------------ best cut of a measure


def oracle_cuts(cells: DataFrame, measure: str) -> DataFrame:
    """Best single cut of ``measure`` per question: accuracy count and threshold.

    Cells are counted by distinct value first; running counts then give the number of right
    decisions for a cut after each value (or before all of them), without gathering a question.
    """
    valued = cells.filter(F.col(measure).isNotNull() & ~F.isnan(measure)).select("q", F.col(measure).alias("v"), F.col("truth").cast("int").alias("t"))
    counted = valued.groupBy("q", "v").agg(F.count("*").alias("n"), F.sum("t").alias("n_true"))
    totals = counted.groupBy("q").agg(F.sum("n").alias("total"), F.sum("n_true").alias("total_true"), F.min("v").alias("lowest"))
    running = durable(with_running_sums(counted, ["v"], ["q"], {"below": "n", "below_true": "n_true"}))
    cuts = running.join(totals, "q").select(
        "q", F.col("v").alias("cut"), (F.col("below") - F.col("below_true") + F.col("total_true") - F.col("below_true")).alias("right"))
    nothing = totals.select("q", F.lit(None).cast("double").alias("cut"), F.col("total_true").alias("right"))
    # the first best cut wins: the one before every value, then the lowest value
    best = cuts.unionByName(nothing).groupBy("q").agg(F.max(F.struct(
        "right", F.col("cut").isNull().alias("first"), (-F.col("cut")).alias("order"))).alias("b"))
    best = best.select("q", F.col("b.right").alias("n_right"), (-F.col("b.order")).alias("cut"))
    above = running.select("q", "v").join(best, "q").filter(F.col("cut").isNull() | (F.col("v") > F.col("cut"))) \
        .groupBy("q").agg(F.min("v").alias("next"))
    joined = best.join(totals, "q").join(above, "q", "left")
    low = F.coalesce("cut", F.col("lowest") - 1e-6)
    high = F.coalesce("next", F.col("cut") + 1e-6)
    return joined.select("q", F.col("total").alias("n"), "n_right", ((low + high) / 2).alias("threshold"))


def letter_bias(cells: DataFrame, measures: list[str]) -> DataFrame:
    """Mean on empty cells and spread of the per-letter means, for each measure."""
    long = cells.filter("truth = 0").select("ch", F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m))])).alias("measure", "v"))
    long = long.filter(~F.isnan("v"))
    per = long.groupBy("measure", "ch").agg(F.avg("v").alias("m"), F.sum("v").alias("s"), F.count("v").alias("n"))
    return per.groupBy("measure").agg((F.sum("s") / F.sum("n")).alias("mean"), F.stddev_pop("m").alias("letter_sigma"))


def against_cut(cells: DataFrame, measure: str, cuts: DataFrame) -> DataFrame:
    """Decision of one measure with its best cut per question, and the distance to it."""
    joined = cells.filter(~F.isnan(measure)).join(cuts.select("q", "threshold"), "q")
    return joined.select(*CELL, F.col("truth").cast("int").alias("label"), F.col(measure).alias("v"),
                         (F.col(measure) > F.col("threshold")).cast("int").alias("prediction"), F.abs(F.col(measure) - F.col("threshold")).alias("distance"))


def flag_bands(decided: DataFrame) -> DataFrame:
    """Errors caught and cells flagged within each band around the cut."""
    wrong = F.col("label") != F.col("prediction")
    counts = [F.count_if(wrong).alias("n_errors"), F.count("*").alias("n")]
    for i, band in enumerate(BANDS):
        counts += [F.count_if(wrong & (F.col("distance") < band)).alias(f"c{i}"), F.count_if(F.col("distance") < band).alias(f"f{i}")]
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"c{i}").alias("n_caught"), F.col(f"f{i}").alias("n_flagged")) for i, b in enumerate(BANDS)])
    return decided.agg(*counts).select("n_errors", "n", F.explode(rows).alias("r")).select("r.band", "r.n_caught", "r.n_flagged", "n_errors", "n")


def error_nature(decided: dict[str, DataFrame], n_examples: int = 12) -> dict[str, DataFrame]:
    """False positives and negatives of each measure's decisions, with the first examples of each."""
    rows = [own.select(F.lit(measure).alias("measure"), "copy_key", "q", "ch", "label", "prediction") for measure, own in decided.items()]
    wrong = reduce(DataFrame.unionByName, rows).filter(F.col("label") != F.col("prediction")).withColumn("kind", F.when(F.col("prediction") == 1, "FP").otherwise("FN"))
    # the rank limit also runs before the shuffle: each task sends the examples only
    first = Window.partitionBy("measure", "kind").orderBy("q", "ch", "copy_key")
    examples = wrong.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n_examples).select("measure", "kind", "rank", "q", "ch", "copy_key")
    return {"counts": wrong.groupBy("measure", "kind").agg(F.count("*").alias("n")), "examples": examples}


def flag_strategies(new: DataFrame, old: DataFrame, questions: DataFrame) -> DataFrame:
    """Errors covered and cells flagged by structure, disagreement, proximity and their union."""
    joined = new.join(old.select(*CELL, F.col("prediction").alias("_old")), CELL)
    picked = joined.groupBy("copy_key", "q").agg(F.sum("prediction").alias("_n"))
    rows = joined.join(picked, ["copy_key", "q"]).join(questions.select("q", "qtype"), "q", "left")
    error = F.col("label") != F.col("prediction")
    structure = F.coalesce((F.col("qtype") == "single") & (F.col("_n") != 1), F.lit(False))
    disagree, near = F.col("_old") != F.col("prediction"), F.col("distance") < PROXIMITY
    flags = {"structure": structure, "disagreement": disagree, "proximity": near, "union": structure | disagree | near}
    counts = [F.count("*").alias("n"), F.count_if(error).alias("n_errors")]
    for name, flag in flags.items():
        counts += [F.count_if(flag & error).alias(f"c_{name}"), F.count_if(flag).alias(f"f_{name}")]
    lines = F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"c_{k}").alias("n_covered"), F.col(f"f_{k}").alias("n_flagged")) for k in flags])
    return rows.agg(*counts).select("n", "n_errors", F.explode(lines).alias("l")).select("l.strategy", "l.n_covered", "l.n_flagged", "n_errors", "n")


# ------------------------------------------------------------ two runs compared


def snapshot_fields(ref: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """One row per (page, field) that differs, and one per page met on one side only."""
    def side(df, tag):
        return df.select("page_id", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(tag))

    both = side(ref, "a").join(side(new, "b"), "page_id", "full")
    missing = both.filter("a IS NULL OR b IS NULL").select(
        "page_id", F.when(F.col("b").isNull(), "only_ref").otherwise("only_new").alias("field"), F.lit(None).cast("string").alias("ref_value"), F.lit(None).cast("string").alias("new_value"))
    changes = F.array_compact(F.array(*[
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("ref_value"), F.col(f"b.{f}").alias("new_value")))
        for f in fields]))
    changed = both.filter("a IS NOT NULL AND b IS NOT NULL").select("page_id", F.explode(changes).alias("c")).select("page_id", "c.*")
    return missing.unionByName(changed)


def snapshot_summary(differences: DataFrame, n_examples: int = 8) -> DataFrame:
    """Pages per differing field with the first few of them."""
    first = Window.partitionBy("field").orderBy("page_id")
    listed = differences.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n_examples)
    examples = listed.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return differences.groupBy("field").agg(F.count("*").alias("n_pages")).join(examples, "field")


def cell_changes(ref: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (ticked or flagged) present on one side only, added or removed."""
    sides = ref.select(*keys, F.lit(1).alias("s")).unionByName(new.select(*keys, F.lit(2).alias("s")))
    return sides.groupBy(*keys).agg(F.bit_or("s").alias("s")).filter("s <> 3").select(*keys, F.when(F.col("s") == 2, "added").otherwise("removed").alias("change"))


def confidence_changes(ref: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    joined = ref.select(*keys, F.col(value).alias("_a")).join(new.select(*keys, F.col(value).alias("_b")), keys)
    return joined.groupBy(keys[0]).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_change"))


def feature_diff(ref: DataFrame, new: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: largest change and number of changed cells; NaN equals NaN, a one-sided NaN is infinite."""
    joined = ref.select(*CELL, F.struct(*features).alias("a")).join(new.select(*CELL, F.struct(*features).alias("b")), CELL)

    def gap(f):
        a, b = F.col(f"a.{f}"), F.col(f"b.{f}")
        return F.when(F.isnan(a) & F.isnan(b), 0.0).when(F.isnan(a) | F.isnan(b), float("inf")).otherwise(F.abs(a - b))

    long = joined.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), gap(f).alias("d")) for f in features])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.max("d").alias("max_change"), F.count_if(F.col("d") > 0).alias("n_changed"), F.count("*").alias("n_cells"))


def timing_compare(ref: DataFrame, new: DataFrame) -> DataFrame:
    """Cost per page of each stage in both runs, dearest first: ``(stage, ms)`` rows, one per page."""
    def side(df, tag):
        return df.groupBy("stage").agg(F.avg("ms").alias(f"{tag}_mean"), F.min("ms").alias(f"{tag}_min"), F.max("ms").alias(f"{tag}_max"))

    both = side(ref, "ref").join(side(new, "new"), "stage", "full")
    change = 100 * (F.try_divide(F.col("new_mean"), F.col("ref_mean")) - 1)
    return both.withColumn("change_pct", change).orderBy(F.coalesce("ref_mean", "new_mean").desc(), "stage")
