"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are built-in column expressions. Small random trees are grown on labelled rows; every path from a root is a rule, a
conjunction of thresholds. A lasso logistic regression weighs the rules and drops most of them, and what is left is compiled
into one column expression, so scoring is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(text: str | Column) -> dict[str, Column]:
    """Statistics of a whole text (null: empty), by name."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words, lines = F.split(t, "[ \\n]+"), F.split(t, "\\n")
    chars = F.char_length(t).cast("double")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / F.greatest(chars, F.lit(1.0))

    return {
        "stat_log_chars": F.log1p(chars),
        "stat_word_length": chars / n_words,
        "stat_distinct_words": F.size(F.array_distinct(words)) / n_words,
        "stat_distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "stat_words_per_line": F.log1p(n_words / n_lines),
        "stat_upper": share("\\p{Lu}"),
        "stat_digits": share("[0-9]"),
        "stat_sentence_signs": share("[.,;:?]"),
        "stat_other_signs": share("[^\\p{L}\\p{N}\\s.,;:?'\"()-]"),
        "stat_bars": share("[|\\t]"),
    }


@dataclass(frozen=True)
class Settings:
    """max_labelled: rows that the model is fitted on at most; trees, depth: of the forest; lasso: L1 penalty; support: least share of rows on each side of a rule."""

    max_labelled: int = 20_000
    trees: int = 40
    depth: int = 3
    lasso: float = 0.001
    support: float = 0.005
    seed: int = 17


Condition = tuple[int, bool, float]  # statistic, whether it is at most the threshold, threshold


@dataclass(frozen=True)
class Rules:
    """score = logistic(intercept + the weights of the rules that hold)."""

    names: tuple[str, ...]
    intercept: float
    weighted: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(holds(rule, self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...], names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for statistic, low, threshold in rule:
        column = F.col(names[statistic])
        out = out & (column <= threshold if low else column > threshold)
    return out


def paths(node, upper: tuple[Condition, ...] = ()):
    """Every path from the root of a fitted tree, each bound of a statistic at its tightest."""
    if upper:
        tightest: dict[tuple[int, bool], float] = {}
        for statistic, low, threshold in upper:
            known = tightest.get((statistic, low), threshold)
            tightest[statistic, low] = min(known, threshold) if low else max(known, threshold)
        yield tuple(sorted((s, low, t) for (s, low), t in tightest.items()))
    if node.subtreeDepth():
        split = node.split()
        yield from paths(node.leftChild(), (*upper, (split.featureIndex(), True, split.threshold())))
        yield from paths(node.rightChild(), (*upper, (split.featureIndex(), False, split.threshold())))


def fit(labelled: DataFrame, names: tuple[str, ...], label: str, key: str, settings: Settings) -> Rules:
    """Rules fitted on at most ``max_labelled`` rows (by hash of the key) of ``labelled`` with label 0 or 1."""
    sample = (labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), F.xxhash64(key).alias("order"), *names)
              .orderBy("order", "label", *names).limit(settings.max_labelled).collect())
    positive = sum(r.label for r in sample)
    if not 0 < positive < len(sample):
        prior = (positive + 1) / (len(sample) + 2)  # one class or none: its smoothed share is all there is to learn
        return Rules(names, logit(prior), ())
    spark = labelled.sparkSession
    rows = spark.createDataFrame(sample, "label double, order long, " + ", ".join(f"{n} double" for n in names)).coalesce(1)  # bounded; fixed order
    rows = rows.withColumn("features", array_to_vector(F.array(*names)))
    forest = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, featureSubsetStrategy="sqrt", subsamplingRate=0.7, maxBins=64, seed=settings.seed).fit(rows)
    rules = sorted({p for tree in forest.trees for p in paths(tree._java_obj.rootNode())})
    shares = rows.agg(*[F.avg(holds(r, names).cast("double")) for r in rules]).first()
    rules = [r for r, share in zip(rules, shares, strict=True) if settings.support <= share <= 1 - settings.support]
    if not rules:
        return Rules(names, logit(positive / len(sample)), ())
    held = rows.select("label", array_to_vector(F.array(*[holds(r, names).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=settings.lasso, maxIter=100).fit(held)
    weights = model.coefficients.toArray().tolist()
    return Rules(names, model.intercept, tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          held_out: Column | None = None, settings: Settings = Settings()) -> Rules:  # noqa: B008
    """Rules from the labels of rows of ``docs`` that are not held out (see ``is_held_out``; null counts as held out).

    At most ``max_labelled`` labels, by hash of the key, are looked at; those that are null or neither 0 nor 1 never. Without labels
    of both classes the rules give the smoothed share of what there is.
    """
    sample = (labels.select(labels[key].alias("labelled"), labels[label].alias("given")).where("labelled is not null and given in (0, 1)")
              .orderBy(F.xxhash64("labelled"), "given").limit(settings.max_labelled))
    out = is_held_out(key) if held_out is None else held_out
    learnable = docs.select(docs[key].alias(key), docs[text].alias("doc_text")).where(~F.coalesce(out, F.lit(True)))
    # the sample is bounded, so it may be sent to every task; only its texts are measured
    labelled = learnable.join(F.broadcast(sample), F.col(key) == F.col("labelled"))
    names = tuple(statistics("doc_text"))
    return fit(labelled.select(key, "given", *[c.alias(n) for n, c in statistics("doc_text").items()]), names, "given", key, settings)


def is_held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def add_score(docs: DataFrame, rules: Rules, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``threshold``); columns of these names are replaced.

    Inputs of the score are statistics of the text alone. A null text counts as empty and is scored; rows with equal texts get equal
    scores; repeated rows, nulls elsewhere and other columns pass through; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    # generated, so that the optimizer does not copy the statistics into each rule
    measured = docs.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in statistics(text).items()]))))
    return measured.select(*kept, rules.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
