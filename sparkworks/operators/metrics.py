"""Evaluation of predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.operators.ranges import settle
from sparkworks.sources.io import write_csv


def confusion_counts(df: DataFrame, label: str, pred: str, weight: str | None = None) -> DataFrame:
    """Counts of the pairs that occur, each row as often as ``weight`` says: label, pred, n; rows with a null in either are left out."""
    times = F.lit(1) if weight is None else F.col(weight)
    both = df.select(F.col(label).alias("label"), F.col(pred).alias("pred"), times.cast("long").alias("times")).na.drop(subset=["label", "pred"])
    return both.groupBy("label", "pred").agg(F.sum("times").alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, most: int = 1000, weight: str | None = None) -> DataFrame:
    """All pairs of the classes that occur as label or prediction, with their counts, or sums of ``weight`` as whole numbers; more than ``most`` classes raise a ValueError."""
    counts = settle(confusion_counts(df, label, pred, weight))
    names = counts.select(F.col("label").alias("c")).union(counts.select(F.col("pred").alias("c"))).distinct()
    if names.limit(most + 1).count() > most:
        raise ValueError(f"there are more than {most} classes: too many for a matrix")
    grid = names.select(F.col("c").alias("label")).crossJoin(F.broadcast(names.select(F.col("c").alias("pred"))))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class: precision, recall, f1 (0 where undefined) and support."""
    counts = confusion_counts(df, label, pred)
    parts = counts.select(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    parts = parts.unionByName(counts.select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))
    sums = parts.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    scored = sums.withColumn("precision", ratio("hit", "guessed")).withColumn("recall", ratio("hit", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support", "hit")


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and f1."""
    scores = class_scores(df, label, pred)
    total = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(c)
    return scores.agg((F.sum("hit") / total).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def code_errors(df: DataFrame, label: str, pred: str) -> DataFrame:
    """MSE and MAE on numeric class codes."""
    gap = F.col(label).cast("double") - F.col(pred).cast("double")
    return df.agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    scores = class_scores(df, label, pred)
    total = F.sum("support")
    rows = scores.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    summary = scores.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), (F.sum("hit") / total).alias("precision"), (F.sum("hit") / total).alias("recall"), (F.sum("hit") / total).alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *((F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")), total.alias("support")),
        ).alias("rows")
    )
    return rows.unionByName(summary.select(F.explode("rows").alias("r")).select("r.*"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: r2, mse and mae; r2 is null where the label does not vary."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    rows = df.select(y.alias("y"), p.alias("p")).na.drop()
    gap = F.col("y") - F.col("p")
    out = rows.agg(F.sum(gap * gap).alias("se"), F.var_pop("y").alias("v"), F.count("*").alias("n"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))
    return out.select((1 - F.try_divide(F.col("se"), F.col("v") * F.col("n"))).alias("r2"), "mse", "mae")


def evaluate_model(df: DataFrame, label: str, pred: str, kind: str | None = None, name: str = "model", path: str | None = None) -> DataFrame:
    """A one-row report; without ``kind`` two distinct labels or fewer make a classifier. Written as CSV where a path is given."""
    if kind is None:
        kind = "classifier" if len(df.select(label).distinct().limit(3).collect()) <= 2 else "regressor"
    if kind not in ("classifier", "regressor"):
        raise ValueError(f"unknown kind {kind!r}")
    metrics = classification_metrics(df, label, pred) if kind == "classifier" else regression_metrics(df, label, pred)
    out = metrics.select(F.lit(name).alias("model"), F.lit(kind).alias("type"), "*")
    if path:
        write_csv(out, path)
    return out


def residuals(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(pred))


def correct_flags(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.withColumn("correct", F.col(label).eqNullSafe(F.col(pred)))


def correct_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: correct, incorrect and accuracy in percent."""
    hit = F.count_if(F.col(label).eqNullSafe(F.col(pred)))
    return df.agg(hit.alias("correct"), (F.count("*") - hit).alias("incorrect"), (100.0 * hit / F.count("*")).alias("accuracy_pct"))


def predictions_equal(a: DataFrame, b: DataFrame, key: str, pred: str = "prediction") -> bool:
    """Whether two frames have the same keys and predictions."""
    x, y = a.select(F.col(key), F.col(pred).alias("_a")), b.select(F.col(key), F.col(pred).alias("_b"))
    joined = x.withColumn("_x", F.lit(1)).join(y.withColumn("_y", F.lit(1)), key, "full")
    return joined.filter(F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty()


def error_rates(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Mean edit distance over reference length, by character; empty references and nulls are left out."""
    rate = F.levenshtein(F.col(hyp), F.col(ref)) / F.length(ref)
    return df.filter(F.length(ref) > 0).agg(F.avg(rate).alias("cer"))


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_error_rates(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """The same by word."""

    @F.pandas_udf("double")
    def rate(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for refs, hyps in pairs:
            yield pd.Series([edit_distance(r.split(), (h or "").split()) / len(r.split()) for r, h in zip(refs, hyps, strict=True)])

    return df.filter(F.length(F.trim(F.col(ref))) > 0).agg(F.avg(rate(F.col(ref), F.col(hyp))).alias("wer"))
