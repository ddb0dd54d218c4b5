"""Evaluation: micro and per-label precision, recall, F1 and precision-recall curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a, b, none):
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), none)


def marks(predictions: DataFrame, gold: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label_id, _p, _g): a row for each label that an example is given or has; _p is 1 if it is given, _g how often it has it."""
    golds = gold.groupBy(id_col, "label_id").agg(F.count("*").alias("_g"))
    given = predictions.select(id_col, "label_id").distinct().withColumn("_p", F.lit(1))
    return given.join(golds, [id_col, "label_id"], "full")


def _counts() -> list:
    return [F.count("_p").alias("predicted"), F.coalesce(F.sum("_g"), F.lit(0)).alias("gold"), F.count(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1)).alias("hits")]


def confusion(predictions: DataFrame, gold: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(label_id, predicted, gold, hits) of predictions (id, label_id, ..) and gold (id, label_id).

    Repeated gold labels count as gold each time but hit once.
    """
    return marks(predictions, gold, id_col).groupBy("label_id").agg(*_counts())


def grouped(predictions: DataFrame, gold: DataFrame, examples: DataFrame, by: list[str], id_col: str = "doc_id", sets: str = "cube") -> DataFrame:
    """Counts, precision, recall and f1 for each label and each group of examples (id_col, *by), and for their combinations, in one pass.

    ``level`` (bits from the last of by and label_id) tells what a row is summed over: 0 is
    a label in a group, all bits set the whole. sets: cube for all combinations, rollup for
    those that drop columns from the right. Predictions and gold of ids that examples lacks
    are left out; a repeated id's groups count each. Null groups are groups; where a sum is
    over a column it is null too, which level tells apart. Ratios without a denominator are
    null. Precision is over the predictions given.
    """
    rows = marks(predictions, gold, id_col).join(examples.select(id_col, *by), id_col)
    keys = [*by, "label_id"]
    sums = getattr(rows, sets)(*keys).agg(F.grouping_id().cast("int").alias("level"), *_counts())
    return per_label(sums).select(*keys, "level", "predicted", "gold", "hits", "precision", "recall", "f1")


def per_label(counts: DataFrame) -> DataFrame:
    """confusion() with precision, recall and f1; null where a denominator is 0."""
    return counts.withColumns({"precision": F.try_divide("hits", "predicted"), "recall": F.try_divide("hits", "gold"), "f1": F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("gold"))})


def micro(counts: DataFrame, n_examples: int, k: int, n_labels: int) -> DataFrame:
    """One row: n, precision, recall, f1. Precision is over min(k, labels) predictions an example; 0 where a denominator is 0."""
    slots = F.lit(n_examples * min(k, n_labels)).cast("double")
    sums = counts.agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("double").alias("hits"), F.coalesce(F.sum("gold"), F.lit(0)).cast("double").alias("gold"))
    return sums.select(F.lit(n_examples).cast("long").alias("n"), _ratio("hits", slots, F.lit(0.0)).alias("precision"), _ratio("hits", "gold", F.lit(0.0)).alias("recall"), _ratio(2 * F.col("hits"), F.col("gold") + slots, F.lit(0.0)).alias("f1"))


def curve(scores: DataFrame, gold: DataFrame, id_col: str = "doc_id", score_col: str = "p") -> DataFrame:
    """(label_id, threshold, precision, recall) for every score of a label, from the highest down to full recall.

    Equal scores are one point; scores below 0 and labels without gold give none.
    """
    marked = scores.where(F.col(score_col) >= 0).join(gold.select(id_col, "label_id").distinct().withColumn("_hit", F.lit(1)), [id_col, "label_id"], "left")
    points = marked.groupBy("label_id", F.col(score_col).alias("threshold")).agg(F.count("_hit").alias("tp"), F.count("*").alias("n"))
    down = Window.partitionBy("label_id").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    golds = gold.groupBy("label_id").agg(F.count("*").alias("gold"))
    run = points.withColumn("tps", F.sum("tp").over(down)).withColumn("ns", F.sum("n").over(down)).join(golds, "label_id")
    return run.where(F.col("tps") - F.col("tp") < F.col("gold")).select("label_id", "threshold", (F.col("tps") / F.col("ns")).alias("precision"), (F.col("tps") / F.col("gold")).alias("recall"))


def precision_at_recall(points: DataFrame, least: float) -> DataFrame:
    """(label_id, value): the best precision among points of at least that recall."""
    return points.where(F.col("recall") >= least).groupBy("label_id").agg(F.max("precision").alias("value"))


def recall_at_precision(points: DataFrame, least: float) -> DataFrame:
    return points.where(F.col("precision") >= least).groupBy("label_id").agg(F.max("recall").alias("value"))


def report(micro_row, k: int) -> str:
    """The three lines of an evaluation, three significant digits."""
    return f"N\t{micro_row['n']}\nP@{k}\t{micro_row['precision']:.3g}\nR@{k}\t{micro_row['recall']:.3g}"


def label_report(rows) -> str:
    """A line for each (label, precision, recall, f1); a missing value is shown as dashes."""
    said = lambda v: "--------" if v is None or math.isnan(v) else f"{v:.6f}"
    return "\n".join(f"F1-Score : {said(r['f1'])}  Precision : {said(r['precision'])}  Recall : {said(r['recall'])}   {r['label']}" for r in rows)
