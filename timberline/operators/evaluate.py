"""Quality of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def evaluate_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Confusion counts, precision, recall, F1, false positive rate, severity accuracy."""
    p, a = F.col("p.is_anomaly"), F.col("a.is_anomaly")
    row = predictions.alias("p").join(labels.alias("a"), key).agg(
        F.count("*").alias("total"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"),
        F.count_if(F.col("p.severity") == F.col("a.severity")).alias("severity_correct"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = row.withColumn("_p", _ratio(tp, tp + fp)).withColumn("_r", _ratio(tp, tp + fn))
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    return rated.select(
        "total", "tp", "fp", "tn", "fn", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
        F.round(f1, 4).alias("f1_score"), F.round(_ratio(fp, fp + tn), 4).alias("false_positive_rate"),
        "severity_correct", F.round(_ratio(F.col("severity_correct"), F.col("total")), 4).alias("severity_accuracy"))
