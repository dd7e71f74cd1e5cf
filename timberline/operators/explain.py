"""Explanations from a small table of texts per anomaly type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberline import constants as K
from timberline.functions import text as T
from timberline.session import apart


def explanation_texts(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in K.EXPLANATION_TEXTS.items()]
    rows.append(("", *K.EXPLANATION_DEFAULT))
    return spark.createDataFrame(
        rows, "text_key string, t_summary string, t_causes array<string>, t_remediation array<string>")


def _fill(text: Column, values: dict[str, Column], texts: list[str]) -> Column:
    """Fill the placeholders of ``text``, which is one of the constants ``texts``, in turn."""
    needed = [i for i, name in enumerate(values) if any("{" + name + "}" in t for t in texts)]
    for name, value in list(values.items())[min(needed, default=len(values)):]:
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def _fill_list(name: str, values: dict[str, Column], lists: list[list[str]]) -> Column:
    """``_fill`` for every text of a column of lists. Written out by place: a lambda over the list is interpreted."""
    places = [[texts[i] for texts in lists if i < len(texts)] for i in range(max(map(len, lists)))]
    filled = F.array(*[_fill(F.get(name, F.lit(i)), values, texts) for i, texts in enumerate(places)])
    return F.slice(filled, F.lit(1), F.size(name))


def explain(reports: DataFrame) -> DataFrame:
    """Add summary, possible_causes and remediation."""
    known = F.col("anomaly_type").isin(list(K.EXPLANATION_TEXTS))
    keyed = reports.withColumn("text_key", F.when(known, F.col("anomaly_type")).otherwise(""))
    texts = explanation_texts(reports.sparkSession)  # eight constant rows
    values = {
        "severity": F.col("severity"), "log_level": F.col("log_level"),
        "details": F.col("_details"), "message_preview": F.col("_preview"),
    }
    summaries, causes, steps = zip(*K.EXPLANATION_TEXTS.values(), K.EXPLANATION_DEFAULT)
    return apart(
        keyed.withColumn("_details", F.coalesce(T.blank_to_null(F.col("details")), F.lit(K.NO_DETAILS)))
        .withColumn("_preview", T.truncate("message", 100))
        .join(F.broadcast(texts), "text_key", "left")
        .withColumn("summary", _fill(F.col("t_summary"), values, summaries))
        .withColumn("possible_causes", _fill_list("t_causes", values, causes))
        .withColumn("remediation", _fill_list("t_remediation", values, steps))
        .drop("text_key", "t_summary", "t_causes", "t_remediation", "_details", "_preview")
    )


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.5, "Medium").otherwise("Low")


def confidence_texts(explained: DataFrame) -> DataFrame:
    """Add confidence score, label and note, why it matters, technical text and detail levels."""
    score, anomaly = F.col("confidence_score"), F.col("is_anomaly")
    details = F.coalesce(T.blank_to_null(F.col("details")), F.lit(K.NO_DETAILS))
    note = (F.when(~anomaly, K.CONFIDENCE_NOTES["normal"])
            .when(score < 0.5, K.CONFIDENCE_NOTES["low"])
            .when(score < 0.8, K.CONFIDENCE_NOTES["moderate"])
            .otherwise(K.CONFIDENCE_NOTES["high"]))
    technical = F.format_string(
        "Anomaly type: %s. Details: %s. Confidence: %s (%.2f).",
        F.col("anomaly_type"), details, F.col("confidence_label"), score)
    hedge = F.concat(
        F.lit("Insufficient evidence for a definitive cause. Possible issues include: "),
        F.array_join(F.slice("possible_causes", 1, 3), ", "), F.lit(". "))
    return (
        explained.withColumn("confidence_score", F.when(anomaly, F.col("confidence")).otherwise(0.0))
        .withColumn("confidence_label", confidence_label(score))
        .withColumn("confidence_note", note)
        .withColumn("what_happened", F.col("summary"))
        .withColumn("why_it_matters", F.when(
            F.col("severity").isin("HIGH", "CRITICAL"), K.WHY_HIGH).otherwise(K.WHY_OTHER))
        .withColumn("technical_explanation", F.when(score < 0.5, F.concat(hedge, technical)).otherwise(technical))
        .withColumn("detail_levels", F.struct(
            F.col("what_happened").alias("simple"), F.col("technical_explanation").alias("technical"),
            F.struct("anomaly_type", F.col("confidence_score").alias("confidence"), "severity",
                     "details").alias("raw")))
    )


EXPLANATION_FIELDS = [
    "summary", "possible_causes", "remediation", "confidence_note", "confidence_score",
    "confidence_label", "what_happened", "why_it_matters", "technical_explanation", "detail_levels",
]
