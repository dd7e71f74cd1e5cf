"""Severity scores and batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberline import constants as K
from timberline.functions import text as T


def frequency_scores(entries: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """Share of errors in the batch, doubled, with a boost for error rows.

    ``batch`` holds the same rows with a shorter lineage, for the two counts.
    """
    is_error = F.col("log_level").isin("ERROR", "CRITICAL")
    counts = (entries if batch is None else batch).agg(F.struct(
        F.count("*").alias("total"), F.count_if(is_error).alias("errors"))).scalar()
    base = T.clamp(F.col("_batch.errors") / F.col("_batch.total") * 2.0)
    return (
        entries.withColumn("_batch", counts)
        .withColumn("frequency_score", F.when(is_error, T.clamp(base + 0.2)).otherwise(base))
        .drop("_batch")
    )


def severity_scores(scored: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """severity, severity_score and breakdown for rows that carry ``confidence``."""
    w = K.SEVERITY_WEIGHTS
    level_base = F.coalesce(T.lookup(F.col("log_level"), K.LEVEL_BASE), F.lit(0.2))
    score = F.col("_score")
    name = F
    for severity, cut in K.SEVERITY_CUTS:
        name = name.when(score >= cut, severity)
    return (
        frequency_scores(scored, batch).withColumn("level_base", level_base)
        .withColumn("_score", T.clamp(
            w["level"] * F.col("level_base") + w["frequency"] * F.col("frequency_score")
            + w["anomaly"] * F.col("confidence")))
        .withColumn("severity", name.otherwise("LOW"))
        .withColumn("severity_score", F.round("_score", 4))
        .withColumn("breakdown", F.struct(
            F.round("level_base", 4).alias("level_base"),
            F.round("frequency_score", 4).alias("frequency_score"),
            F.round("confidence", 4).alias("anomaly_score"),
            F.lit(w["level"]).alias("rule_weight"),
            F.lit(w["frequency"]).alias("frequency_weight"),
            F.lit(w["anomaly"]).alias("anomaly_weight")))
        .drop("_score", "level_base", "frequency_score")
    )


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row: totals, share of anomalies, count per severity."""
    total, hits = F.count("*"), F.count_if("is_anomaly")
    return reports.agg(
        total.alias("total_entries"), hits.alias("anomaly_count"),
        F.when(total > 0, F.round(hits / total * 100, 1)).otherwise(0.0).alias("anomaly_percent"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in K.SEVERITY_RANK])


def anomalous_entries(reports: DataFrame) -> DataFrame:
    """Anomalous rows, most severe first."""
    rank = T.severity_rank("severity")
    return (
        reports.filter("is_anomaly").orderBy(rank.desc(), "file", "line_number")
        .select("file", "line_number", "severity", "anomaly_type",
                T.clip("message", 120).alias("message"), T.clip("raw", 200).alias("raw"))
    )


def top_anomalies(reports: DataFrame, n: int = 5000) -> DataFrame:
    """The n anomalies of highest confidence."""
    return (reports.filter("is_anomaly")
            .orderBy(F.col("confidence").desc(), "file", "line_number").limit(n))
