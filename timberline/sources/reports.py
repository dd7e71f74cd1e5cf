"""Stored reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberline import constants as K
from timberline.operators.explain import EXPLANATION_FIELDS
from timberline.operators.timeline import hours_before, reference

_EXPLANATION = (
    "summary string, possible_causes array<string>, remediation array<string>, confidence_note string, "
    "confidence_score double, confidence_label string, what_happened string, why_it_matters string, "
    "technical_explanation string")


def log_rows(reports: DataFrame, created_at: Column) -> DataFrame:
    """The stored columns, the explanation as JSON text, plus ip, code and file."""
    return reports.select(
        "timestamp", "log_level", "message", "source", "file", "line_number", "ip_address", "error_code",
        F.col("confidence").alias("anomaly_score"), "severity",
        F.to_json(F.struct(*EXPLANATION_FIELDS)).alias("explanation"), created_at.alias("created_at"),
        F.to_date("timestamp").alias("event_date"))


def write_reports(reports: DataFrame, path: str, created_at: Column, mode: str = "append") -> None:
    """Append to a table partitioned by day.

    The rebalance step gives each day few files of even size and splits a day that holds
    much more than the others.
    """
    rows = log_rows(reports, created_at).hint("rebalance", "event_date")
    rows.write.mode(mode).partitionBy("event_date").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent_reports(stored: DataFrame, hours: int = 24, reference_time: datetime | None = None) -> DataFrame:
    """Rows created lately, oldest event first, with the fields a stored row stands for."""
    cutoff = hours_before(reference(stored, reference_time, "created_at"), hours)
    level, severity = F.col("log_level"), F.col("severity")
    return (
        stored.filter(F.col("created_at") >= cutoff)
        .select(
            "file", "line_number", "timestamp", F.col("message").alias("raw"), "message",
            F.coalesce("source", F.lit("")).alias("source"),
            F.when(level.isin(K.LOG_LEVELS), level).otherwise("UNKNOWN").alias("log_level"),
            F.when(severity.isin(list(K.SEVERITY_RANK)), severity).otherwise("LOW").alias("severity"),
            (F.col("anomaly_score") > 0.5).alias("is_anomaly"), F.col("anomaly_score").alias("confidence"),
            F.col("anomaly_score").alias("severity_score"),
            F.from_json("explanation", _EXPLANATION).alias("explanation"))
        .orderBy(F.col("timestamp").asc_nulls_first(), "file", "line_number")
    )


def report_json(reports: DataFrame) -> DataFrame:
    """(file, line_number, json): the full nested report as text."""
    entry = F.struct(
        "raw", "line_number", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "log_level", "message", "source", "ip_address", "username", "error_code", "log_type")
    anomaly = F.struct("is_anomaly", "confidence", "anomaly_type", "rule_score", "ml_score",
                       F.col("stat_score").alias("statistical_score"), "details")
    severity = F.struct(F.col("severity").alias("level"), F.col("severity_score").alias("score"), "breakdown")
    whole = F.struct(entry.alias("log_entry"), anomaly.alias("anomaly"), severity.alias("severity"),
                     F.struct(*EXPLANATION_FIELDS).alias("explanation"))
    return reports.select("file", "line_number", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))
