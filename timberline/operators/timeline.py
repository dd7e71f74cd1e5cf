"""Zero-filled time buckets with spikes and top events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline import constants as K
from timberline.functions import text as T, timing as M


def reference(rows: DataFrame, reference_time: datetime | None, column: str = "timestamp") -> Column:
    """The end of the period: given, or the latest timestamp of the rows."""
    if reference_time is not None:
        return M.naive(reference_time)
    return rows.agg(F.max(column)).scalar()


def hours_before(ref: Column, hours: int) -> Column:
    return ref - F.expr(f"interval {int(hours)} hours")


def _slots(rows: DataFrame, first: Column, last: Column, minutes: int) -> DataFrame:
    """One row per bucket; their number depends on the period, not on the rows."""
    one = rows.sparkSession.range(1)
    return one.select(F.explode(M.bucket_range(first, last, minutes)).alias("bucket_start"))


def timeline(reports: DataFrame, hours: int = 6, minutes: int = 15,
             reference_time: datetime | None = None) -> DataFrame:
    """Per bucket: count, severity counts, spike flag and the five most severe events."""
    ref = reference(reports, reference_time)
    cutoff = hours_before(ref, hours)
    recent = reports.filter(F.col("timestamp") >= cutoff).withColumn(
        "bucket_start", M.time_bucket("timestamp", minutes))
    counts = recent.groupBy("bucket_start").agg(
        F.count("*").alias("event_count"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITY_RANK])
    ranked = Window.partitionBy("bucket_start").orderBy(F.col("rank").desc(), "line_number", "file")
    top = (
        recent.select("bucket_start", T.severity_rank("severity").alias("rank"), "line_number", "file",
                      T.clip("message", 200).alias("message"), "severity", "severity_score")
        .withColumn("place", F.row_number().over(ranked)).filter("place <= 5")
        .groupBy("bucket_start").agg(F.array_sort(F.collect_list(
            F.struct("place", "line_number", "message", "severity", "severity_score"))).alias("top_events")))
    slots = _slots(reports, M.time_bucket(cutoff, minutes), M.time_bucket(ref, minutes), minutes)
    filled = slots.join(counts, "bucket_start", "left").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0)))
    spread = filled.agg(F.struct(
        F.avg("event_count").alias("mean"), F.stddev_samp("event_count").alias("std"),
        F.sum("event_count").alias("total"))).scalar()
    per_severity = F.map_from_arrays(
        T.lit_array(list(K.SEVERITY_RANK)), F.array(*[F.coalesce(F.col(s), F.lit(0)) for s in K.SEVERITY_RANK]))
    s = F.col("_s")
    return (
        filled.withColumn("_s", spread).filter(s["total"] > 0).join(top, "bucket_start", "left")
        .select(
            "bucket_start", F.timestamp_add("MINUTE", F.lit(minutes), F.col("bucket_start")).alias("bucket_end"),
            "event_count", F.map_filter(per_severity, lambda _, v: v > 0).alias("severity_counts"),
            F.coalesce((s["std"] > 0) & ((F.col("event_count") - s["mean"]) / s["std"] >= 2.0),
                       F.lit(False)).alias("is_spike"),
            "top_events")
        .orderBy("bucket_start")
    )


def spike_markers(buckets: DataFrame) -> DataFrame:
    return buckets.select("bucket_start", "is_spike")


def log_volume_trend(reports: DataFrame, hours: int = 24, minutes: int = 15,
                     reference_time: datetime | None = None) -> DataFrame:
    """Rows per bucket from the first to the last bucket that has any."""
    cutoff = hours_before(reference(reports, reference_time), hours)
    counts = (reports.filter(F.col("timestamp") >= cutoff)
              .groupBy(M.time_bucket("timestamp", minutes).alias("bucket_start"))
              .agg(F.count("*").alias("count")))
    ends = counts.agg(F.struct(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b"))).scalar()
    slots = _slots(reports, ends["a"], ends["b"], minutes)
    return slots.join(counts, "bucket_start", "left").select(
        "bucket_start", F.coalesce("count", F.lit(0)).alias("count")).orderBy("bucket_start")
