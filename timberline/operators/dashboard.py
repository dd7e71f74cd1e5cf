"""Search, dashboard aggregates and request metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from timberline import constants as K
from timberline.functions import text as T, timing as M
from timberline.operators.ordered import percentiles
from timberline.operators.timeline import hours_before, reference
from timberline.operators.templates import with_template


def _recent(reports: DataFrame, hours: int | None, reference_time: datetime | None) -> DataFrame:
    if hours is None:
        return reports
    return reports.filter(F.col("timestamp") >= hours_before(reference(reports, reference_time), hours))


# --- search -----------------------------------------------------------------------

def _matching(reports: DataFrame, query: str | None, severity: str | None, start: datetime | None,
              end: datetime | None) -> DataFrame:
    if severity:
        reports = reports.filter(F.col("severity") == severity)
    if start:
        reports = reports.filter(F.col("timestamp") >= M.naive(start))
    if end:
        reports = reports.filter(F.col("timestamp") <= M.naive(end))
    if query:
        reports = reports.filter(F.col("message").ilike(f"%{query}%"))
    return reports


def search_logs(reports: DataFrame, query: str | None = None, severity: str | None = None,
                start: datetime | None = None, end: datetime | None = None, limit: int = 50,
                offset: int = 0) -> DataFrame:
    """One page of matching rows, newest first, with tags, total count and page number."""
    found = _matching(reports, query, severity, start, end)
    total = found.agg(F.count("*")).scalar()
    page = (found.orderBy(F.col("timestamp").desc_nulls_last(), F.col("line_number").desc(), F.col("file").desc())
            .offset(offset).limit(limit))
    return page.withColumns({
        "semantic_tags": T.semantic_tags("message", "source"), "total": total,
        "page": F.lit(offset // limit + 1)})


# --- metrics over stored rows -------------------------------------------------------

def summary_metrics(reports: DataFrame, hours: int = 24, reference_time: datetime | None = None) -> DataFrame:
    """Total, anomalies, rate and count per severity in one pass."""
    total, hits = F.count("*"), F.count_if(F.col("confidence") > 0.5)
    return _recent(reports, hours, reference_time).agg(
        total.alias("total_entries"), hits.alias("anomaly_count"),
        F.when(total > 0, F.round(hits / total * 100, 2)).otherwise(0.0).alias("anomaly_rate"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in K.SEVERITY_RANK])


def top_sources(reports: DataFrame, hours: int = 24, n: int = 5,
                reference_time: datetime | None = None) -> DataFrame:
    """The n most frequent sources; an empty one takes a place and is then dropped."""
    counts = _recent(reports, hours, reference_time).groupBy("source").agg(F.count("source").alias("count"))
    return counts.orderBy(F.col("count").desc(), "source").limit(n).filter("source <> ''")


def error_trend(reports: DataFrame, hours: int = 24, reference_time: datetime | None = None) -> DataFrame:
    """Hourly counts of rows whose severity is ERROR or CRITICAL."""
    return (_recent(reports, hours, reference_time).filter(F.col("severity").isin("ERROR", "CRITICAL"))
            .groupBy(M.time_bucket("timestamp", 60).alias("hour")).agg(F.count("*").alias("count")).orderBy("hour"))


# --- charts -------------------------------------------------------------------------

def severity_percent(reports: DataFrame) -> DataFrame:
    total = reports.agg(F.count("*")).scalar()
    return reports.groupBy("severity").agg(F.count("*").alias("n")).select(
        "severity", (F.col("n") / total * 100.0).alias("percent"))


def top_ips(anomalies: DataFrame, n: int = 5) -> DataFrame:
    """IPs named in most anomalous messages."""
    return (anomalies.select(F.explode(T.all_ips("message")).alias("ip"))
            .groupBy("ip").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "ip").limit(n))


def category_pie(anomalies: DataFrame, n: int = 8) -> DataFrame:
    return (anomalies.groupBy(T.error_category("message").alias("category")).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), "category").limit(n))


def category_heatmap(anomalies: DataFrame, hours: int = 24, minutes: int = 60,
                     reference_time: datetime | None = None) -> DataFrame:
    """Bucket by category counts, zero-filled; one column per category that occurs."""
    names = list(K.ERROR_CATEGORIES) + ["other"]
    counts = (
        _recent(anomalies, hours, reference_time).select(
            M.time_bucket("timestamp", minutes).alias("bucket_start"),
            T.error_category("message").alias("category"))
        .groupBy("bucket_start").pivot("category", names).agg(F.count(F.lit(1))))
    ends = counts.agg(F.struct(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b"))).scalar()
    slots = anomalies.sparkSession.range(1).select(
        F.explode(M.bucket_range(ends["a"], ends["b"], minutes)).alias("bucket_start"))
    return slots.join(counts, "bucket_start", "left").fillna(0, names).orderBy("bucket_start")


def error_type_ranking(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent templates with their share."""
    total = anomalies.agg(F.count("*")).scalar()
    counts = with_template(anomalies).groupBy("template").agg(
        F.count("*").alias("count"), F.min(F.struct("timestamp", "file", "line_number")).alias("seen"))
    return counts.orderBy(F.col("count").desc(), "seen").limit(n).select(
        F.col("template").alias("error_type"), "count", (F.col("count") / total * 100.0).alias("percent"))


def risk_assessment(reports: DataFrame) -> DataFrame:
    """Weighted severity mix as risk score and level."""
    critical = F.count_if(F.col("severity") == "CRITICAL")
    weight = T.severity_rank("severity") + 1
    row = reports.agg(
        F.count("*").alias("total"), critical.alias("critical"),
        F.coalesce(F.sum(weight) / (4 * F.count("*")), F.lit(0.0)).alias("risk_score"))
    s = F.col("risk_score")
    level = (F.when((F.col("critical") > 0) & (s >= 0.55), "CRITICAL").when(s >= 0.45, "HIGH")
             .when(s >= 0.25, "MEDIUM").otherwise("LOW"))
    return row.select(level.alias("risk_level"), "risk_score")


def request_metrics(requests: DataFrame, window_seconds: int = 300,
                    reference_time: datetime | None = None) -> DataFrame:
    """Totals over all requests; latencies, exact percentiles and rate over the last window."""
    ref = reference(requests, reference_time, "ts")
    start = F.timestamp_add("SECOND", F.lit(-window_seconds), ref)
    recent = requests.filter(F.col("ts") >= start).select("duration_ms")
    p = percentiles(recent, "duration_ms", [0.95, 0.99])
    total, failed = F.count("*"), F.count_if(~F.col("success"))
    totals = requests.agg(
        total.alias("total_requests"), (total - failed).alias("successful_requests"),
        failed.alias("failed_requests"),
        F.when(total > 0, F.round(failed / total, 4)).otherwise(0.0).alias("error_rate"))
    window = recent.agg(F.struct(
        F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("top"), F.count("*").alias("n"))).scalar()
    w, q, none = F.col("_w"), F.col("_p"), F.lit(0.0)
    return totals.withColumn("_w", window).withColumn("_p", p.select(F.struct("*")).scalar()).select(
        "total_requests", "successful_requests", "failed_requests", "error_rate",
        F.round(F.coalesce(w["mean"], none), 2).alias("avg_latency_ms"),
        F.round(F.coalesce(q["p95"], none), 2).alias("p95_latency_ms"),
        F.round(F.coalesce(q["p99"], none), 2).alias("p99_latency_ms"),
        F.round(F.coalesce(w["top"], none), 2).alias("max_latency_ms"),
        F.round(w["n"] / (window_seconds / 60.0), 2).alias("throughput_rpm"))


# --- bundles ------------------------------------------------------------------------

def _series(df: DataFrame, chart: str, key: str | None, value: str, time: str | None = None) -> DataFrame:
    return df.select(
        F.lit(chart).alias("chart"), (F.col(key) if key else F.lit("")).cast("string").alias("key"),
        (F.col(time) if time else F.lit(None)).cast("timestamp_ntz").alias("time"),
        F.col(value).cast("double").alias("value"))


def overview_charts(reports: DataFrame, clusters: DataFrame | None = None, hours: int = 24,
                    minutes: int = 15, reference_time: datetime | None = None) -> DataFrame:
    """All chart series as (chart, key, time, value) rows."""
    from timberline.operators.timeline import log_volume_trend, timeline

    anomalies = with_template(reports.filter("is_anomaly"))
    buckets = timeline(anomalies, min(hours, 168), minutes, reference_time)
    names = list(K.ERROR_CATEGORIES) + ["other"]
    heat = category_heatmap(anomalies, hours, 60, reference_time).unpivot(
        "bucket_start", names, "category", "count")
    metrics = reports.agg(
        F.count("*").alias("total_entries"), F.count_if("is_anomaly").alias("anomaly_count")).unpivot(
        [], ["total_entries", "anomaly_count"], "name", "value")
    parts = [
        _series(metrics, "metrics", "name", "value"),
        _series(buckets, "anomaly_timeline", None, "event_count", "bucket_start"),
        _series(buckets.withColumn("spike", F.col("is_spike").cast("int")), "anomaly_spike_markers", None,
                "spike", "bucket_start"),
        _series(severity_percent(reports), "severity_distribution_percent", "severity", "percent"),
        _series(heat, "error_frequency_heatmap", "category", "count", "bucket_start"),
        _series(top_ips(anomalies), "top_ip_sources", "ip", "count"),
        _series(error_type_ranking(anomalies), "error_type_ranking", "error_type", "count"),
        _series(log_volume_trend(reports, hours, minutes, reference_time), "log_volume_trend", None, "count",
                "bucket_start"),
        _series(category_pie(anomalies), "error_category_pie", "category", "count"),
    ]
    if clusters is not None:
        parts.append(_series(clusters, "cluster_distribution", "representative", "cluster_size"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary_report(reports: DataFrame, root_causes: DataFrame, patterns: DataFrame,
                   clusters: DataFrame | None = None) -> DataFrame:
    """One row: totals, risk, confidence, evidence flag, actions, leading causes and patterns."""
    order = [F.col("confidence").desc(), "first_file", "first_line"]
    lead = root_causes.orderBy(*order).limit(5)
    causes = lead.agg(
        F.round(F.avg("confidence"), 3).alias("cause_conf"),
        F.array_sort(F.collect_list(F.struct(
            (-F.col("confidence")).alias("c"), "first_file", "first_line", "title", "recommended_action"))).alias("list"))
    found = patterns.orderBy("position", F.col("confidence").desc()).limit(5).agg(
        F.round(F.avg("confidence"), 3).alias("pattern_conf"),
        F.array_sort(F.collect_list(F.struct("position", "title", "summary"))).alias("list"))
    totals = reports.agg(F.count("*").alias("total"), F.count_if("is_anomaly").alias("hits"))
    c, p, t, r = F.col("c"), F.col("p"), F.col("t"), F.col("r")
    # four one-row results side by side
    one = reports.sparkSession.range(1).select(
        causes.select(F.struct("*")).scalar().alias("c"), found.select(F.struct("*")).scalar().alias("p"),
        totals.select(F.struct("*")).scalar().alias("t"),
        risk_assessment(reports).select(F.struct("*")).scalar().alias("r"),
        (clusters.orderBy(F.col("cluster_size").desc(), "cluster_id").limit(1)
         .select(F.struct("representative", "cluster_size")).scalar() if clusters is not None
         else F.lit(None).cast("struct<representative:string,cluster_size:bigint>")).alias("cluster"))
    overall = F.round(F.coalesce(c["cause_conf"], F.lit(0.0)) * 0.65
                      + F.coalesce(p["pattern_conf"], F.lit(0.0)) * 0.35, 3)
    top3 = F.slice(c["list"], 1, 3)
    actions = F.slice(F.array_distinct(F.flatten(F.transform(top3, lambda x: x["recommended_action"]))), 1, 6)
    weak = (t["hits"] < 5) | (F.col("overall_confidence") < 0.4)
    return one.withColumn("overall_confidence", overall).select(
        t["total"].alias("total_entries"), t["hits"].alias("anomaly_count"),
        F.when(t["total"] > 0, F.round(t["hits"] / t["total"] * 100.0, 2)).otherwise(0.0).alias("anomaly_rate"),
        r["risk_level"].alias("risk_level"), r["risk_score"].alias("risk_score"), "overall_confidence",
        F.when(weak, K.EVIDENCE_WEAK).otherwise(K.EVIDENCE_STRONG).alias("evidence_note"),
        actions.alias("recommended_actions"),
        F.transform(top3, lambda x: x["title"]).alias("top_root_causes"),
        F.transform(F.slice(p["list"], 1, 3), lambda x: x["title"]).alias("top_patterns"),
        F.col("cluster.representative").alias("largest_cluster"))
