"""Explanations upgraded with root causes, clusters and patterns of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberline.operators import clusters as cl, patterns as pt, root_cause as rc, severity as sv
from timberline.operators.explain import confidence_label
from timberline.operators.skew import attach
from timberline.operators.templates import with_template
from timberline.session import cut


def _best_causes(root_causes: DataFrame) -> DataFrame:
    """The most confident root cause per template, with the rows behind the template."""
    turn = F.struct(-F.col("confidence"), "first_file", "first_line")
    return root_causes.groupBy(F.col("template_pattern").alias("template")).agg(
        F.sum("event_count").alias("_rows"),
        F.min_by(F.struct("confidence", "recommended_action", "n_ips", "dominant_source"), turn).alias("rc"))


def deep_explanations(explained: DataFrame, gap_seconds: int = 300, max_anomalies: int | None = None,
                      pattern_gap_seconds: int = 120) -> DataFrame:
    """Replace the explanation fields of every row by their upgraded form.

    The context (root causes, clusters, patterns) is built from the anomalous rows, or
    from the most confident ``max_anomalies`` of them when a limit is wanted.
    """
    # rows are joined by template, so what it is made of is cut off, see assign_templates
    rows = explained if "template" in explained.columns else cut(with_template(explained))
    anomalies = rows.filter("is_anomaly") if max_anomalies is None else sv.top_anomalies(rows, max_anomalies)
    anomalies = cut(anomalies)
    causes = cut(rc.build_root_causes(anomalies, gap_seconds)[0])
    clusters, assigned = cl.cluster_logs(anomalies, max_clusters=12)
    reps = assigned.join(F.broadcast(clusters.select("cluster_id", "representative")), "cluster_id").select(
        "file", "line_number", "representative")  # at most twelve clusters
    lead = (pt.detect_patterns(anomalies, gap_seconds=pattern_gap_seconds)
            .orderBy("position", F.col("confidence").desc()).limit(1).agg(F.max("summary"))).scalar()

    told = (
        attach(rows, _best_causes(causes), ["template"], "_rows")
        .join(reps, ["file", "line_number"], "left").withColumn("_signal", lead))
    rc_col = F.col("rc")
    score = F.when(rc_col["confidence"] >= 0.6, F.least(F.lit(1.0), F.col("confidence_score") + 0.08)).otherwise(
        F.col("confidence_score"))
    label = F.when(rc_col["confidence"] >= 0.6, confidence_label(F.col("_score"))).otherwise(F.col("confidence_label"))
    extra_causes = F.array_compact(F.array(
        F.when(rc_col["n_ips"] > 0, F.format_string(
            "Potentially influenced by repeated activity from %d distinct IP(s) (evidence-based).", rc_col["n_ips"])),
        F.when(rc_col["dominant_source"].isNotNull(), F.concat(
            F.lit("May be tied to the dominant source/module observed in the incident: "),
            rc_col["dominant_source"], F.lit(".")))))
    none = F.array().cast("array<string>")
    causes_col = F.concat("possible_causes", F.when(rc_col.isNotNull(), extra_causes).otherwise(none))
    steps_col = F.concat("remediation", F.coalesce(F.slice(rc_col["recommended_action"], 1, 2), none))
    unsure = rc_col.isNull() & (F.col("_score") < 0.5)
    weak = F.concat(
        F.lit("Insufficient evidence to connect this log entry to a specific grouped incident. Possible causes include: "),
        F.when(F.size("_causes") > 0, F.array_join(F.slice("_causes", 1, 3), ", ")).otherwise("unverified contributing factors"),
        F.lit(". "), "technical_explanation")
    strong = F.concat_ws(
        " ", F.when(F.col("technical_explanation") != "", F.col("technical_explanation")),
        F.when(F.col("representative").isNotNull(), F.concat(
            F.lit("Matched template cluster similarity. Representative: "), "representative", F.lit(".")))
        .otherwise("Template clustering did not provide a stable representative in this batch."),
        F.concat(F.lit("Recent behavioral signals: "), "_signal"))
    staged = told.withColumns({"_score": score, "_causes": causes_col, "_steps": steps_col})
    return staged.withColumns({
        "confidence_label": label, "confidence_score": F.round("_score", 3),
        "possible_causes": F.slice("_causes", 1, 8), "remediation": F.slice("_steps", 1, 8),
        "technical_explanation": F.trim(F.when(unsure, weak).otherwise(strong)),
        "why_it_matters": F.when(
            unsure,
            "While this entry looks anomalous, confidence is low; treat remediation as investigation guidance "
            "until correlated indicators confirm impact.").otherwise(
            "This anomaly is part of a broader behavioral pattern; understanding the correlated group helps "
            "prioritize fixes and reduce time-to-mitigation."),
    }).select(*explained.columns)
