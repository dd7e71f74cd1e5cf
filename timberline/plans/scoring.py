"""Queries and checks: anomalies, severities, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.operators import anomaly as an, explain as ex, forest as fo, severity as sv
from timberline.plans import reports as R, sql as S, views as V

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


KEY = ["file", "line_number"]


@query("critical_keywords")
def _(spark, d):
    return an.keyword_hits(V.entries(spark, d)).filter("kw_conf is not null").select(*KEY, "kw_conf", "kw_detail")


ORACLES["critical_keywords"] = f"with {R.SQL_RULES} select file, line_number, c1 as kw_conf, t1 as kw_detail from v_rules where c1 is not null"


@query("frequency_spikes")
def _(spark, d):
    return an.frequency_spikes(V.entries(spark, d), R.WINDOW, R.THRESHOLD).filter("spike_conf is not null").select(
        *KEY, "spike_window", "spike_count", F.round("spike_conf", 6).alias("spike_conf"), "spike_detail")


ORACLES["frequency_spikes"] = f"""with {R.SQL_RULES} select file, line_number, spike_window, wn as spike_count,
 round(c2, 6) as spike_conf, t2 as spike_detail from v_rules where c2 is not null"""


@query("sequential_spikes")
def _(spark, d):
    return an.sequential_spikes(V.entries(spark, d), 12).filter("spike_conf is not null").select(
        *KEY, "spike_window", "spike_conf", "spike_detail")


ORACLES["sequential_spikes"] = f"""with {V.SQL_ENTRIES},
p as (select file, line_number, (row_number() over (order by file, line_number) - 1) // 12 as spike_window from v_entries),
c as (select *, count(*) over (partition by spike_window) as n from p)
select file, line_number, spike_window, 0.4e0 as spike_conf, 'Frequency spike: 12 entries in window (threshold: 12)' as spike_detail
from c where n = 12"""


@query("repeated_errors")
def _(spark, d):
    return an.repeated_errors(V.entries(spark, d)).filter("repeat_conf is not null").select(
        *KEY, "repeat_count", F.round("repeat_conf", 6).alias("repeat_conf"), "repeat_detail")


ORACLES["repeated_errors"] = f"""with {R.SQL_RULES} select file, line_number, rn as repeat_count, round(c3, 6) as repeat_conf,
 t3 as repeat_detail from v_rules where c3 is not null"""


@query("rule_engine")
def _(spark, d):
    return an.rule_engine(V.entries(spark, d), R.WINDOW, R.THRESHOLD).select(
        *KEY, F.round("rule_score", 6).alias("rule_score"), "rule_type", "rule_details")


ORACLES["rule_engine"] = f"""with {R.SQL_RULES} select file, line_number, round(rule_score, 6) as rule_score, rule_type,
 rule_details from v_rules"""


@query("features")
def _(spark, d):
    return an.with_features(V.entries(spark, d)).select(*KEY, *[F.round(f, 6).alias(f) for f in K.FEATURES])


ORACLES["features"] = f"""with {V.SQL_ENTRIES}, f as (select file, line_number, {R.SQL_FEATURES} from v_entries)
select file, line_number, {', '.join(f'round({f}, 6) as {f}' for f in K.FEATURES)} from f"""


@query("isolation_forest")
def _(spark, d):
    return fo.isolation_forest(an.with_features(V.entries(spark, d))).select(*KEY, "ml_score")


@query("zscore_outliers")
def _(spark, d):
    return an.zscore_outliers(an.with_features(V.entries(spark, d))).select(
        *KEY, F.round("max_z", 6).alias("max_z"), F.round("stat_score", 6).alias("stat_score"))


ORACLES["zscore_outliers"] = f"""with {R.SQL_RULES}, {R.SQL_ZSCORES} select file, line_number, round(max_z, 6) as max_z,
 round(stat_score, 6) as stat_score from v_stat"""

_VERDICT = ["is_anomaly", "anomaly_type", "details"]


@query("evaluate_anomalies")
def _(spark, d):
    return R.scored(spark, d).select(*KEY, F.round("confidence", 6).alias("confidence"), *_VERDICT)


ORACLES["evaluate_anomalies"] = f"""with {R.SQL_SCORED} select file, line_number, round(confidence, 6) as confidence,
 is_anomaly, anomaly_type, details from v_scored"""


@query("forest_range")
def _(spark, d):
    """What must hold for any forest: a score for every row, the least 0 and the most 1, all between."""
    score = F.col("ml_score")
    return fo.isolation_forest(an.with_features(V.entries(spark, d))).agg(
        F.count(score).alias("scored"), F.min(score).alias("least"), F.max(score).alias("most"),
        F.count_if(~score.between(0, 1)).alias("outside"))


ORACLES["forest_range"] = "select count(*) as scored, 0e0 as least, 1e0 as most, 0::bigint as outside from events"


@query("evaluate_anomalies_forest")
def _(spark, d):
    return R.scored(spark, d, forest=True).select(*KEY, "confidence", "ml_score", *_VERDICT)


@query("frequency_score")
def _(spark, d):
    return sv.frequency_scores(V.entries(spark, d)).select(*KEY, F.round("frequency_score", 6).alias("frequency_score"))


ORACLES["frequency_score"] = f"with {R.SQL_REPORTS} select file, line_number, round(frequency_score, 6) as frequency_score from v_reports"


@query("severity_scores")
def _(spark, d):
    b = F.col("breakdown")
    return R.fresh_reports(spark, d).select(
        *KEY, "severity", "severity_score", b["level_base"].alias("level_base"),
        b["frequency_score"].alias("frequency_score"), b["anomaly_score"].alias("anomaly_score"))


ORACLES["severity_scores"] = f"""with {R.SQL_REPORTS} select file, line_number, severity, severity_score,
 round(level_base, 4) as level_base, round(frequency_score, 4) as frequency_score, round(confidence, 4) as anomaly_score from v_reports"""


@query("batch_summary")
def _(spark, d):
    return sv.batch_summary(R.reports(spark, d))


ORACLES["batch_summary"] = f"""with {R.SQL_REPORTS} select count(*) as total_entries, count(*) filter (is_anomaly) as anomaly_count,
 round(count(*) filter (is_anomaly) / count(*) * 100, 1) as anomaly_percent,
 {', '.join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in K.SEVERITY_RANK)} from v_reports"""


@query("anomalous_entries")
def _(spark, d):
    return sv.anomalous_entries(R.reports(spark, d))


ORACLES["anomalous_entries"] = f"""with {R.SQL_REPORTS} select file, line_number, severity, anomaly_type,
 substring(message, 1, 120) as message, substring(message, 1, 200) as raw from v_reports where is_anomaly"""


@query("top_anomalies")
def _(spark, d):
    return sv.top_anomalies(R.reports(spark, d), 500).select(*KEY, F.round("confidence", 6).alias("confidence"))


ORACLES["top_anomalies"] = f"""with {R.SQL_REPORTS} select file, line_number, round(confidence, 6) as confidence from v_reports
 where is_anomaly order by v_reports.confidence desc, file, line_number limit 500"""


@query("explanations")
def _(spark, d):
    return ex.explain(R.reports(spark, d)).select(
        *KEY, "summary", F.array_join("possible_causes", " | ").alias("causes"),
        F.array_join("remediation", " | ").alias("steps"))


ORACLES["explanations"] = f"""with {R.SQL_EXPLAINED} select file, line_number, summary, array_to_string(possible_causes, ' | ') as causes,
 array_to_string(remediation, ' | ') as steps from v_explained"""


@query("confidence_labels")
def _(spark, d):
    return R.explained(spark, d).select(
        *KEY, F.round("confidence_score", 6).alias("confidence_score"), "confidence_label", "confidence_note",
        "why_it_matters", "technical_explanation", F.col("detail_levels.simple").alias("simple"))


_LABEL = "case when confidence_score >= 0.8e0 then 'High' when confidence_score >= 0.5e0 then 'Medium' else 'Low' end"
_TECH = f"""printf('Anomaly type: %s. Details: %s. Confidence: %s (%.2f).', anomaly_type,
 coalesce(nullif(details, ''), {S.q(K.NO_DETAILS)}), {_LABEL}, confidence_score)"""
ORACLES["confidence_labels"] = f"""with {R.SQL_EXPLAINED} select file, line_number, round(confidence_score, 6) as confidence_score,
 {_LABEL} as confidence_label, case when not is_anomaly then {S.q(K.CONFIDENCE_NOTES['normal'])}
 when confidence_score < 0.5e0 then {S.q(K.CONFIDENCE_NOTES['low'])}
 when confidence_score < 0.8e0 then {S.q(K.CONFIDENCE_NOTES['moderate'])} else {S.q(K.CONFIDENCE_NOTES['high'])} end as confidence_note,
 case when severity in ('HIGH', 'CRITICAL') then {S.q(K.WHY_HIGH)} else {S.q(K.WHY_OTHER)} end as why_it_matters,
 case when confidence_score < 0.5e0 then 'Insufficient evidence for a definitive cause. Possible issues include: '
 || array_to_string(possible_causes[1:3], ', ') || '. ' || {_TECH} else {_TECH} end as technical_explanation, summary as simple from v_explained"""
