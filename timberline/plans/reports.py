"""Reports built from the typed entries, shared by the later queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline import constants as K
from timberline.operators import anomaly, explain, severity, templates
from timberline.plans import sql as S, views as V
from timberline.session import apart

# the given events are sparse (about 14 per hour at sf0.01), so windows are an hour wide
WINDOW, THRESHOLD = 3600, 20


#: rows of a task that scores entries and extracts templates
TASK_ROWS = 50_000


def scored(spark: SparkSession, d: str, forest: bool = False) -> DataFrame:
    entries = V.entries(spark, d)
    tasks = -(-entries.count() // TASK_ROWS)  # a count that Parquet's footers tell
    many = tasks > spark.sparkContext.defaultParallelism
    return anomaly.evaluate_anomalies(entries, WINDOW, THRESHOLD, forest=forest, tasks=tasks if many else None)


def fresh_reports(spark: SparkSession, d: str) -> DataFrame:
    """Entries with verdict and severity."""
    return apart(severity.severity_scores(scored(spark, d), batch=V.entries(spark, d)))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """The stored reports, as the dashboards find them; templates are extracted once."""
    return V.stored(spark, d, "reports", lambda s, p: templates.with_template(fresh_reports(s, p)), spread=False)


def explained(spark: SparkSession, d: str) -> DataFrame:
    return explain.confidence_texts(explain.explain(reports(spark, d)))


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Anomalous reports with their template."""
    return templates.with_template(reports(spark, d).filter("is_anomaly"))


# --- SQL side ----------------------------------------------------------------------
_KW = S.hits("lower(message)", K.CRITICAL_KEYWORDS)
_FKW = S.hits("lower(message)", K.FEATURE_KEYWORDS)
_ERR = "log_level in ('ERROR', 'CRITICAL')"
_RULES_TAIL = f"""w as (select *, cast(floor((epoch_us(timestamp) - (select min(epoch_us(timestamp)) from v_entries)) / 1e6 / {WINDOW}) as bigint) as spike_window,
 case when {_ERR} then lower({S.strip('message')}) end as repeat_key, {_KW} as kw from v_entries),
wc as (select *, count(*) over (partition by spike_window) as wn, count(*) over (partition by repeat_key) as rn from w),
cand as (select *,
 case when len(kw) > 0 then {S.clamp('0.5e0 + 0.1e0 * len(kw)')} end as c1, 'Critical keywords found: ' || array_to_string(kw, ', ') as t1,
 case when wn >= {THRESHOLD} then {S.clamp(f'0.4e0 + 0.15e0 * (wn / {THRESHOLD}e0 - 1)')} end as c2,
 'Frequency spike: ' || wn || ' entries in window (threshold: {THRESHOLD})' as t2,
 case when repeat_key is not null and rn >= 3 then {S.clamp('0.3e0 + 0.1e0 * rn')} end as c3,
 'Repeated error (' || rn || ' occurrences)' as t3,
 case when log_level = 'CRITICAL' then 0.6e0 end as c4, case when log_level = 'ERROR' then 0.3e0 end as c5 from wc),
v_rules as (select *, coalesce(greatest(c1, c2, c3, c4, c5), 0e0) as rule_score,
 case greatest(c1, c2, c3, c4, c5) when c1 then 'critical_keyword' when c2 then 'frequency_spike' when c3 then 'repeated_error'
 when c4 then 'critical_level' when c5 then 'error_level' end as rule_type,
 concat_ws('; ', case when c1 is not null then t1 end, case when c2 is not null then t2 end, case when c3 is not null then t3 end,
 case when c4 is not null then 'Log level is CRITICAL' end, case when c5 is not null then 'Log level is ERROR' end) as rule_details
 from cand)"""
SQL_RULES = f"{V.SQL_ENTRIES}, {_RULES_TAIL}"
SQL_FEATURES = f"""coalesce(hour(timestamp) / 23e0, 0.5e0) as f_hour,
 {S.case_map('log_level', K.FEATURE_LEVELS, '0.3::double')} as f_level, least(ln(1e0 + length(message)) / 10e0, 1e0) as f_length,
 least(len(regexp_extract_all(message, '\\S+')) / 50e0, 1e0) as f_words, least(len({_FKW}) / 5e0, 1e0) as f_keywords,
 case when nullif(ip_address, '') is not null then 1e0 else 0e0 end as f_has_ip,
 case when nullif(error_code, '') is not null then 1e0 else 0e0 end as f_has_code"""
_STAT = ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in K.FEATURES)
_Z = "greatest(" + ", ".join(
    f"abs(({f} - m_{f}) / case when s_{f} < 1e-10 then 1e0 else s_{f} end)" for f in K.FEATURES) + ")"
SQL_ZSCORES = f"""f as (select *, {SQL_FEATURES} from v_rules), st as (select {_STAT} from f),
z as (select f.*, {_Z} as max_z from f, st),
v_stat as (select *, case when max_z < 2 then 0e0 else {S.clamp('1e0 - 1e0 / (1e0 + (max_z - 2))')} end as stat_score from z)"""
_SCORED_TAIL = f"""{SQL_ZSCORES},
v_comb as (select *, {S.clamp('0.4e0 * rule_score + 0.3e0 * 0e0 + 0.3e0 * stat_score')} as confidence from v_stat),
v_scored as (select *, rule_type is not null or stat_score > 0.5e0 or confidence > 0.45e0 as is_anomaly,
 case when rule_type is not null and rule_score >= stat_score then rule_type when stat_score > 0.3e0 then 'statistical_outlier'
 else coalesce(rule_type, 'none') end as anomaly_type,
 concat_ws('; ', case when rule_details <> '' then 'Rule: ' || rule_details end,
 case when stat_score > 0.2e0 then printf('Z-score deviation: %.2f', stat_score) end) as details from v_comb)"""
SQL_SCORED = f"{SQL_RULES}, {_SCORED_TAIL}"
_REPORTS_TAIL = f"""b as (select count(*) as total, count(*) filter ({_ERR}) as errors from v_entries),
fr as (select v_scored.*, {S.case_map('log_level', K.LEVEL_BASE, '0.2::double')} as level_base,
 case when {_ERR} then {S.clamp(S.clamp('errors / total * 2e0') + ' + 0.2e0')} else {S.clamp('errors / total * 2e0')} end as frequency_score
 from v_scored, b),
sv as (select *, {S.clamp('0.35e0 * level_base + 0.25e0 * frequency_score + 0.4e0 * confidence')} as raw_score from fr),
v_reports as (select *, case when raw_score >= 0.8e0 then 'CRITICAL' when raw_score >= 0.6e0 then 'HIGH'
 when raw_score >= 0.35e0 then 'MEDIUM' else 'LOW' end as severity, round(raw_score, 4) as severity_score from sv)"""

SQL_REPORTS = f"{SQL_SCORED}, {_REPORTS_TAIL}"


def sql_reports_over(entries_sql: str) -> str:
    """The reports of other entries: the SQL given has to define v_entries."""
    return f"{entries_sql}, {_RULES_TAIL}, {_SCORED_TAIL}, {_REPORTS_TAIL}"


def _text(column: int, as_list: bool) -> str:
    """The explanation text of a row's type with its placeholders filled."""
    def fill(x):
        return (f"replace(replace(replace(replace({x}, '{{severity}}', severity), '{{log_level}}', log_level), "
                f"'{{details}}', coalesce(nullif(details, ''), {S.q(K.NO_DETAILS)})), '{{message_preview}}', preview)")

    def value(v):
        return "[" + ", ".join(fill(S.q(x)) for x in v) + "]" if as_list else fill(S.q(v))

    arms = " ".join(f"when '{k}' then {value(v[column])}" for k, v in K.EXPLANATION_TEXTS.items())
    return f"case anomaly_type {arms} else {value(K.EXPLANATION_DEFAULT[column])} end"


SQL_EXPLAINED = f"""{SQL_REPORTS},
pv as (select *, case when length(message) <= 100 then message else substring(message, 1, 97) || '...' end as preview from v_reports),
v_explained as (select *, {_text(0, False)} as summary, {_text(1, True)} as possible_causes, {_text(2, True)} as remediation,
 case when is_anomaly then confidence else 0e0 end as confidence_score from pv)"""
SQL_ANOMALIES = f"""{SQL_REPORTS}, v_anom as (select *, {S.template('message')} as template from v_reports where is_anomaly)"""
