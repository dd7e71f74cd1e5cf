"""Queries and checks: search, dashboards, sessions, evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.operators import clusters as cl, dashboard as db, evaluate as ev, patterns as pt, sessions as se
from timberline.plans import causes as C, parsing as P, reports as R, sql as S, timing as TM, views as V
from timberline.session import cut

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


KEY = ["file", "line_number"]
HOURS = 24 * 7


@query("search_logs")
def _(spark, d):
    page = db.search_logs(R.reports(spark, d), query="connection", severity="MEDIUM",
                          start=datetime(2024, 1, 3), end=datetime(2024, 1, 28), limit=50, offset=20)
    return page.select(*KEY, "timestamp", "severity", "message", "total", "page",
                       F.array_join("semantic_tags", ",").alias("semantic_tags"))


ORACLES["search_logs"] = f"""with {R.SQL_REPORTS}, m as (select *, lower(message || ' ' || source) as low, count(*) over () as total from v_reports
 where severity = 'MEDIUM' and timestamp >= timestamp '2024-01-03' and timestamp <= timestamp '2024-01-28' and message ilike '%connection%')
select file, line_number, timestamp, severity, message, total, cast(1 as integer) as page, array_to_string({P.SQL_TAGS}, ',') as semantic_tags
 from m order by timestamp desc, line_number desc limit 50 offset 20"""

_REC = f"{R.SQL_REPORTS}, rec as (select * from v_reports where timestamp >= (select max(timestamp) - interval {HOURS} hours from v_entries))"


@query("summary_metrics")
def _(spark, d):
    return db.summary_metrics(R.reports(spark, d), HOURS)


ORACLES["summary_metrics"] = f"""with {_REC} select count(*) as total_entries, count(*) filter (confidence > 0.5e0) as anomaly_count,
 round(count(*) filter (confidence > 0.5e0) / count(*) * 100, 2) as anomaly_rate,
 {', '.join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in K.SEVERITY_RANK)} from rec"""


@query("top_sources")
def _(spark, d):
    return db.top_sources(R.reports(spark, d), HOURS)


ORACLES["top_sources"] = f"with {_REC} select source, count(*) as count from rec group by source order by count desc, source limit 5"


@query("error_trend")
def _(spark, d):
    # the stored severity column rarely says CRITICAL here, so it carries the log level
    by_level = R.reports(spark, d).withColumn("severity", F.col("log_level"))
    return db.error_trend(by_level, 24 * 31)


ORACLES["error_trend"] = f"""with {R.SQL_REPORTS} select date_trunc('hour', timestamp) as hour, count(*) as count from v_reports
 where log_level in ('ERROR', 'CRITICAL') group by 1"""


@query("severity_percent")
def _(spark, d):
    return db.severity_percent(R.reports(spark, d)).select("severity", F.round("percent", 6).alias("percent"))


ORACLES["severity_percent"] = f"""with {R.SQL_REPORTS} select severity, round(count(*) / (select count(*) from v_reports) * 100e0, 6) as percent
 from v_reports group by severity"""


@query("top_ips")
def _(spark, d):
    return db.top_ips(R.anomalies(spark, d))


ORACLES["top_ips"] = f"""with {R.SQL_ANOMALIES}, i as (select unnest(list_distinct(regexp_extract_all(message, {S.q(K.IPV4)}))) as ip from v_anom)
select ip, count(*) as count from i group by ip order by count desc, ip limit 5"""


@query("category_pie")
def _(spark, d):
    return db.category_pie(R.anomalies(spark, d))


ORACLES["category_pie"] = f"""with {R.SQL_ANOMALIES} select {P.SQL_CATEGORY} as category, count(*) as count from v_anom
 group by 1 order by count desc, category limit 8"""


@query("category_heatmap")
def _(spark, d):
    return db.category_heatmap(R.anomalies(spark, d), HOURS)


_CATS = list(K.ERROR_CATEGORIES) + ["other"]
ORACLES["category_heatmap"] = f"""with {R.SQL_ANOMALIES}, h as (select date_trunc('hour', timestamp) as slot, {P.SQL_CATEGORY} as cat from v_anom
 where timestamp >= (select max(timestamp) - interval {HOURS} hours from v_anom)),
s as (select unnest(generate_series(min(slot), max(slot), interval 1 hour)) as slot from h)
select s.slot as bucket_start, {', '.join(f"count(*) filter (cat = '{c}') as {c}" for c in _CATS)} from s left join h on s.slot = h.slot group by 1"""


@query("error_type_ranking")
def _(spark, d):
    return db.error_type_ranking(R.anomalies(spark, d)).withColumn("percent", F.round("percent", 6))


ORACLES["error_type_ranking"] = f"""with {R.SQL_ANOMALIES} select template as error_type, count(*) as count,
 round(count(*) / (select count(*) from v_anom) * 100e0, 6) as percent from v_anom group by template
 order by count desc, min((timestamp, file, line_number)) limit 10"""


@query("risk_assessment")
def _(spark, d):
    return db.risk_assessment(R.reports(spark, d)).withColumn("risk_score", F.round("risk_score", 6))


ORACLES["risk_assessment"] = f"""with {R.SQL_REPORTS}, mix as (select sum({S.rank('severity')} + 1) / (4e0 * count(*)) as s,
 count(*) filter (severity = 'CRITICAL') as c from v_reports)
select case when c > 0 and s >= 0.55e0 then 'CRITICAL' when s >= 0.45e0 then 'HIGH' when s >= 0.25e0 then 'MEDIUM' else 'LOW' end as risk_level,
 round(s, 6) as risk_score from mix"""


@query("request_metrics")
def _(spark, d):
    return db.request_metrics(V.requests(spark, d), 24 * 3600)


ORACLES["request_metrics"] = """with r as (select ts, value as ms, event_type <> 'error' as ok from events),
rec as (select ms from r where ts >= (select max(ts) - interval 86400 seconds from r))
select count(*) as total_requests, count(*) filter (ok) as successful_requests, count(*) filter (not ok) as failed_requests,
 round(count(*) filter (not ok) / count(*), 4) as error_rate, (select round(avg(ms), 2) from rec) as avg_latency_ms,
 (select round(quantile_cont(ms, 0.95), 2) from rec) as p95_latency_ms, (select round(quantile_cont(ms, 0.99), 2) from rec) as p99_latency_ms,
 (select round(max(ms), 2) from rec) as max_latency_ms, (select round(count(*) / 1440e0, 2) from rec) as throughput_rpm from r"""


@query("cluster_logs")
def _(spark, d):
    return cl.cluster_logs(V.entries(spark, d), max_clusters=20)[0]


@query("cluster_assignments")
def _(spark, d):
    return cl.cluster_logs(V.entries(spark, d), max_clusters=20)[1]


@query("cluster_distribution")
def _(spark, d):
    return cl.cluster_distribution(R.anomalies(spark, d))


@query("overview_charts")
def _(spark, d):
    return db.overview_charts(R.reports(spark, d), cl.cluster_distribution(R.anomalies(spark, d)), HOURS)


@query("overview_series")
def _(spark, d):
    """The charts that don't rest on clusters, all series in one table."""
    return db.overview_charts(R.reports(spark, d), None, HOURS).withColumn("value", F.round("value", 6))


_BUCKET = S.bucket("timestamp", 15)
_LINE = f"""{R.SQL_ANOMALIES}, o_ref as (select max(timestamp) as r, max(timestamp) - interval {HOURS} hours as c from v_anom),
o_rec as (select {_BUCKET} as slot, count(*) as n from v_anom, o_ref where timestamp >= c group by 1),
o_all as (select unnest(generate_series({S.bucket('c', 15)}, {S.bucket('r', 15)}, interval 15 minutes)) as slot from o_ref),
o_tl as (select o_all.slot, coalesce(n, 0) as n from o_all left join o_rec on o_all.slot = o_rec.slot),
o_st as (select avg(n) as m, stddev_samp(n) as sd from o_tl)"""
_TREND = f"""{V.SQL_ENTRIES}, o_rec as (select {_BUCKET} as slot, count(*) as n from v_entries
 where timestamp >= (select max(timestamp) - interval {HOURS} hours from v_entries) group by 1),
o_all as (select unnest(generate_series(min(slot), max(slot), interval 15 minutes)) as slot from o_rec)"""


def _chart(name: str, key: str, time: str, value: str, sql: str) -> str:
    return f"select '{name}' as chart, {key} as key, {time} as time, round(cast({value} as double), 6) as value from ({sql})"


_NO_TIME = "cast(null as timestamp)"
ORACLES["overview_series"] = " union all ".join([
    _chart("metrics", "'total_entries'", _NO_TIME, "n", f"with {R.SQL_REPORTS} select count(*) as n from v_reports"),
    _chart("metrics", "'anomaly_count'", _NO_TIME, "n", f"with {R.SQL_ANOMALIES} select count(*) as n from v_anom"),
    _chart("anomaly_timeline", "''", "slot", "n", f"with {_LINE} select slot, n from o_tl"),
    _chart("anomaly_spike_markers", "''", "slot", "n",
           f"with {_LINE} select slot, case when sd > 0 and (n - m) / sd >= 2 then 1 else 0 end as n from o_tl, o_st"),
    _chart("severity_distribution_percent", "severity", _NO_TIME, "percent", ORACLES["severity_percent"]),
    _chart("error_frequency_heatmap", "cat", "bucket_start", "n",
           f"unpivot ({ORACLES['category_heatmap']}) on {', '.join(_CATS)} into name cat value n"),
    _chart("top_ip_sources", "ip", _NO_TIME, "count", ORACLES["top_ips"]),
    _chart("error_type_ranking", "error_type", _NO_TIME, "count", ORACLES["error_type_ranking"]),
    _chart("log_volume_trend", "''", "slot", "n",
           f"with {_TREND} select o_all.slot, coalesce(n, 0) as n from o_all left join o_rec on o_all.slot = o_rec.slot"),
    _chart("error_category_pie", "category", _NO_TIME, "count", ORACLES["category_pie"])])


@query("cluster_totals")
def _(spark, d):
    """What must hold for any clustering: sizes are those of the assignments, and no row is lost or assigned twice."""
    clusters, assigned = (cut(x) for x in cl.cluster_logs(V.entries(spark, d), max_clusters=20))
    counted = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    met = clusters.join(counted, clusters["cluster_id"].eqNullSafe(counted["cluster_id"]), "full")
    return assigned.agg(F.count("*").alias("assigned"), F.countDistinct("file", "line_number").alias("entries")).select(
        "*", met.agg(F.sum("cluster_size")).scalar().alias("clustered"),
        met.agg(F.count_if(F.coalesce(F.col("cluster_size") != F.col("n"), F.lit(True)))).scalar().alias("wrong_sizes"),
        clusters.agg(F.count("*") <= 20).scalar().alias("few_enough"))


ORACLES["cluster_totals"] = """select count(*) as assigned, count(*) as entries, count(*)::bigint as clustered, 0::bigint as wrong_sizes,
 true as few_enough from events"""


@query("summary_report")
def _(spark, d):
    found = pt.detect_patterns(R.anomalies(spark, d), gap_seconds=C.GAP)
    return db.summary_report(R.reports(spark, d), C.causes(spark, d)[0], found,
                             cl.cluster_distribution(R.anomalies(spark, d)))


@query("summary_figures")
def _(spark, d):
    """The summary without its largest cluster."""
    found = pt.detect_patterns(R.anomalies(spark, d), gap_seconds=TM.GAP, rare_share=TM.RARE)
    listed = [F.array_join(c, " | ").alias(c) for c in ("recommended_actions", "top_root_causes", "top_patterns")]
    return db.summary_report(R.reports(spark, d), C.causes(spark, d)[0], found).select(
        "total_entries", "anomaly_count", "anomaly_rate", "risk_level", F.round("risk_score", 6).alias("risk_score"),
        "overall_confidence", "evidence_note", *listed)


_LEAD = "order by confidence desc, first_file, first_line"
ORACLES["summary_figures"] = f"""with recursive {C._MERGED}, z_lead as (select *, row_number() over ({_LEAD}) as p from told qualify p <= 5),
z_cause as (select round(avg(confidence), 3) as conf, string_agg(title, ' | ' order by p) filter (p <= 3) as titles,
 flatten(list(case when len(s) > 0 then s[1:5] else {S.words(K.ACTION_FALLBACK)} end order by p) filter (p <= 3)) as steps from z_lead),
z_found as (select * from ({TM.ORACLES['detect_patterns']}) order by position, confidence desc limit 5),
z_pat as (select round(avg(confidence), 3) as conf, array_to_string(list(title order by position, title, summary)[1:3], ' | ') as titles from z_found),
z_all as (select *, round(coalesce(c.conf, 0) * 0.65e0 + coalesce(q.conf, 0) * 0.35e0, 3) as overall,
 c.titles as cause_titles, q.titles as pattern_titles, (select count(*) from v_entries) as total, (select count(*) from v_an) as hits
 from z_cause c, z_pat q, ({ORACLES['risk_assessment']}) r)
select total as total_entries, hits as anomaly_count, round(hits / total * 100, 2) as anomaly_rate, risk_level, risk_score,
 overall as overall_confidence, case when hits < 5 or overall < 0.4 then {S.q(K.EVIDENCE_WEAK)} else {S.q(K.EVIDENCE_STRONG)} end as evidence_note,
 coalesce(array_to_string(list_filter(steps, lambda x, i: list_position(steps, x) = i)[1:6], ' | '), '') as recommended_actions,
 coalesce(cause_titles, '') as top_root_causes, coalesce(pattern_titles, '') as top_patterns from z_all"""


# --- sessions -------------------------------------------------------------------------
_SESSIONS = """select cast(conv_id as varchar) as id, timestamp '2024-01-01' + to_minutes(conv_id * 7 % 5000) as timestamp,
 substring(arg_min(text, turn), 1, 80) as summary, case conv_id % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'LOW' end as risk_level,
 case when conv_id % 3 = 0 then '{}' else '{"confidence": ' || cast(conv_id % 101 as varchar) || ', "files": "' || cast(count(*) as varchar) || '"}' end as metadata
 from conversations group by conv_id"""


def sessions(spark, d):
    conv = V.table(spark, d, "conversations")
    base = conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.count("*").alias("n"))
    return base.select(
        F.col("conv_id").cast("string").alias("id"),
        F.timestamp_add("MINUTE", (F.col("conv_id") * 7 % 5000).cast("int"),
                        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"),
        F.substring("text", 1, 80).alias("summary"),
        F.expr("case conv_id % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'LOW' end").alias("risk_level"),
        F.expr("case when conv_id % 3 = 0 then '{}' else '{\"confidence\": ' || cast(conv_id % 101 as string) "
               "|| ', \"files\": \"' || cast(n as string) || '\"}' end").alias("metadata"))


def messages(spark, d):
    return V.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role",
        F.col("text").alias("message"),
        F.timestamp_add("MINUTE", (F.col("conv_id") * 7 % 5000 + F.col("turn")).cast("int"),
                        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"))


@query("session_upsert")
def _(spark, d):
    base = sessions(spark, d)
    ids = F.col("id").cast("bigint")
    changes = base.select(
        F.when(ids % 5 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"),
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("updated "), "id").alias("summary"),
        F.when(ids % 2 == 0, "MEDIUM").alias("risk_level"), F.when(ids % 2 == 0, F.lit("{}")).alias("metadata"))
    return se.upsert_sessions(base, changes)


ORACLES["session_upsert"] = f"""with s as ({_SESSIONS}), c as (select case when cast(id as bigint) % 5 = 0 then 'new-' || id else id end as id,
 timestamp '2024-06-01' as timestamp, 'updated ' || id as summary, case when cast(id as bigint) % 2 = 0 then 'MEDIUM' end as risk_level,
 case when cast(id as bigint) % 2 = 0 then '{{}}' end as metadata from s)
select coalesce(s.id, c.id) as id, coalesce(s.timestamp, c.timestamp) as timestamp, coalesce(c.summary, s.summary) as summary,
 coalesce(c.risk_level, s.risk_level) as risk_level, coalesce(c.metadata, s.metadata) as metadata from s full join c on s.id = c.id"""


@query("recent_sessions")
def _(spark, d):
    m = F.col("metadata")
    return se.recent_sessions(sessions(spark, d)).select(
        "id", "created_at", "summary", "risk_level", m["confidence"].alias("confidence"), m["files"].alias("files"))


ORACLES["recent_sessions"] = f"""with s as ({_SESSIONS}) select id, timestamp as created_at, summary, risk_level,
 json_extract_string(metadata, '$.confidence') as confidence, json_extract_string(metadata, '$.files') as files
 from s order by timestamp desc, id limit 50"""


@query("session_messages")
def _(spark, d):
    return se.session_messages(messages(spark, d), last=6).select("session_id", "seq", "role", "message", "timestamp")


ORACLES["session_messages"] = """select cast(conv_id as varchar) as session_id, turn as seq, role, text as message,
 timestamp '2024-01-01' + to_minutes(conv_id * 7 % 5000 + turn) as timestamp from (select *,
 row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 6"""


@query("session_delete")
def _(spark, d):
    base = sessions(spark, d)
    gone = base.filter("risk_level = 'CRITICAL'").select("id")
    left, kept = se.delete_sessions(base, messages(spark, d), gone)
    return left.select(F.lit("session").alias("kind"), "id", F.lit(0).cast("bigint").alias("seq")).unionByName(
        kept.select(F.lit("message").alias("kind"), F.col("session_id").alias("id"), "seq"))


ORACLES["session_delete"] = """select distinct 'session' as kind, cast(conv_id as varchar) as id, 0::bigint as seq from conversations
 where conv_id % 4 <> 0 union all select 'message', cast(conv_id as varchar), turn from conversations where conv_id % 4 <> 0"""


@query("session_stats")
def _(spark, d):
    return se.session_stats(sessions(spark, d))


ORACLES["session_stats"] = f"""with s as ({_SESSIONS}) select count(*) as total_analyses,
 round(avg(coalesce(try_cast(json_extract_string(metadata, '$.confidence') as double), 0))) as avg_confidence,
 count(*) filter (risk_level = 'CRITICAL') as critical_issues from s"""


@query("evaluate_labels")
def _(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") < 400).alias("is_anomaly"),
        F.when(F.length("text") < 400, "HIGH").otherwise("LOW").alias("severity"))
    labels = V.table(spark, d, "labels").select(
        "doc_id", (F.col("quality") == 0).alias("is_anomaly"),
        F.when(F.col("toxic") == 1, "HIGH").otherwise("LOW").alias("severity"))
    return ev.evaluate_labels(docs, labels, "doc_id")


ORACLES["evaluate_labels"] = """with j as (select n_chars < 400 as p, quality = 0 as a, case when length(text) < 400 then 'HIGH' else 'LOW' end
 = case when toxic = 1 then 'HIGH' else 'LOW' end as same from documents join labels using (doc_id)),
c as (select count(*) as total, count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and not a) as tn,
 count(*) filter (not p and a) as fn, count(*) filter (same) as severity_correct from j),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as rc from c)
select total, tp, fp, tn, fn, round(pr, 4) as precision, round(rc, 4) as recall,
 round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0e0 end, 4) as f1_score,
 round(case when fp + tn > 0 then fp / (fp + tn) else 0e0 end, 4) as false_positive_rate, severity_correct,
 round(severity_correct / total, 4) as severity_accuracy from r"""
