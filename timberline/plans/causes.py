"""Queries and checks: root causes, cascades, relationships, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.operators import explain as ex, relations as rl, root_cause as rc
from timberline.plans import parsing as P, reports as R, sql as S, views as V

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


GAP = 1800  # session gap in seconds, wide because the events are sparse


def anomalies(spark, d):
    return ex.explain(R.anomalies(spark, d))


def _members(spark, d):
    return rc.with_sizes(rc.sessionize_templates(anomalies(spark, d), GAP))


def _events(spark, d):
    return rc.aggregate_root_causes(anomalies(spark, d), GAP)


def causes(spark, d):
    return rc.build_root_causes(anomalies(spark, d), GAP)


# the oracle names a group by its first row, as the library does
_SESS = f"""{R.SQL_EXPLAINED}, v_an as (select *, {S.template('message')} as template from v_explained where is_anomaly),
e_prev as (select *, lag(timestamp) over (partition by template order by timestamp, file, line_number) as pts from v_an),
e_flag as (select *, case when pts is not null and epoch_us(timestamp) - epoch_us(pts) <= {GAP} * 1000000 then 0 else 1 end as f from e_prev),
e_run as (select *, sum(f) over (partition by template order by timestamp, file, line_number) as run from e_flag),
e_pos as (select *, row_number() over (partition by template, run order by timestamp, file, line_number) - 1 as place,
 first_value(file || ':' || line_number) over (partition by template, run order by timestamp, file, line_number) as event_id,
 count(*) over (partition by template, run) as event_count, {S.rank('severity')} as rk from e_run),
e_mem as (select * from e_pos where event_count >= 2),
e_grp as (select event_id, min(template) as template_pattern, min(event_count) as n, min(timestamp) as start, max(timestamp) as "end",
 max(rk) as rank, coalesce(avg(rk) filter (place >= event_count // 2) > avg(rk) filter (place < event_count // 2) + 0.5e0, false) as escalated,
 list_distinct(list(summary order by place) filter (place < 3)) as parts,
 string_agg(case when place < 3 then summary end, '; ' order by place) as joined,
 list(summary order by place) filter (place < 3) as sums from e_mem group by event_id)"""
_DEDUP = "array_to_string(list_filter(sums, lambda s, i: list_position(sums, s) = i), '; ')"
_EVENTS = f"""{_SESS}, ev as (select event_id, template_pattern, n as event_count, start, "end", escalated,
 case rank when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity,
 round(least(1e0, 0.3e0 + least(n / (select count(*) from v_an), 1e0) * 0.4e0 + case when escalated then 0.2e0 else 0e0 end
 + case when n >= 10 then 0.1e0 else 0e0 end), 3) as confidence, 'Cluster of ' || n || ' related events between '
 || strftime(start, '%H:%M:%S') || ' and ' || strftime("end", '%H:%M:%S') || ' (~' ||
 cast(floor((epoch_us("end") - epoch_us(start)) / 6e7) as bigint) || ' min window). Likely caused by: ' || {_DEDUP} as description from e_grp)"""


@query("sessionize_templates")
def _(spark, d):
    return rc.sessionize_templates(anomalies(spark, d), GAP).select("file", "line_number", "event_id", "place")


ORACLES["sessionize_templates"] = f"with {_SESS} select file, line_number, event_id, place from e_pos"


@query("severity_escalation")
def _(spark, d):
    return rc.severity_escalation(_members(spark, d))


ORACLES["severity_escalation"] = f"with {_SESS} select event_id, escalated from e_grp"


@query("root_causes")
def _(spark, d):
    return _events(spark, d)[0].select(
        "event_id", "title", "description", "start", "end", "confidence", "severity", "template_pattern", "event_count")


ORACLES["root_causes"] = f"""with {_EVENTS} select event_id, '[' || severity || '] ' ||
 case when length(template_pattern) > 80 then substring(template_pattern, 1, 80) || '...' else template_pattern end
 || ' (' || event_count || ' occurrences)' as title, description, start, "end", confidence, severity, template_pattern, event_count from ev"""


@query("root_cause_members")
def _(spark, d):
    return _events(spark, d)[1].select("event_id", "file", "line_number")


ORACLES["root_cause_members"] = f"with {_SESS} select event_id, file, line_number from e_mem"


@query("correlate_events")
def _(spark, d):
    events = rc.cut(_events(spark, d)[0])
    leaders = rc.cascade_leaders(events)
    return rc.correlate_events(leaders, events).select("leader_id", "event_id", "score")


@query("cascades")
def _(spark, d):
    events = rc.cut(_events(spark, d)[0])
    mapping = rc.cut(rc.cascade_map(events, rc.cascade_leaders(events)))
    return rc.detect_cascades(events, mapping)


@query("entity_rollup")
def _(spark, d):
    return rc.entity_rollup(_members(spark, d)).select(
        "event_id", "n_ips", "n_codes", F.array_join("codes", ",").alias("codes"), "dominant_source")


_ENT = f"""{_SESS}, x_ip as (select event_id, count(distinct ip) as n_ips from (select event_id,
 unnest(regexp_extract_all(message, {S.q(K.IPV4)})) as ip from e_mem) group by event_id),
x_tok as (select event_id, unnest(regexp_extract_all(message, {S.q(K.ERROR_TOKEN)})) as v from e_mem),
x_num as (select event_id, unnest(regexp_extract_all(message, {S.q(K.NUMERIC_CODE)})) as v from e_mem),
x_all as (select event_id, v from x_tok union select event_id, v from x_num where event_id in (select event_id from x_tok)),
x_code as (select event_id, count(*) as n_codes, array_to_string(list(v order by v)[1:3], ',') as codes from x_all group by event_id),
x_src as (select event_id, source from (select event_id, source, row_number() over (partition by event_id order by count(*) desc,
 min((timestamp, file, line_number))) as p from e_mem group by event_id, source) where p = 1),
ent as (select g.event_id, g.template_pattern, coalesce(n_ips, 0) as n_ips, coalesce(n_codes, 0) as n_codes,
 coalesce(codes, '') as codes, x_src.source as dominant_source from e_grp g left join x_ip on g.event_id = x_ip.event_id
 left join x_code on g.event_id = x_code.event_id left join x_src on g.event_id = x_src.event_id)"""
ORACLES["entity_rollup"] = f"with {_ENT} select event_id, n_ips, n_codes, codes, dominant_source from ent"


@query("recommended_actions")
def _(spark, d):
    groups, members = _events(spark, d)
    return rc.enrich(groups, members).select(
        "event_id", F.array_join("recommended_action", " | ").alias("actions"))


_STEPS = ", ".join(
    f"case when {S.any_of('lower(template_pattern)', w)} then {S.q(a)} end" for w, acts in K.ACTION_RULES for a in acts)
ORACLES["recommended_actions"] = f"""with {_ENT}, acts as (select event_id, list_filter([{_STEPS},
 'Prioritize investigation of service/module: ' || dominant_source || '.',
 case when n_ips > 0 then 'Observed ' || n_ips || ' distinct IP(s); review access logs and rate-limit if necessary.' end,
 case when n_codes > 0 then 'Error tokens observed: ' || replace(codes, ',', ', ') || case when n_codes > 3 then '...' else '' end || '.' end],
 lambda a: a is not null) as s from ent)
select event_id, array_to_string(s[1:5], ' | ') as actions from acts"""


@query("enriched_root_causes")
def _(spark, d):
    return causes(spark, d)[0].select(
        "event_id", "title", "summary", "confidence", "severity", "event_count", "n_ips", "n_codes",
        "dominant_source", F.array_join("recommended_action", " | ").alias("actions"))

# --- cascades: the greedy choice is a recursion over the events in turn -------------------
_TURNS = f"""{_EVENTS}, evt as (select *, {S.rank('severity')} as rk, '[' || severity || '] ' ||
 case when length(template_pattern) > 80 then substring(template_pattern, 1, 80) || '...' else template_pattern end
 || ' (' || event_count || ' occurrences)' as title, regexp_replace(event_id, ':[0-9]+$', '') as first_file,
 cast(regexp_extract(event_id, ':([0-9]+)$', 1) as bigint) as first_line,
 list_distinct(list_filter(string_split_regex(lower(template_pattern), '\\s+'), lambda w: w <> '')) as ws from ev),
tn as (select *, row_number() over (order by confidence desc, first_file, first_line) as i from evt),
pg as (select a.i as ai, b.i as bi, a.event_id as leader_id, b.event_id as event_id, b.rk - a.rk as step,
 (epoch_us(greatest(a.start, b.start)) - epoch_us(least(a."end", b."end"))) / 1e6 as gap,
 len(list_intersect(a.ws, b.ws)) as shared, len(list_distinct(list_concat(a.ws, b.ws))) as union_size from tn a join tn b on a.i < b.i),
ps as (select *, round((case when gap <= 0 then 1e0 when gap <= 120 then greatest(0e0, 1e0 - gap / 120e0) else 0e0 end) * 0.5e0
 + (case when step > 0 then least(0.5e0, step * 0.2e0) else 0e0 end) * 0.3e0
 + (case when union_size > 0 then round(shared / union_size * 0.3e0, 3) else 0e0 end) * 0.2e0, 3) as score from pg),
hit as (select * from ps where score >= 0.4e0),
by_later as (select bi, list(ai) as la from hit group by bi),
walk as (select cast(0 as bigint) as i, cast([] as bigint[]) as leads union all
 select w.i + 1, case when l.la is not null and list_has_any(w.leads, l.la) then w.leads else list_append(w.leads, w.i + 1) end
 from walk w left join by_later l on l.bi = w.i + 1 where w.i < (select count(*) from tn)),
ld as (select unnest(leads) as li from walk where i = (select count(*) from tn)),
own as (select bi as i, min(ai) as li from hit where ai in (select li from ld) and bi not in (select li from ld) group by bi
 union all select li, li from ld),
cm as (select li, count(*) as groups, sum(event_count)::bigint as total, min(start) as start, max("end") as "end", max(rk) as mrk
 from own join tn using (i) group by li),
casc as (select t.event_id, case when groups > 1 then '[CASCADE] ' else '' end || title as title,
 case when groups > 1 then 'Cascade of ' || groups || ' related incident groups (' || total || ' total events). ' else '' end || description as description,
 c.start, c."end", case when groups > 1 then least(confidence + 0.1e0, 1e0) else confidence end as confidence,
 case mrk when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity, template_pattern,
 total as event_count, first_file, first_line, groups from cm c join tn t on t.i = c.li)"""
ORACLES["correlate_events"] = f"""with recursive {_TURNS} select leader_id, event_id, score from hit where ai in (select li from ld)"""
ORACLES["cascades"] = f"with recursive {_TURNS} select * from casc"

# entities and actions of the merged events: the same steps over members under their leader's name
_MERGED = f"""{_TURNS}, m_mem as (select m.* exclude (event_id), l.event_id from e_mem m join tn t on m.event_id = t.event_id
 join own o on o.i = t.i join tn l on l.i = o.li){_ENT[len(_SESS):].replace('e_mem', 'm_mem').replace('e_grp', 'casc')},
acts as (select *, list_filter([{_STEPS},
 'Prioritize investigation of service/module: ' || dominant_source || '.',
 case when n_ips > 0 then 'Observed ' || n_ips || ' distinct IP(s); review access logs and rate-limit if necessary.' end,
 case when n_codes > 0 then 'Error tokens observed: ' || replace(codes, ',', ', ') || case when n_codes > 3 then '...' else '' end || '.' end],
 lambda a: a is not null) as s from ent),
rich as (select c.*, a.n_ips, a.n_codes, a.dominant_source, a.s, concat_ws(', ', case when n_ips > 0 then n_ips || ' distinct IP(s)' end,
 case when n_codes > 0 then n_codes || ' error token(s)' end, 'source=' || dominant_source) as bits from casc c join acts a on a.event_id = c.event_id),
told as (select *, description || case when bits <> '' then ' Observed entities: ' || bits || '.' else '' end as summary from rich)"""
ORACLES["enriched_root_causes"] = f"""with recursive {_MERGED} select event_id, title, summary, confidence, severity, event_count,
 n_ips, n_codes, dominant_source, array_to_string(s[1:5], ' | ') as actions from told"""


@query("relationship_groups")
def _(spark, d):
    return rl.relationship_groups(R.reports(spark, d), minutes=60)


_REL = f"""{V.SQL_ENTRIES}, rk as (select file, line_number, coalesce(ip_address, '') as ip, coalesce(error_code, '') as code,
 coalesce(source, '') as src, strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H:%M:%S') as slot from v_entries),
rg as (select ip, code, src, slot, count(*) as size, min((file, line_number)) as seen from rk group by all having count(*) >= 2),
rt as (select *, row_number() over (order by size desc, seen) as group_id from rg)"""
ORACLES["relationship_groups"] = f"""with {_REL} select group_id, case when code || ip || src = '' then 'Relationship group' else
 'Relationship group: ' || concat_ws(', ', case when code <> '' then 'code ' || code end, case when ip <> '' then 'IP ' || ip end,
 case when src <> '' then 'source ' || src end) end as title, ip, code, src, slot, size,
 round(least(1e0, 0.35e0 + size * 0.1e0), 3) as confidence from rt where group_id <= 30"""


@query("relationship_members")
def _(spark, d):
    reports = R.reports(spark, d)
    return rl.relationship_members(reports, rl.relationship_groups(reports, minutes=60), minutes=60)


ORACLES["relationship_members"] = f"""with {_REL} select group_id, file, line_number from rk join rt
 using (ip, code, src, slot) where group_id <= 30"""


@query("incidents")
def _(spark, d):
    groups = rl.relationship_groups(R.anomalies(spark, d), minutes=10)
    return rl.incidents(causes(spark, d)[0], groups).withColumn("actions", F.array_join("actions", " | ")).withColumn(
        "affected_components", F.array_join("affected_components", ","))


_NEAR = f"""{_MERGED}, ik as (select file, line_number, coalesce(ip_address, '') as ip, coalesce(error_code, '') as code,
 coalesce(source, '') as src, strftime({S.bucket('timestamp', 10)}, '%Y-%m-%dT%H:%M:%S') as slot from v_an),
ig as (select ip, code, src, slot, count(*) as size, min((file, line_number)) as seen from ik group by all having count(*) >= 2),
it as (select *, row_number() over (order by size desc, seen) as group_id from ig),
i_first as (select *, row_number() over (order by confidence desc, first_file, first_line) as p from told qualify p <= 8),
i_all as (select title, severity, round(confidence, 3) as confidence, coalesce(dominant_source, '') as affected_components, event_count as log_count,
 summary, array_to_string(s[1:4], ' | ') as actions, 0 as kind, first_file || ':' || lpad(cast(first_line as varchar), 20, '0') as tie from i_first
 union all select case when code || ip || src = '' then 'Relationship group' else 'Relationship group: ' || concat_ws(', ',
 case when code <> '' then 'code ' || code end, case when ip <> '' then 'IP ' || ip end, case when src <> '' then 'source ' || src end) end,
 'MEDIUM', round(least(1e0, 0.35e0 + size * 0.1e0), 3), src, size, {S.q(K.GROUP_SUMMARY)}, {S.q(' | '.join(K.GROUP_ACTIONS))}, 1,
 lpad(cast(group_id as varchar), 20, '0') from it where group_id <= 3 - (select count(*) from i_first))"""
ORACLES["incidents"] = f"""with recursive {_NEAR} select title, severity, confidence, affected_components, log_count, summary, actions from i_all
 order by {S.rank('severity')} desc, confidence desc, kind, tie limit 10"""
