"""Queries and checks: raw-line signals, chunks, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.operators import alerts as al, chunks as ch, signals as sg
from timberline.plans import reports as R, sql as S, views as V

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


SIZE = 200  # lines per chunk; the given files are short


def _any(words, x="upper(text)"):
    return S.any_of(x, words)


@query("component_stats")
def _(spark, d):
    return sg.component_stats(V.log_lines(spark, d))


_COMP = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {S.q(p)}, 1), '')" for p in K.COMPONENT_SHAPES) + ")"
_E = _any(["ERROR", "FATAL", "CRITICAL"])
ORACLES["component_stats"] = f"""with {V.SQL_LINES}, c as (select {_COMP} as name, {_E} as e, {_any(['WARN'])} as w, file, line_number from v_log_lines)
select name, count(*) as count, count(*) filter (e) as error_count, count(*) filter (not e and w) as warn_count,
 case when count(*) filter (e) > 5 then 'HIGH' when count(*) filter (e) > 0 then 'MEDIUM' else 'LOW' end as severity
 from c where name is not null group by name order by error_count desc, count desc, min((file, line_number)) limit 20"""


@query("line_severity_dist")
def _(spark, d):
    return sg.line_severity_dist(V.log_lines(spark, d))


_LV = "case " + " ".join(f"when regexp_matches(upper(text), {S.q(p)}) then '{n}'" for n, p in K.SIGNAL_LEVELS) + " else 'UNKNOWN' end"
ORACLES["line_severity_dist"] = f"""with {V.SQL_LINES}, l as (select {_LV} as level, count(*) as n from v_log_lines group by 1),
k as (select unnest({S.words([n for n, _ in K.SIGNAL_LEVELS] + ['UNKNOWN'])}) as level)
select k.level, coalesce(l.n, 0) as count from k left join l on k.level = l.level"""


@query("signal_timeline")
def _(spark, d):
    return sg.signal_timeline(V.log_lines(spark, d)).withColumn("error_rate", F.round("error_rate", 6))


_STAMP = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {S.q(p)}, 1), '')" for p in K.SIGNAL_TIMESTAMPS) + ")"
ORACLES["signal_timeline"] = f"""with {V.SQL_LINES}, s as (select substring({_STAMP}, 1, 10) as time, {_E} as e from v_log_lines)
select time, count(*) as total_count, count(*) filter (e) as error_count, round(count(*) filter (e) / count(*), 6) as error_rate
 from s where time is not null group by time"""


@query("key_snippets")
def _(spark, d):
    return sg.key_snippets(V.log_lines(spark, d), 40)


ORACLES["key_snippets"] = f"""with {V.SQL_LINES}, s as (select file, line_number, cast(case when {_any(['CRITICAL', 'FATAL'])} then 10
 when {_any(['ERROR'])} then 7 when {_any(['WARN'])} then 5 else 0 end + 3 * len({S.hits('lower(text)', K.SNIPPET_WORDS)})
 + case when length(text) > 50 and length(text) < 500 then 1 else 0 end as integer) as score, {S.strip('text')} as snippet from v_log_lines)
select file, line_number, score, snippet from s order by score desc, file, line_number limit 40"""


@query("actionable_patterns")
def _(spark, d):
    return sg.actionable_patterns(V.log_lines(spark, d)).withColumn("commands", F.array_join("commands", " ; "))


_ISSUES = " union all ".join(
    f"select file, '{n}' as issue, " + (
        f"arg_min(regexp_extract(text, {S.q(p)}, 1), line_number) as port" if n == "port_conflict" else "null::varchar as port")
    + f", {S.q(' ; '.join(c))} as commands from v_log_lines where regexp_matches(text, {S.q(p)}) group by file"
    for n, p, c in K.ISSUE_RULES)
ORACLES["actionable_patterns"] = f"""with {V.SQL_LINES}, i as ({_ISSUES})
select file, issue, port, replace(commands, '{{port}}', coalesce(port, '{{port}}')) as commands from i"""


@query("raw_line_metrics")
def _(spark, d):
    return sg.raw_line_metrics(V.log_lines(spark, d))


def _n(p):
    return f"cast(sum(len(regexp_extract_all(text, {S.q(p)}))) as bigint)"


ORACLES["raw_line_metrics"] = f"""with {V.SQL_LINES}, m as (select count(*) filter (regexp_matches(text, '\\S')) as total_logs,
 {_n(r'(?i)\bERROR\b|\bFATAL\b|\bCRITICAL\b')} as error_count, {_n(r'(?i)\bWARN\b|\bWARNING\b')} as warn_count,
 {_n(r'(?i)\bINFO\b')} as info_count, {_n(r'(?i)\bFATAL\b')} as fatal_count from v_log_lines),
r as (select *, round((error_count + fatal_count) / total_logs * 100, 1) as error_rate from m)
select *, cast(case when error_rate > 50 then 85 when error_rate > 20 then 65 when error_count > 0 then 45 else 20 end as integer) as anomaly_score from r"""


@query("bracket_components")
def _(spark, d):
    return sg.bracket_components(V.log_lines(spark, d))


ORACLES["bracket_components"] = f"""with {V.SQL_LINES}, b as (select unnest(regexp_extract_all(text, '\\[(\\w+)\\]', 1)) as component from v_log_lines)
select component, count(*) as failures, case when count(*) > 5 then 'HIGH' when count(*) > 2 then 'MEDIUM' else 'LOW' end as severity
 from b group by component"""


@query("evidence_lines")
def _(spark, d):
    return sg.evidence_lines(V.log_lines(spark, d))


ORACLES["evidence_lines"] = f"""with {V.SQL_LINES}, h as (select * from v_log_lines)
select file, line_number, {S.strip('text')} as log_line from h where {S.any_of('lower(text)', ['error', 'failed', 'exception', 'critical'])}"""


# --- chunks -------------------------------------------------------------------------
_IDX = f"""{V.SQL_LINES}, x as (select file, row_number() over (partition by file order by line_number) - 1 as idx,
 {S.any_of('lower(text)', K.CHUNK_WORDS)} as e, {_any(['ERROR', 'WARN', 'FATAL', 'CRITICAL'])} as h,
 nullif(regexp_extract(text, '\\[(\\w+)\\]', 1), '') as component,
 nullif(regexp_extract(text, '(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '') as dt from v_log_lines),
y as (select *, last_value(dt ignore nulls) over (partition by file order by idx) as day from x),
yy as (select *, case when day is distinct from lag(day) over (partition by file order by idx) then idx end as st from y),
yyy as (select *, last_value(st ignore nulls) over (partition by file order by idx) as since from yy where day is not null)"""
_AGG = "min(idx) as start_index, max(idx) as end_index, count(*) as line_count, count(*) filter (e) as error_count"
_J5 = f"""j5 as (select file, 'error_dense' as chunk_type, 5 as priority, {_AGG},
 floor(idx / {SIZE}) as blk from x group by file, blk having count(*) filter (e) > 0)"""
_J6 = f"j6 as (select file, 'severity_high' as chunk_type, 4 as priority, {_AGG} from x where h group by file)"
_J7 = f"""j7 as (select file, 'component' as chunk_type, 3 as priority, {_AGG}, component from x where component is not null
 group by file, component having count(*) filter (e) > 0 and count(*) >= 5)"""
_J8 = f"""j8i as (select file, 'temporal' as chunk_type, 2 as priority, {_AGG}, day from yyy group by file, day, since),
j8 as (select * from j8i where
 line_count >= 10 and error_count > 0)"""
_CC = "file, chunk_type, cast(priority as integer) as priority, start_index, end_index, line_count, error_count"


def _clash(n, a):
    ov = f"(least({n}.end_index, {a}.end_index) - greatest({n}.start_index, {a}.start_index) + 1)"
    return f"{n}.file = {a}.file and {ov} > 0 and ({ov} > {n}.line_count * 0.5 or {ov} > {a}.line_count * 0.5)"


_MERGED = f"""{_IDX}, {_J5}, {_J6}, {_J7}, {_J8}, a5 as (select {_CC} from j5),
a6 as (select * from a5 union all select {_CC} from j6 n where not exists (select 1 from a5 a where {_clash('n', 'a')})),
a7 as (select * from a6 union all select {_CC} from j7 n where not exists (select 1 from a6 a where {_clash('n', 'a')})),
a8 as (select * from a7 union all select {_CC} from j8 n where not exists (select 1 from a7 a where {_clash('n', 'a')}))"""
_BASE = ["file", "chunk_type", "priority", "start_index", "end_index", "line_count", "error_count"]


def _indexed(spark, d):
    return ch.index_lines(V.log_lines(spark, d))


@query("chunks_error_density")
def _(spark, d):
    return ch.error_density(_indexed(spark, d), SIZE).select(*_BASE)


@query("chunks_severity")
def _(spark, d):
    return ch.severity_chunk(_indexed(spark, d)).select(*_BASE)


@query("chunks_component")
def _(spark, d):
    return ch.component_chunks(_indexed(spark, d)).select(*_BASE, "label")


@query("chunks_temporal")
def _(spark, d):
    return ch.temporal_chunks(_indexed(spark, d)).select(*_BASE, "label")


@query("chunks_merge")
def _(spark, d):
    x = _indexed(spark, d)
    return ch.merge_chunks([ch.error_density(x, SIZE), ch.severity_chunk(x), ch.component_chunks(x),
                            ch.temporal_chunks(x)]).select(*_BASE)


@query("chunks_normal")
def _(spark, d):
    # only the component chunks count as taken, so that something is left over
    x = _indexed(spark, d)
    return ch.normal_chunks(x, ch.temporal_chunks(x, 30), SIZE).select(*_BASE)


@query("chunk_logs")
def _(spark, d):
    return ch.chunk_logs(V.log_lines(spark, d), SIZE).select(*_BASE)


ORACLES["chunks_error_density"] = f"with {_IDX}, {_J5} select {_CC} from j5"
ORACLES["chunks_severity"] = f"with {_IDX}, {_J6} select {_CC} from j6"
ORACLES["chunks_component"] = f"with {_IDX}, {_J7} select {_CC}, component as label from j7"
ORACLES["chunks_temporal"] = f"with {_IDX}, {_J8} select {_CC}, day as label from j8"
ORACLES["chunks_merge"] = f"with {_MERGED} select * from a8"
ORACLES["chunks_normal"] = f"""with {_IDX}, {_J8}, taken as (select * from j8 where line_count >= 30),
un as (select file, idx, row_number() over (partition by file order by idx) - 1 as u from x
 where not exists (select 1 from taken t where t.file = x.file and idx between t.start_index and t.end_index))
select file, 'normal' as chunk_type, cast(1 as integer) as priority, min(idx) as start_index, max(idx) as end_index, count(*) as line_count,
 null::bigint as error_count from un group by file, u // {SIZE}"""

ORACLES["chunk_logs"] = f"""with {_MERGED},
un as (select file, idx, row_number() over (partition by file order by idx) - 1 as u from x
 where not exists (select 1 from a8 t where t.file = x.file and idx between t.start_index and t.end_index))
select * from a8 union all select file, 'normal', cast(1 as integer), min(idx), max(idx), count(*), null::bigint from un group by file, u // {SIZE}"""


# --- alerts -------------------------------------------------------------------------
_RULES = al.DEFAULT_RULES + [al.AlertRule("Medium rows", "MEDIUM", None, 7200), al.AlertRule("Off", "LOW", None, 1, False)]


def _reports(spark, d):
    return R.reports(spark, d)


@query("alert_matches")
def _(spark, d):
    return al.alert_matches(_reports(spark, d), _RULES)


def _rule_sql():
    out = []
    for r in _RULES:
        if not r.enabled:
            continue
        tests = []
        if r.keyword:
            tests.append(f"when contains(lower(message), {S.q(r.keyword)}) then {S.q(f'Message matched keyword {chr(39)}{r.keyword}{chr(39)}')}")
        if r.severity:
            tests.append(f"when severity = '{r.severity}' then 'Severity ' || severity || ' matched threshold'")
        out.append(f"select {S.q(r.name)} as rule, cast({r.cooldown_seconds} as integer) as cooldown_seconds, timestamp, file, line_number, severity, "
                   f"message, case {' '.join(tests)} end as details from v_reports")
    return "(" + " union all ".join(out) + ")"


_MATCHES = f"{R.SQL_REPORTS}, matches as (select * from {_rule_sql()} where details is not null)"
ORACLES["alert_matches"] = f"with {_MATCHES} select * from matches"


@query("alert_cooldown")
def _(spark, d):
    return al.alert_cooldown(al.alert_matches(_reports(spark, d), _RULES))


ORACLES["alert_cooldown"] = f"""with recursive {_MATCHES},
thin as materialized (select * from (select *, date_trunc('second', timestamp) as second, row_number() over (partition by rule, date_trunc('second', timestamp)
 order by timestamp, file, line_number) as rn from matches) where rn = 1),
fired as (select rule, any_value(cooldown_seconds) as cd, min(second) as second from thin group by rule
 union all select f.rule, f.cd, (select min(t.second) from thin t where t.rule = f.rule and t.second >= f.second + to_seconds(f.cd)) as second
 from fired f where exists (select 1 from thin t where t.rule = f.rule and t.second >= f.second + to_seconds(f.cd)))
select t.rule, t.cooldown_seconds, t.second, t.timestamp, t.file, t.line_number, t.severity, t.message, t.details
 from thin t join fired f on t.rule = f.rule and t.second = f.second"""
