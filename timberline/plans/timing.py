"""Queries and checks: time buckets, timelines, temporal patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.functions import timing as M
from timberline.operators import patterns as pt, timeline as tl
from timberline.plans import reports as R, sql as S, views as V

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


KEY = ["file", "line_number"]
GAP = 1800      # run gap in seconds, wide because the events are sparse
RARE = 0.1


@query("time_bucket")
def _(spark, d):
    return V.entries(spark, d).select(
        *KEY, M.time_bucket("timestamp", 15).alias("quarter"), M.time_bucket("timestamp", 60).alias("hour"))


ORACLES["time_bucket"] = f"""with {V.SQL_ENTRIES} select file, line_number, time_bucket(interval 15 minutes, timestamp) as quarter,
 date_trunc('hour', timestamp) as hour from v_entries"""


def _timeline(spark, d):
    return tl.timeline(R.anomalies(spark, d), hours=48, minutes=15)


@query("timeline")
def _(spark, d):
    top = F.transform("top_events", lambda e: F.concat_ws(
        ":", e["line_number"].cast("string"), e["severity"], e["message"]))
    sev = F.array_join(F.transform(
        F.array(*[F.lit(s) for s in K.SEVERITY_RANK]),
        lambda s: F.coalesce(F.try_element_at("severity_counts", s), F.lit(0)).cast("string")), ",")
    return _timeline(spark, d).select(
        "bucket_start", "bucket_end", "event_count", "is_spike", sev.alias("severities"),
        F.coalesce(F.array_join(top, " | "), F.lit("")).alias("top"))


_TL = f"""{R.SQL_ANOMALIES}, ref as (select max(timestamp) as r, max(timestamp) - interval 48 hours as cut from v_anom),
rec as (select v_anom.*, time_bucket(interval 15 minutes, timestamp) as slot, {S.rank('severity')} as rk from v_anom, ref where timestamp >= cut),
slots as (select unnest(generate_series(time_bucket(interval 15 minutes, cut), time_bucket(interval 15 minutes, r), interval 15 minutes)) as slot from ref),
top5 as (select slot, string_agg(line_number || ':' || severity || ':' || substring(message, 1, 200), ' | ' order by rk desc, line_number) as top
 from (select *, row_number() over (partition by slot order by rk desc, line_number) as p from rec) where p <= 5 group by slot),
cnt as (select s.slot, count(r.line_number) as n,
 {" || ',' || ".join(f"count(*) filter (r.severity = '{s}')" for s in K.SEVERITY_RANK)} as severities
 from slots s left join rec r on s.slot = r.slot group by s.slot),
tl as (select c.*, t.top, coalesce((n - avg(n) over ()) / nullif(stddev_samp(n) over (), 0) >= 2, false) as is_spike
 from cnt c left join top5 t on c.slot = t.slot)"""
ORACLES["timeline"] = f"""with {_TL} select slot as bucket_start, slot + interval 15 minutes as bucket_end, n as event_count,
 is_spike, severities, coalesce(top, '') as top from tl"""


@query("spike_markers")
def _(spark, d):
    return tl.spike_markers(_timeline(spark, d))


ORACLES["spike_markers"] = f"with {_TL} select slot as bucket_start, is_spike from tl"


@query("log_volume_trend")
def _(spark, d):
    return tl.log_volume_trend(R.reports(spark, d), hours=72)


ORACLES["log_volume_trend"] = f"""with {V.SQL_ENTRIES}, rec as (select time_bucket(interval 15 minutes, timestamp) as slot, count(*) as n
 from v_entries where timestamp >= (select max(timestamp) - interval 72 hours from v_entries) group by 1),
slots as (select unnest(generate_series(min(slot), max(slot), interval 15 minutes)) as slot from rec)
select s.slot as bucket_start, coalesce(n, 0) as count from slots s left join rec r on s.slot = r.slot"""

def _plain():
    return ["insight_type", "title", "summary", F.round("confidence", 6).alias("confidence")]


def _flat(df, *keys):
    return df.select(*_plain(), *[F.col("evidence")[k].alias(k) for k in keys])


def _timed(spark, d):
    return pt.timed_anomalies(R.anomalies(spark, d))


_ISO = "'%Y-%m-%dT%H:%M:%S'"
_SPIKE = f"""p_slots as (select unnest(generate_series(min(time_bucket(interval 15 minutes, timestamp)),
 max(time_bucket(interval 15 minutes, timestamp)), interval 15 minutes)) as slot from v_anom),
p_cnt as (select s.slot, count(a.line_number) as c from p_slots s left join v_anom a
 on time_bucket(interval 15 minutes, a.timestamp) = s.slot group by s.slot),
p_z as (select *, avg(c) over () as m, (c - avg(c) over ()) / nullif(stddev_samp(c) over (), 0) as z from p_cnt),
p_spike as (select *, least(1e0, 0.45e0 + z * 0.1e0) as conf from p_z where z >= 2 and c > 0 order by conf desc, slot limit 1),
i_spike as (select 'frequency_spike' as insight_type, 'Anomaly spike at ' || strftime(slot, '%Y-%m-%dT%H:%M') as title,
 printf('Anomaly volume reached %d events within the 15m bucket; this is %.1fσ above the local average (%.1f).', c, z, m) as summary,
 round(conf, 6) as confidence, strftime(slot, {_ISO}) as bucket_start, cast(c as varchar) as event_count from p_spike)"""
_RUNS = f"""q_prev as (select *, lag(timestamp) over o as pts, lag(template) over o as ptm from v_anom window o as (order by timestamp, file, line_number)),
q_flag as (select *, case when ptm = template and epoch_us(timestamp) - epoch_us(pts) <= {GAP} * 1000000 then 0 else 1 end as f from q_prev),
q_run as (select *, sum(f) over (order by timestamp, file, line_number) as run from q_flag),
q_agg as (select run, count(*) as n, min(timestamp) as a, max(timestamp) as b, min(template) as template from q_run group by run having count(*) >= 3),
q_top as (select *, least(1e0, 0.35e0 + n * 0.08e0) as conf from q_agg order by conf desc, run limit 2),
i_runs as (select 'repeating_sequence' as insight_type, 'Repeating error sequence detected' as title,
 printf('A template recurred %d times within ~%ds. This suggests a systematic trigger rather than a single transient fault.',
 n, cast(floor((epoch_us(b) - epoch_us(a)) / 1000000) as bigint)) as summary, round(conf, 6) as confidence,
 template, strftime(a, {_ISO}) as start from q_top)"""
_PAIRS = """r_seen as (select distinct time_bucket(interval 30 minutes, timestamp) as slot, template from v_anom),
r_pairs as (select a.template as ta, b.template as tb, count(*) as k, min(a.slot) as first from r_seen a join r_seen b
 on a.slot = b.slot and a.template < b.template group by 1, 2 having count(*) >= 2 order by k desc, first, ta, tb limit 1),
i_pairs as (select 'correlated_anomalies' as insight_type, 'Correlated anomaly templates' as title,
 printf('Templates co-occurred in the same time windows %d times. This may indicate a shared underlying failure mode.', k) as summary,
 round(least(1e0, 0.3e0 + k * 0.15e0), 6) as confidence, ta as template_a, tb as template_b, cast(k as varchar) as cooccurrence_windows from r_pairs)"""
_GAPS = f"""s_gap as (select cast(floor((epoch_us(timestamp) - epoch_us(lag(timestamp) over o)) / 1000000) as bigint) as gap,
 lag(timestamp) over o as a, timestamp as b from v_anom window o as (order by timestamp, file, line_number)),
s_st as (select avg(gap) as m, stddev_samp(gap) as sd from s_gap where gap is not null),
s_top as (select *, (gap - m) / sd as z from s_gap, s_st where gap is not null order by gap desc, b limit 1),
i_gap as (select 'unusual_time_gap' as insight_type, 'Unusual pause between anomalies' as title,
 printf('Consecutive anomalies are separated by %ds, which is %.1fσ above the typical gap (%.1fs).', gap, z, m) as summary,
 round(least(1e0, 0.35e0 + z * 0.1e0), 6) as confidence, cast(gap as varchar) as gap_seconds, strftime(a, {_ISO}) as start from s_top where z >= 2)"""
_RARE = f"""u_cnt as (select template, count(*) as c, min((timestamp, file, line_number)) as seen from v_anom group by template),
u_rare as (select * from u_cnt where c >= 2 and c / (select count(*) from v_anom) <= {RARE} order by c, seen limit 3),
i_rare as (select 'rare_templates' as insight_type, 'Rare log template activity' as title,
 'A small number of templates appear infrequently, which may indicate a secondary or edge-case failure mode.' as summary,
 0.4e0 as confidence, string_agg(template || ' x' || c, '; ' order by c, seen) as rare_templates from u_rare having count(*) > 0)"""


@query("pattern_spike")
def _(spark, d):
    return _flat(pt.spike(_timed(spark, d)), "bucket_start", "event_count")


@query("repeating_sequences")
def _(spark, d):
    steps = pt.ordered_steps(_timed(spark, d))
    return _flat(pt.repeating_sequences(steps, GAP), "template", "start")


@query("correlated_templates")
def _(spark, d):
    return _flat(pt.correlated_templates(_timed(spark, d)), "template_a", "template_b", "cooccurrence_windows")


@query("unusual_gap")
def _(spark, d):
    return _flat(pt.unusual_gap(pt.ordered_steps(_timed(spark, d))), "gap_seconds", "start")


@query("rare_templates")
def _(spark, d):
    return _flat(pt.rare_templates(_timed(spark, d), RARE), "rare_templates")


@query("detect_patterns")
def _(spark, d):
    found = pt.detect_patterns(R.anomalies(spark, d), gap_seconds=GAP, rare_share=RARE)
    return found.select("position", *_plain())


ORACLES["pattern_spike"] = f"with {R.SQL_ANOMALIES}, {_SPIKE} select * from i_spike"
ORACLES["repeating_sequences"] = f"with {R.SQL_ANOMALIES}, {_RUNS} select * from i_runs"
ORACLES["correlated_templates"] = f"with {R.SQL_ANOMALIES}, {_PAIRS} select * from i_pairs"
ORACLES["unusual_gap"] = f"with {R.SQL_ANOMALIES}, {_GAPS} select * from i_gap"
ORACLES["rare_templates"] = f"with {R.SQL_ANOMALIES}, {_RARE} select * from i_rare"
_COLS = "insight_type, title, summary, confidence"
ORACLES["detect_patterns"] = f"""with {R.SQL_ANOMALIES}, {_SPIKE}, {_RUNS}, {_PAIRS}, {_GAPS}, {_RARE}
select 1 as position, {_COLS} from i_spike union all select 2, {_COLS} from i_runs union all select 3, {_COLS} from i_pairs
union all select 4, {_COLS} from i_gap union all select 5, {_COLS} from i_rare"""
