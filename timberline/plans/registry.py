"""All queries and their checks, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline import constants as K
from timberline.operators import anomaly, lines, parse, severity, timeline
from timberline.plans import causes, dashboards, files, parsing, reports, scoring, signals, timing, views
from timberline.session import cut

_MODULES = [parsing, scoring, timing, causes, dashboards, signals, files]
QUERIES = {k: fn for m in _MODULES for k, fn in m.QUERIES.items()}
ORACLES = {k: text for m in _MODULES for k, text in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines to entries, anomalies, severities and a timeline with spikes.

    Merged lines, entries and anomalies are each used several times, so each is
    computed once and checkpointed.
    """
    merged = lines.merge_multiline(views.log_lines(spark, sf_dir))
    entries = cut(parse.parse_entries(merged, default_year=2024))
    scored = anomaly.evaluate_anomalies(entries, reports.WINDOW, reports.THRESHOLD)
    rated = severity.severity_scores(scored, batch=entries)
    found = cut(rated.filter("is_anomaly").select(
        "file", "line_number", "timestamp", "message", "severity", "severity_score"))
    buckets = timeline.timeline(found, hours=24 * 7, minutes=60)
    counts = F.transform(F.lit(list(K.SEVERITY_RANK)), lambda s: F.coalesce(
        F.try_element_at("severity_counts", s), F.lit(0)).cast("string"))
    return buckets.select("bucket_start", "bucket_end", "event_count", "is_spike",
                          F.array_join(counts, ",").alias("severities"))


QUERIES["analyse_lines"] = flagship
# rendered lines have no continuations, so merging leaves them as they are
_PARSED = (parsing.SQL_PARSED.replace("'1900 '", "'2024 '")
           + ", v_entries as (select * from v_parsed)")
ORACLES["analyse_lines"] = f"""with {reports.sql_reports_over(_PARSED)}, an as (select * from v_reports where is_anomaly),
ref as (select max(timestamp) as r, max(timestamp) - interval 168 hours as cut from an),
rec as (select an.*, date_trunc('hour', timestamp) as slot from an, ref where timestamp >= cut),
slots as (select unnest(generate_series(date_trunc('hour', cut), date_trunc('hour', r), interval 1 hour)) as slot from ref),
cnt as (select s.slot, count(r.line_number) as n, {" || ',' || ".join(f"count(*) filter (r.severity = '{s}')" for s in K.SEVERITY_RANK)} as severities
 from slots s left join rec r on s.slot = r.slot group by s.slot)
select slot as bucket_start, slot + interval 1 hour as bucket_end, n as event_count, severities,
 coalesce((n - avg(n) over ()) / nullif(stddev_samp(n) over (), 0) >= 2, false) as is_spike from cnt"""
