"""Queries and checks over files written from the given tables: scans, stores, streams."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.operators import deep as dp
from timberline.plans import reports as R, signals as SG, sql as S, views as V
from timberline.session import scratch_dir
from timberline.sources import json_logs as js, labeled as lb, reports as rp, text as tx
from timberline.streaming import alerts as sa, counts as sc, monitor as mo, tail as tl

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


SEGMENT = 4000  # event ids per written file
_PATH = r"file=([^/]+)/seg=(\d+)/"
_written: dict[tuple, str] = {}


def _once(spark: SparkSession, d: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        path = scratch_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _segments(df: DataFrame, path: str) -> None:
    """One text file per (file, seg), lines in order, each file from one bounded segment."""
    (df.repartition("file", "seg").sortWithinPartitions("file", "seg", "line_number")
     .select("text", "file", "seg").write.partitionBy("file", "seg").text(path))


def _seg(lines: DataFrame) -> DataFrame:
    return lines.withColumn("seg", F.floor((F.col("line_number") - 1) / SEGMENT))


def line_files(spark, d) -> str:
    """Rendered lines as text files, every 17th one blank."""
    lines = _seg(V.log_lines(spark, d)).withColumn(
        "text", F.when(F.col("line_number") % 17 == 0, "").otherwise(F.col("text")))
    return _once(spark, d, "lines", lambda p: _segments(lines, p))


def _place(df: DataFrame) -> DataFrame:
    """Path parts in place of the full path, which changes from run to run."""
    return df.select(F.regexp_extract("file", _PATH, 1).alias("file"),
                     F.regexp_extract("file", _PATH, 2).cast("bigint").alias("seg"),
                     *[c for c in df.columns if c != "file"])


_FILES = f"""{V.SQL_LINES}, w as (select file, cast(floor((line_number - 1) / {SEGMENT}) as bigint) as seg, line_number as id,
 case when line_number % 17 = 0 then '' else text end as text from v_log_lines),
n as (select file, seg, row_number() over (partition by file, seg order by id) as line_number, text from w)"""


@query("scan_lines")
def _(spark, d):
    return _place(tx.scan_lines(spark, line_files(spark, d)))


ORACLES["scan_lines"] = f"with {_FILES} select file, seg, line_number, text from n where text <> ''"


@query("scan_encodings")
def _(spark, d):
    """Every event's message in three encodings, each read back as it was written."""
    kinds = {"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "ISO-8859-1": "latin-1"}
    found = None
    for name, codec in kinds.items():
        texts = V._events(spark, d).select(F.floor(F.col("event_id") / SEGMENT).alias("seg"), "event_id", F.concat(
            F.lit("\u00e9 "), "message").alias("text"))

        path = _once(spark, d, f"enc-{name}", lambda p: texts.withColumn("path", F.concat(F.lit(f"{p}/file={name}/seg="), "seg", F.lit("/a.txt")))
                     .groupBy("path").applyInArrow(_encoder(codec), "path string, data binary").foreachPartition(_write_bytes))
        rows = _place(tx.scan_lines(spark, path, encoding=name)).select("file", "seg", "line_number", "text")
        found = rows if found is None else found.unionByName(rows)
    return found


def _encoder(codec: str):
    def encode(table: pa.Table) -> pa.Table:
        return pa.table({"path": [table["path"][0].as_py()], "data": [b"".join(
            (r["text"] + "\n").encode(codec) for r in sorted(table.to_pylist(), key=lambda r: r["event_id"]))]})

    return encode


def _write_bytes(rows) -> None:
    import os

    for r in rows:
        path = re.sub("^file:/*", "/", r["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(r["data"])


ORACLES["scan_encodings"] = f"""with {V.SQL_EVENTS}, e as (select event_id // {SEGMENT} as seg, event_id, 'é ' || message as text from v_ev),
n as (select cast(seg as bigint) as seg, row_number() over (partition by seg order by event_id) as line_number, text from e)
select unnest(['UTF-16LE', 'UTF-16BE', 'ISO-8859-1']) as file, seg, line_number, text from n"""


@query("scan_filter")
def _(spark, d):
    return _place(tx.scan_filter(spark, line_files(spark, d)).select("file"))


ORACLES["scan_filter"] = f"with {_FILES} select distinct file, seg from n"


@query("dir_scan")
def _(spark, d):
    flat = _once(spark, d, "flat", lambda p: V.log_lines(spark, d).select("text").repartition(7).write.text(p))
    return tx.dir_scan(spark, flat).select(F.regexp_extract("file", r"/(part-\d+)", 1).alias("part"))


ORACLES["dir_scan"] = f"with {V.SQL_LINES} select distinct 'part-0000' || (row_number() over () % 7) as part from v_log_lines"


def json_files(spark, d) -> str:
    """JSON lines in the even segments, one JSON array per file in the odd ones."""
    lines = _seg(V.json_lines(spark, d))
    first = F.min("line_number").over
    from pyspark.sql import Window
    seg = Window.partitionBy("file", "seg")  # a segment is bounded
    lo, hi = first(seg), F.max("line_number").over(seg)
    is_array = F.col("seg") % 2 == 1
    item = F.when(F.col("text").startswith("{"), F.col("text")).otherwise(
        F.concat(F.lit('"'), "text", F.lit('"')))
    text = F.when(is_array, F.concat(
        F.when(F.col("line_number") == lo, "[").otherwise(""), item,
        F.when(F.col("line_number") == hi, "]").otherwise(","))).otherwise(F.col("text"))
    return _once(spark, d, "json", lambda p: _segments(lines.withColumn("text", text), p))


_JSON = f"""{V.SQL_JSON_LINES}, w as (select file, cast(floor((line_number - 1) / {SEGMENT}) as bigint) as seg, line_number as id, text
 from v_json_lines),
n as (select file, seg, row_number() over (partition by file, seg order by id) as line_number, text from w),
k as (select * from n where seg % 2 = 0 or starts_with(text, '{{'))"""


@query("json_scan")
def _(spark, d):
    return _place(js.json_scan(spark, json_files(spark, d)))


ORACLES["json_scan"] = f"with {_JSON} select file, seg, line_number, text from k"


@query("json_entries")
def _(spark, d):
    return _place(js.json_entries(js.json_scan(spark, json_files(spark, d)))).select(
        "file", "seg", "line_number", "timestamp", "log_level", "message", "source", "log_type")


ORACLES["json_entries"] = f"""with {_JSON} select file, seg, line_number, try_cast(replace(json_extract_string(text, '$.timestamp'), 'Z', '') as timestamp) as timestamp,
 case json_extract_string(text, '$.level') when 'debug' then 'DEBUG' when 'info' then 'INFO' when 'warning' then 'WARNING' when 'error' then 'ERROR'
 else 'CRITICAL' end as log_level, json_extract_string(text, '$.msg') as message, json_extract_string(text, '$.service') as source, 'JSON' as log_type
 from k where json_valid(text)"""

_TRUTH = "case event_id % 4 when 0 then ' True' when 1 then 'yes' when 2 then '1' else 'no' end"


@query("labeled_csv")
def _(spark, d):
    rows = V._events(spark, d).selectExpr("message", f"{_TRUTH} as is_anomaly", "lower(level) || ' ' as severity")
    path = _once(spark, d, "labeled", lambda p: rows.write.csv(
        p, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return lb.labeled_csv(spark, path)


ORACLES["labeled_csv"] = f"""with {V.SQL_EVENTS} select message, event_id % 4 <> 3 as is_anomaly, level as severity from v_ev"""


@query("gen_logs")
def _(spark, d):
    ev = V.table(spark, d, "events").select("event_id", "ts")
    made = lb.generate_labeled(ev, "event_id")
    return made.join(lb.generate_lines(ev, "event_id"), "id")


def _draw(salt, n):
    return f"((((event_id * 7919 + {salt} * 104729) % 1000003) * 31 + {salt}) % {n})"


def _filled(items):
    x = f"({S.words(items)})[{_draw(2, 8)} + 1]"
    for name, v in {"id": f"100 + {_draw(3, 900)}", "pid": f"1000 + {_draw(4, 9000)}", "ip": f"1 + {_draw(5, 254)}",
                    "ms": f"1 + {_draw(6, 50)}"}.items():
        x = f"replace({x}, '{{{name}}}', cast({v} as varchar))"
    return x


ORACLES["gen_logs"] = f"""select event_id as id, {_draw(1, 100)} < 25 as is_anomaly,
 case when {_draw(1, 100)} < 25 then {_filled(lb.ANOMALOUS)} else {_filled(lb.NORMAL)} end as message,
 case when {_draw(1, 100)} < 25 then case when {_draw(7, 2)} = 0 then 'HIGH' else 'CRITICAL' end
 else case when {_draw(7, 2)} = 0 then 'LOW' else 'MEDIUM' end end as severity,
 strftime(ts, '%Y-%m-%d %H:%M:%S') || ' app.service [1]: ' || ({S.words(lb.LEVELS)})[{_draw(8, 5)} + 1]
 || ': item ' || event_id || ' handled, checksum ' || {_draw(9, 10000)} as line from events"""


# --- stored reports -------------------------------------------------------------------
def _created():
    # stored a day after the event, so that recent rows can be told apart
    return F.col("timestamp") + F.expr("interval 1 day")


def report_table(spark, d) -> DataFrame:
    path = _once(spark, d, "table", lambda p: rp.write_reports(R.explained(spark, d), p, _created()))
    return rp.read_reports(spark, path)


@query("write_reports")
def _(spark, d):
    return report_table(spark, d).select(
        "file", "line_number", "timestamp", "log_level", "message", "source", F.round("anomaly_score", 6).alias("anomaly_score"),
        "severity", "created_at", F.col("event_date").cast("string").alias("event_date"))


ORACLES["write_reports"] = f"""with {R.SQL_REPORTS} select file, line_number, timestamp, log_level, message, source, round(confidence, 6) as anomaly_score,
 severity, timestamp + interval 1 day as created_at, strftime(timestamp, '%Y-%m-%d') as event_date from v_reports"""


@query("recent_reports")
def _(spark, d):
    return rp.recent_reports(report_table(spark, d), hours=96).select(
        "file", "line_number", "timestamp", "log_level", "severity", "is_anomaly", F.round("confidence", 6).alias("confidence"),
        F.col("explanation.summary").alias("summary"), F.element_at("explanation.remediation", 1).alias("first_step"))


ORACLES["recent_reports"] = f"""with {R.SQL_EXPLAINED} select file, line_number, timestamp, log_level, severity, confidence > 0.5e0 as is_anomaly,
 round(confidence, 6) as confidence, summary, remediation[1] as first_step from v_explained
 where timestamp >= (select max(timestamp) - interval 96 hours from v_entries)"""


@query("report_json")
def _(spark, d):
    # the seven fields of the text read back in one pass over it
    fields = {"time": "log_entry.timestamp", "level": "log_entry.log_level", "message": "log_entry.message",
              "type": "anomaly.anomaly_type", "severity": "severity.level", "summary": "explanation.summary",
              "step": "explanation.remediation"}
    shape = ("log_entry struct<timestamp string, log_level string, message string>, anomaly struct<anomaly_type string>, "
             "severity struct<level string>, explanation struct<summary string, remediation array<string>>")
    back = rp.report_json(R.explained(spark, d)).select("file", "line_number", F.from_json("json", shape).alias("j"))
    return back.select("file", "line_number", *[
        (F.get(f"j.{path}", F.lit(0)) if name == "step" else F.col(f"j.{path}")).alias(name) for name, path in fields.items()])


ORACLES["report_json"] = f"""with {R.SQL_EXPLAINED} select file, line_number, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') as time,
 log_level as level, message, anomaly_type as type, severity, summary, remediation[1] as step from v_explained"""


@query("deep_explanations")
def _(spark, d):
    return dp.deep_explanations(R.explained(spark, d), gap_seconds=1800, pattern_gap_seconds=1800).select(
        "file", "line_number", "summary", "confidence_score", "confidence_label", "why_it_matters",
        "technical_explanation", F.array_join("possible_causes", " | ").alias("causes"),
        F.array_join("remediation", " | ").alias("steps"))


# --- streams -------------------------------------------------------------------------
def _drain(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a streaming result to its end and read what it wrote."""
    out, state = scratch_dir(spark, name), scratch_dir(spark, name + "-state")
    started = (stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
               .trigger(availableNow=True).start(out))
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("dir_stream")
def _(spark, d):
    lines = tl.dir_stream(spark, line_files(spark, d), recursive=True).filter("text <> ''").select("file", "text")
    return _place(_drain(lines, spark, "dir-stream"))


ORACLES["dir_stream"] = f"with {_FILES} select file, seg, text from n where text <> ''"


@query("tail_stream")
def _(spark, d):
    return _place(_drain(tl.tail_stream(spark, line_files(spark, d), from_start=True, recursive=True).drop("block"), spark, "tail-stream"))


ORACLES["tail_stream"] = ORACLES["dir_stream"]


@query("stream_reports")
def _(spark, d):
    lines = tl.dir_stream(spark, line_files(spark, d), recursive=True)
    out, state = scratch_dir(spark, "monitor"), scratch_dir(spark, "monitor-state")
    mo.run_monitor(lines, out, state, window_seconds=R.WINDOW, threshold=R.THRESHOLD).awaitTermination()
    return _place(spark.read.parquet(out).select(
        "file", "line_number", "timestamp", "log_level", "severity", "anomaly_score", "explanation"))


def _time_files(spark, d, name, rows: DataFrame, column: str) -> str:
    """Rows as parquet files for a stream."""
    return _once(spark, d, name, lambda p: rows.repartitionByRange(column).write.parquet(p))


def _row_stream(spark, path) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("stream_alerts")
def _(spark, d):
    path = _time_files(spark, d, "alert-rows", R.reports(spark, d).select(
        "timestamp", "file", "line_number", "severity", "message"), "timestamp")
    stream = _row_stream(spark, path)
    fired = _drain(sa.stream_alerts(stream, SG._RULES), spark, "alerts")
    return fired.select("rule", F.col("second").cast("timestamp_ntz").alias("second"), "matches")


ORACLES["stream_alerts"] = SG.ORACLES["alert_cooldown"].replace(
    "thin as materialized (select * from (select *,", "thin as materialized (select * from (select *, count(*) over (partition by rule, date_trunc('second', timestamp)) as matches,").replace(
    "select t.rule, t.cooldown_seconds, t.second, t.timestamp, t.file, t.line_number, t.severity, t.message, t.details",
    "select t.rule, t.second, t.matches")


@query("stream_counts")
def _(spark, d):
    events = _time_files(spark, d, "event-rows", V.entries(spark, d).select("timestamp", "file", "line_number"), "timestamp")
    spikes = _drain(sc.spike_windows(_row_stream(spark, events), 3600, R.THRESHOLD), spark, "spikes")
    return spikes


# a window is given out once the watermark, ten minutes behind the newest row, has passed it
_DONE = "<= (select max(ts) - interval 10 minutes from events)"
ORACLES["stream_counts"] = f"""with c as (select time_bucket(interval 1 hour, ts) as start, count(*) as count from events group by 1)
select start, start + interval 1 hour as "end", count, count >= {R.THRESHOLD} as is_spike from c where start + interval 1 hour {_DONE}"""


@query("stream_requests")
def _(spark, d):
    path = _time_files(spark, d, "request-rows", V.requests(spark, d), "ts")
    return _drain(sc.sliding_requests(_row_stream(spark, path), "1 hour", "30 minutes"), spark, "requests").withColumn(
        "avg_latency_ms", F.round("avg_latency_ms", 6))


ORACLES["stream_requests"] = f"""with e as (select *, event_type = 'error' as bad from events),
w as (select time_bucket(interval 30 minutes, ts) as start, * from e union all
 select time_bucket(interval 30 minutes, ts) - interval 30 minutes, * from e)
select start, start + interval 1 hour as "end", count(*) as requests, count(*) filter (bad) as failed, round(avg(value), 6) as avg_latency_ms,
 max(value) as max_latency_ms, quantile_disc(value, 0.95) as p95_latency_ms from w where start + interval 1 hour {_DONE} group by start"""


@query("stream_sessions")
def _(spark, d):
    path = _time_files(spark, d, "anomaly-rows", R.anomalies(spark, d).select("timestamp", "template"), "timestamp")
    return _drain(sc.session_groups(_row_stream(spark, path), 1800), spark, "sessions")


ORACLES["stream_sessions"] = f"""with {R.SQL_ANOMALIES}, sp as (select template, timestamp, lag(timestamp) over (partition by template order by timestamp) as pts from v_anom),
sf as (select *, sum(case when pts is not null and epoch_us(timestamp) - epoch_us(pts) < 1800 * 1000000 then 0 else 1 end)
 over (partition by template order by timestamp) as run from sp)
select template, min(timestamp) as start, max(timestamp) as "end", count(*) as event_count from sf group by template, run
 having max(timestamp) + interval 1800 seconds <= (select max(timestamp) - interval 10 minutes from v_anom)"""
