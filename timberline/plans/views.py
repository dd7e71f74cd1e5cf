"""Log-shaped views over the given tables.

The tables hold no log text, so every view renders log lines or typed entries from
their rows with plain expressions. The same expressions, with the few dialect
differences listed in ``DIALECTS``, make the views for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timberline.session import scratch_dir

DIALECTS = {
    "spark": {
        "python_ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')",
        "iso_ts": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
        "syslog_ts": "date_format(ts, 'MMM d HH:mm:ss')",
        "access_ts": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
        "windows_ts": "date_format(ts, 'M/d/yyyy h:mm:ss a')",
        "apache_ts": "date_format(ts, 'MMM dd HH:mm:ss yyyy')",
        "hex": "hex(event_id + 4294967296)",
    },
    "duckdb": {
        "python_ts": "strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || strftime(ts, '%g')",
        "iso_ts": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
        "syslog_ts": "strftime(ts, '%b %-d %H:%M:%S')",
        "access_ts": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
        "windows_ts": "strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')",
        "apache_ts": "strftime(ts, '%b %d %H:%M:%S %Y')",
        "hex": "to_hex(event_id + 4294967296)",
    },
}

_N = "cast({} as string)"


def _s(expr: str) -> str:
    return _N.format(expr)


_V = _s("cast(floor(value) as bigint)")
_IP = f"'10.0.' || {_s('user_id % 4')} || '.' || {_s('event_id % 250')}"

LEVEL = """case when event_type = 'error' then case when value >= 80 then 'CRITICAL' else 'ERROR' end
 when event_type = 'click' then case when value >= 60 then 'WARNING' else 'INFO' end
 when event_type = 'view' then 'DEBUG' else 'INFO' end"""

SOURCE = """case user_id % 5 when 0 then 'auth' when 1 then 'orders' when 2 then 'billing'
 when 3 then 'search' else 'gateway' end"""


def message(dialect: str) -> str:
    """Eight failure messages and eight everyday ones."""
    hexa = DIALECTS[dialect]["hex"]
    return f"""case when event_type = 'error' then case event_id % 8
 when 0 then 'Database connection failed for host ' || {_IP} || ' after ' || {_V} || ' ms error code: E50' || {_s('event_id % 7')}
 when 1 then 'Connection refused by ' || {_IP} || ':5432 while opening session ' || {_s('event_id')}
 when 2 then 'Failed password for user u' || {_s('user_id')} || ' from ' || {_IP} || ' port ' || {_s('4000 + event_id % 100')}
 when 3 then 'Out of memory: killed process ' || {_s('event_id')} || ' (worker)'
 when 4 then 'Request timed out after ' || {_V} || 's at /api/v1/orders/' || {_s('event_id')}
 when 5 then 'Unhandled exception in payment module, ERR-' || {_s('500 + event_id % 7')} || ' token 0x' || {hexa}
 when 6 then 'Permission denied: user u' || {_s('user_id')} || ' cannot read "/etc/app/conf-' || {_s('user_id % 3')} || '.yml"'
 else 'No space left on device /dev/sda' || {_s('user_id % 3')} || ' code=ENOSPC' end
 else case event_id % 8
 when 0 then 'Session opened for u' || {_s('user_id')} || ' from ' || {_IP}
 when 1 then 'Page rendered in ' || {_V} || 'ms'
 when 2 then 'Heartbeat of the worker received'
 when 3 then 'Cached copy served for basket_' || {_s('event_id')}
 when 4 then 'Scheduled job completed: cleanup run ' || {_s('user_id % 9')}
 when 5 then 'Service restarting on node ' || {_s('user_id % 3')} || ' after sigterm'
 when 6 then 'Fetched https://shop.example.com/item/' || {_s('event_id')} || ' for ops@example.com in ' || {_s('event_id % 90')} || '.5 s'
 else 'Deadlock retry scheduled on table orders, address already in use 0.0.0.0:' || {_s('8000 + user_id % 3')} end end"""


def json_line(dialect: str) -> str:
    """Every event as a JSON object, every 41st as free text."""
    d = DIALECTS[dialect]
    status = "case when event_type = 'error' then '500' when event_type = 'view' then '404' else '200' end"
    quoted = "replace(message, '\"', '\\\\\"')" if dialect == "spark" else "replace(message, '\"', '\\\"')"
    return f"""case when event_id % 41 = 0 then 'free text note ' || {_s('event_id')} || ' from ' || source
 else '{{"timestamp":"' || {d['iso_ts']} || 'Z","level":"' || lower(level) || '","msg":"' || {quoted} || '","service":"' || source
 || '","status":' || {status} || '}}' end"""


def raw_line(dialect: str) -> str:
    """One line format per file, every 41st line free text."""
    d = DIALECTS[dialect]
    proc = _s("1000 + user_id")
    status = "case when event_type = 'error' then '500' when event_type = 'view' then '404' else '200' end"
    word = """case level when 'CRITICAL' then 'Critical' when 'ERROR' then 'Error'
 when 'WARNING' then 'Warning' when 'INFO' then 'Information' else 'Verbose' end"""
    quoted = "replace(message, '\"', '\\\\\"')" if dialect == "spark" else "replace(message, '\"', '\\\"')"
    return f"""case when event_id % 41 = 0 then 'free text note ' || {_s('event_id')} || ' from ' || source
 when user_id % 8 = 0 then {d['python_ts']} || ' - ' || source || ' - ' || level || ' - ' || message
 when user_id % 8 = 1 then {d['iso_ts']} || 'Z ' || level || ' [' || source || '] ' || message
 when user_id % 8 = 2 then {d['syslog_ts']} || ' host' || {_s('user_id % 3')} || ' ' || source || '[' || {proc} || ']: ' || level || ': ' || message
 when user_id % 8 = 3 then {_IP} || ' - u' || {_s('user_id')} || ' [' || {d['access_ts']} || ' +0000] "GET /api/item/' || {_s('event_id')} || ' HTTP/1.1" ' || {status} || ' ' || {_V} || ' "-" "agent/1.0"'
 when user_id % 8 = 4 then level || ': ' || message
 when user_id % 8 = 5 then '{{"timestamp":"' || {d['iso_ts']} || 'Z","level":"' || lower(level) || '","msg":"' || {quoted} || '","service":"' || source || '","status":' || {status} || '}}'
 when user_id % 8 = 6 then {word} || ' ' || {d['windows_ts']} || ' ' || source || ' ' || {proc} || ' ' || message
 else '[' || {d['apache_ts']} || '] [core:' || lower(level) || '] [pid ' || {proc} || '] [client ' || {_IP} || '] ' || message end"""


FILE = f"'app-' || {_s('user_id % 8')} || '.log'"
ENTRY_IP = f"case when event_id % 8 in (0, 1, 2) and (event_type = 'error' or event_id % 8 = 0) then {_IP} end"
ENTRY_CODE = f"""case when event_type = 'error' and event_id % 8 = 0 then 'E50' || {_s('event_id % 7')}
 when event_type = 'error' and event_id % 8 = 5 then {_s('500 + event_id % 7')}
 when event_type = 'error' and event_id % 8 = 7 then 'ENOSPC' end"""


# --- Spark side ---------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build, spread: bool = True) -> DataFrame:
    """Write a derived table once per session to the shared folder and read it from there.

    Rendering log text is only test data preparation; the queries then scan a plain
    table, as they would in use, with column pruning and as many splits as files.
    ``spread=False`` is for tables built from stored ones: to ask such a plan for its
    partitions would run its shuffles and subqueries once more.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_dir(spark, name)
        df = build(spark, sf_dir)
        cores = spark.sparkContext.defaultParallelism
        if spread and df.rdd.getNumPartitions() < cores:  # a small one-file input
            df = df.repartition(cores, "file", "line_number")
        df.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "*", f"{LEVEL} as level", f"{SOURCE} as source", f"{message('spark')} as message")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_number, text): one rendered line per event."""
    return stored(spark, sf_dir, "log_lines", _log_lines)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        f"{FILE} as file", "event_id + 1 as line_number", f"{raw_line('spark')} as text")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_number, text): one JSON line per event."""
    return stored(spark, sf_dir, "json_lines", lambda s, d: _events(s, d).selectExpr(
        f"{FILE} as file", "event_id + 1 as line_number", f"{json_line('spark')} as text"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries straight from the events, without any line parsing."""
    return stored(spark, sf_dir, "entries", _entries)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        f"{FILE} as file", "event_id + 1 as line_number", "ts as timestamp",
        "level as log_level", "message", "source",
        f"{ENTRY_IP} as ip_address", "cast(null as string) as username",
        f"{ENTRY_CODE} as error_code", "'events' as log_type", "message as raw")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents split into lines, some indented, some coloured, some dated."""
    return stored(spark, sf_dir, "doc_lines", _doc_lines)


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.col("pos") + F.col("file_no")
    lines = lines.withColumn("file_no", F.substring("file", 5, 20).cast("bigint"))
    return lines.select(
        "file", (F.col("pos") + 1).cast("bigint").alias("line_number"),
        F.when(F.length("line") == 0, F.col("line"))
        .when(n % 7 == 3, F.concat(F.lit("  \t"), "line"))
        .when(n % 7 == 5, F.concat(F.lit(" 2024-01-15 "), "line"))
        .when(n % 11 == 4, F.concat(F.lit("\x1b[31m"), "line", F.lit("\x1b[0m")))
        .otherwise(F.col("line")).alias("text"),
    ).filter("length(text) > 0")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "ts", "value as duration_ms", "event_type <> 'error' as success")


# --- SQL side ------------------------------------------------------------------

SQL_EVENTS = f"""v_ev as (select *, {LEVEL} as level, {SOURCE} as source, {message('duckdb')} as message from events)"""
SQL_LINES = f"""{SQL_EVENTS},
v_log_lines as (select {FILE} as file, event_id + 1 as line_number, {raw_line('duckdb')} as text from v_ev)"""
SQL_JSON_LINES = f"""{SQL_EVENTS},
v_json_lines as (select {FILE} as file, event_id + 1 as line_number, {json_line('duckdb')} as text from v_ev)"""
SQL_ENTRIES = f"""{SQL_EVENTS},
v_entries as (select {FILE} as file, event_id + 1 as line_number, ts as timestamp, level as log_level, message,
 source, {ENTRY_IP} as ip_address, cast(null as varchar) as username, {ENTRY_CODE} as error_code from v_ev)"""
SQL_DOC_LINES = """v_split as (select doc_id, string_split(text, chr(10)) as parts from documents),
v_pos as (select doc_id, parts, unnest(generate_series(1, len(parts))) as line_number from v_split),
v_raw as (select doc_id, line_number, parts[line_number] as line from v_pos),
v_doc_lines as (select 'doc-' || cast(doc_id as varchar) as file, cast(line_number as bigint) as line_number,
 case when (line_number - 1 + doc_id) % 7 = 3 then '  ' || chr(9) || line
 when (line_number - 1 + doc_id) % 7 = 5 then ' 2024-01-15 ' || line
 when (line_number - 1 + doc_id) % 11 = 4 then chr(27) || '[31m' || line || chr(27) || '[0m'
 else line end as text from v_raw where length(line) > 0)"""
