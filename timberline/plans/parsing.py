"""Queries and checks: lines, formats, fields, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import constants as K
from timberline.functions import fields as L, text as T
from timberline.operators import lines as ln, parse as ps, templates as tm
from timberline.plans import sql as S, views as V

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


KEY = ["file", "line_number"]


# --- lines ----------------------------------------------------------------------
@query("strip_ansi")
def _(spark, d):
    return V.doc_lines(spark, d).select(*KEY, T.strip_ansi("text").alias("clean"))


ORACLES["strip_ansi"] = f"with {V.SQL_DOC_LINES} select file, line_number, {S.sub('text', K.ANSI, '')} as clean from v_doc_lines"


def _norm(x):
    return S.strip(S.sub(f"replace({S.sub(x, K.ANSI, '')}, chr(9), ' ')", "  +", " "))


@query("normalize_line")
def _(spark, d):
    return ln.normalize_lines(V.doc_lines(spark, d)).select(*KEY, "normalized")


ORACLES["normalize_line"] = f"with {V.SQL_DOC_LINES} select file, line_number, {_norm('text')} as normalized from v_doc_lines"

_CONT = rf"(regexp_matches(text, '^\s') and not regexp_matches({S.sub('text', r'^\s+', '')}, {S.q(K.ENTRY_START)}))"


@query("continuation_flag")
def _(spark, d):
    return ln.flag_continuations(V.doc_lines(spark, d)).select(*KEY, "is_continuation")


ORACLES["continuation_flag"] = f"with {V.SQL_DOC_LINES} select file, line_number, {_CONT} as is_continuation from v_doc_lines"


@query("merge_multiline")
def _(spark, d):
    return ln.merge_multiline(V.doc_lines(spark, d)).select(*KEY, "text")


ORACLES["merge_multiline"] = f"""with {V.SQL_DOC_LINES},
f as (select file, line_number, {_norm('text')} as norm, {_CONT} as cont from v_doc_lines),
g as (select *, sum(case when cont then 0 else 1 end) over (partition by file order by line_number) as grp from f),
h as (select *, min(line_number) over (partition by file, grp) as head from g)
select file, head as line_number, string_agg(norm, ' ' order by line_number) as text
from h where line_number = head or norm <> '' group by file, head"""


@query("truncate_line")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", T.clip("text", K.MAX_LINE_CHARS).alias("cut"),
                       T.truncate("text", 100).alias("preview"))


ORACLES["truncate_line"] = f"""select doc_id, substring(text, 1, {K.MAX_LINE_CHARS}) as cut,
case when length(text) <= 100 then text else substring(text, 1, 97) || '...' end as preview from documents"""


@query("line_level_filter")
def _(spark, d):
    lines = V.log_lines(spark, d)
    errors = ln.filter_lines(lines, "error").select(F.lit("error").alias("kind"), *KEY, "text")
    warned = ln.filter_lines(lines, "warning").select(F.lit("warning").alias("kind"), *KEY, "text")
    info = ln.filter_lines(lines, "info", "Request").select(F.lit("info").alias("kind"), *KEY, "text")
    return errors.unionByName(warned).unionByName(info).unionByName(
        ln.excerpt(lines).select(F.lit("excerpt").alias("kind"), *KEY, "text"))


_ERRLINE = S.any_of("lower(text)", ["error", "exception", "failed"])
ORACLES["line_level_filter"] = f"""with {V.SQL_LINES}
select 'error' as kind, file, line_number, text from v_log_lines where {_ERRLINE}
union all select 'warning', file, line_number, text from v_log_lines where contains(lower(text), 'warn')
union all select 'info', file, line_number, text from v_log_lines
 where {S.any_of('lower(text)', ['info', 'debug'])} and contains(lower(text), 'request')
union all (select 'excerpt', file, line_number, text from v_log_lines where {_ERRLINE} order by file, line_number limit 3)"""


# --- formats ----------------------------------------------------------------------
@query("detect_format")
def _(spark, d):
    return ps.detect_format(V.log_lines(spark, d))


_FORMAT_CASE = "case " + " ".join(
    f"when regexp_matches(text, {S.q(p)}) then {S.q(n)}" for n, p, _g in K.LINE_FORMATS
) + f" when regexp_matches(text, {S.q(K.JSON_LINE)}) then 'json' end"
_DETECT = f"""d_head as (select file, line_number, {_FORMAT_CASE} as detected from v_log_lines),
d_count as (select file, detected, count(*) as n, min(line_number) as first_at from d_head group by file, detected),
d_total as (select file, sum(n) as total from d_count group by file),
d_best as (select file, detected, n from (select *, row_number() over (partition by file order by n desc, first_at) as rn
 from d_count where detected is not null) where rn = 1),
detected as (select t.file, case when b.n >= greatest(1e0, 0.3e0 * t.total) then b.detected end as detected
 from d_total t left join d_best b on t.file = b.file)"""
ORACLES["detect_format"] = f"with {V.SQL_LINES}, {_DETECT} select file, detected from detected"


def _ts(x: str) -> str:
    """Timestamp parsing in SQL, written against DuckDB's own parser."""
    y = f"regexp_replace(trim({x}), 'Z$', '')"
    clock = r"^\d{4}-\d{1,2}-\d{1,2}(\s+\d{1,2}:\d{1,2}:\d{1,2}([.,]\d{1,6})?|T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?)$"
    return f"""(case when regexp_matches({y}, {S.q(clock)})
 then try_cast(replace(replace({y}, 'T', ' '), ',', '.') as timestamp)
 when regexp_matches({y}, '^[A-Za-z]{{3}}\\s') then try_strptime('1900 ' || {y}, '%Y %b %d %H:%M:%S')
 when regexp_matches({y}, '^\\d+/[A-Za-z]') then try_strptime(regexp_replace({y}, ' \\+0000$', ''), '%d/%b/%Y:%H:%M:%S')
 when regexp_matches({y}, '[AP]M$') then try_strptime({y}, '%m/%d/%Y %I:%M:%S %p') end)"""


_LEVEL = lambda x: S.case_map(f"lower(trim({x}))", K.TEXT_LEVELS, "'UNKNOWN'")
_IP = lambda x: f"nullif(regexp_extract({x}, {S.q(K.IPV4)}, 0), '')"
_CODE = lambda x: f"nullif(regexp_extract({x}, {S.q(K.ERROR_CODE)}, 1), '')"


def _parsed(name: str) -> str:
    """Field expressions of one format, each with its own regexp_extract."""
    pattern, groups = next((p, g) for n, p, g in K.LINE_FORMATS if n == name)

    def slot(i):
        return f"nullif(regexp_extract(text, {S.q(pattern)}, {groups[i]}), '')" if groups[i] else "null"

    message = f"coalesce({slot(2)}, text)"
    return f"""text as raw, {_ts(slot(0)) if groups[0] else 'null::timestamp'} as timestamp,
 {_LEVEL(slot(1)) if groups[1] else "'UNKNOWN'"} as log_level, {message} as message,
 coalesce({slot(3)}, '') as source, coalesce({slot(4)}, {_IP(message)}) as ip_address,
 nullif({slot(5)}, '-')::varchar as username, coalesce({slot(6)}, {_CODE(message)}) as error_code, '{name}' as log_type"""


def _match(name: str) -> str:
    return f"regexp_matches(text, {S.q(next(p for n, p, _g in K.LINE_FORMATS if n == name))})"


for _key, _name in [
    ("parse_apache_access", "apache_access"), ("parse_apache_error", "apache_error"),
    ("parse_syslog", "syslog"), ("parse_python", "python"), ("parse_windows_event", "windows_event"),
    ("parse_iso_generic", "iso_generic"), ("parse_simple_level", "simple_level"),
]:
    QUERIES[_key] = lambda spark, d, n=_name: ps.parse_as(V.log_lines(spark, d), n)
    ORACLES[_key] = (f"with {V.SQL_LINES} select file, line_number, {_parsed(_name)} "
                     f"from v_log_lines where {_match(_name)}")


def _json_key(names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(text, '$.\"{n}\"')" for n in names) + ")"


_JSON_OK = "(starts_with(ltrim(text), '{') and json_valid(text))"
_JSON_PARSED = f"""text as raw, {_ts(_json_key(K.INLINE_JSON_KEYS['timestamp']))} as timestamp,
 coalesce({_LEVEL(_json_key(K.INLINE_JSON_KEYS['level']))}, 'UNKNOWN') as log_level,
 coalesce(nullif({_json_key(K.INLINE_JSON_KEYS['message'])}, ''), text) as message,
 coalesce({_json_key(K.INLINE_JSON_KEYS['source'])}, '') as source,
 nullif({_json_key(K.INLINE_JSON_KEYS['ip'])}, '') as ip_address,
 nullif({_json_key(K.INLINE_JSON_KEYS['user'])}, '') as username,
 nullif({_json_key(K.INLINE_JSON_KEYS['code'])}, '') as error_code, 'json' as log_type"""


@query("parse_inline_json")
def _(spark, d):
    return ps.parse_inline_json(V.log_lines(spark, d))


ORACLES["parse_inline_json"] = f"with {V.SQL_LINES} select file, line_number, {_JSON_PARSED} from v_log_lines where {_JSON_OK}"


@query("parse_entries")
def _(spark, d):
    return ps.parse_entries(V.log_lines(spark, d))


_ENTRY_COLS = "file, line_number, raw, timestamp, log_level, message, source, ip_address, username, error_code, log_type"
_FIRST = f"({_FORMAT_CASE})"
SQL_PARSED = f"""{V.SQL_LINES}, {_DETECT},
k as (select l.*, d.detected, {_JSON_OK} as is_json from v_log_lines l left join detected d on l.file = d.file),
kk as (select *, case when is_json then 'json' when detected is null then nullif({_FIRST}, 'json')
 {' '.join(f"when detected = '{n}' and {_match(n)} then '{n}'" for n, _p, _g in K.LINE_FORMATS)} end as fmt from k),
v_parsed as ({' union all '.join(
    f"select file, line_number, {_parsed(n)} from kk where fmt = '{n}'" for n, _p, _g in K.LINE_FORMATS)}
 union all select file, line_number, {_JSON_PARSED} from kk where fmt = 'json'
 union all select file, line_number, text, null, 'UNKNOWN', text, '', null, null, null, 'UNCLASSIFIED' from kk where fmt is null)"""
ORACLES["parse_entries"] = f"with {SQL_PARSED} select {_ENTRY_COLS} from v_parsed"


# --- fields -----------------------------------------------------------------------
_WORD = "case event_id % 5 when 0 then lower({lv}) when 1 then ' ' || {lv} || ' ' when 2 then 'Notice' when 3 then 'emergency' else 'bogus' end"


@query("normalize_level")
def _(spark, d):
    ev = V._events(spark, d).selectExpr("event_id", f"{_WORD.format(lv='level')} as word")
    value = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7 * 10).cast("string")).otherwise(
        F.concat(F.lit('"'), "word", F.lit('"')))
    obj = L.json_map(F.concat(F.lit('{"level": '), value, F.lit("}")))
    return ev.select("event_id", L.normalize_level(F.col("word")).alias("text_level"),
                     L.json_level(obj["level"]).alias("json_level"))


ORACLES["normalize_level"] = f"""with {V.SQL_EVENTS}, w as (select event_id, {_WORD.format(lv='level')} as word from v_ev)
select event_id, {_LEVEL('word')} as text_level, case when event_id % 2 = 0 then
 case when event_id % 7 <= 2 then 'DEBUG' when event_id % 7 = 3 then 'INFO' when event_id % 7 = 4 then 'WARNING'
 when event_id % 7 = 5 then 'ERROR' else 'CRITICAL' end
 else {S.case_map('lower(trim(word))', K.JSON_LEVELS, "'UNKNOWN'")} end as json_level from w"""


@query("parse_timestamp")
def _(spark, d):
    t = V.DIALECTS["spark"]
    stamp = f"""case event_id % 7 when 0 then {t['python_ts']} when 1 then {t['iso_ts']} || 'Z'
 when 2 then {t['syslog_ts']} when 3 then {t['access_ts']} || ' +0000' when 4 then {t['windows_ts']}
 when 5 then {t['apache_ts']} else 'not a time' end"""
    ev = V.table(spark, d, "events").selectExpr("event_id", f"{stamp} as stamp")
    return ev.select("event_id", "stamp", L.parse_timestamp(F.col("stamp")).alias("parsed"))


_d = V.DIALECTS["duckdb"]
ORACLES["parse_timestamp"] = f"""select event_id, case event_id % 7 when 0 then {_d['python_ts']} when 1 then {_d['iso_ts']} || 'Z'
 when 2 then {_d['syslog_ts']} when 3 then {_d['access_ts']} || ' +0000' when 4 then {_d['windows_ts']}
 when 5 then {_d['apache_ts']} else 'not a time' end as stamp,
 case event_id % 7 when 0 then date_trunc('millisecond', ts) when 1 then ts
 when 2 then date_trunc('second', ts) - to_years(cast(year(ts) - 1900 as integer))
 when 3 then date_trunc('second', ts) when 4 then date_trunc('second', ts) end as parsed from events"""


@query("parse_json_timestamp")
def _(spark, d):
    t = V.DIALECTS["spark"]
    ev = V.table(spark, d, "events").selectExpr(
        "event_id", f"""case event_id % 5 when 0 then cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000 as string)
 when 1 then cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000000 as string)
 when 2 then '"' || {t['iso_ts']} || 'Z"' when 3 then '"' || date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '"'
 else 'true' end as value""")
    obj = L.json_map(F.concat(F.lit('{"ts": '), "value", F.lit("}")))
    return ev.select("event_id", L.json_timestamp(obj["ts"]).alias("parsed"))


ORACLES["parse_json_timestamp"] = """select event_id, case event_id % 5 when 0 then date_trunc('millisecond', ts)
 when 1 then date_trunc('second', ts) when 2 then ts when 3 then date_trunc('second', ts) end as parsed from events"""


@query("extract_ip")
def _(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", T.first_ip("text").alias("first_ip"), F.array_join(T.all_ips("text"), ",").alias("ips"))


ORACLES["extract_ip"] = f"""select doc_id, {_IP('text')} as first_ip,
 coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, {S.q(K.IPV4)}))), ','), '') as ips from documents"""


@query("extract_error_code")
def _(spark, d):
    return V.entries(spark, d).select(
        *KEY, T.error_code("message").alias("code"),
        F.array_join(T.error_tokens("message"), "|").alias("tokens"))


SQL_TOKENS = (f"case when regexp_matches(message, {S.q(K.ERROR_TOKEN)}) then list_sort(list_distinct(list_concat("
              f"regexp_extract_all(message, {S.q(K.ERROR_TOKEN)}), regexp_extract_all(message, {S.q(K.NUMERIC_CODE)})))) else [] end")
ORACLES["extract_error_code"] = f"""with {V.SQL_ENTRIES} select file, line_number, {_CODE('message')} as code,
 array_to_string({SQL_TOKENS}, '|') as tokens from v_entries"""


@query("semantic_tags")
def _(spark, d):
    tags = T.semantic_tags("message", "source")
    return V.entries(spark, d).select(
        *KEY, F.array_join(tags, ",").alias("tags"), F.try_element_at(tags, F.lit(1)).alias("top_tag"))


SQL_TAGS = "list_filter([" + ", ".join(
    f"case when {S.any_of('low', w)} then {S.q(t)} end" for t, w in K.SEMANTIC_TAGS.items()) + "], lambda t: t is not null)"
ORACLES["semantic_tags"] = f"""with {V.SQL_ENTRIES}, l as (select *, lower(message || ' ' || source) as low from v_entries)
select file, line_number, array_to_string({SQL_TAGS}, ',') as tags, ({SQL_TAGS})[1] as top_tag from l"""

SQL_CATEGORY = "case " + " ".join(
    f"when {S.any_of('lower(message)', w)} then {S.q(c)}" for c, w in K.ERROR_CATEGORIES.items()) + " else 'other' end"


@query("error_category")
def _(spark, d):
    return V.entries(spark, d).select(*KEY, T.error_category("message").alias("category"))


ORACLES["error_category"] = f"with {V.SQL_ENTRIES} select file, line_number, {SQL_CATEGORY} as category from v_entries"


# --- templates ----------------------------------------------------------------------
@query("extract_template")
def _(spark, d):
    return tm.with_template(V.entries(spark, d)).select(*KEY, "template")


SQL_TEMPLATED = f"{V.SQL_ENTRIES}, v_t as (select *, {S.template('message')} as template from v_entries)"
ORACLES["extract_template"] = f"with {SQL_TEMPLATED} select file, line_number, template from v_t"


@query("mine_templates")
def _(spark, d):
    return tm.mine_templates(V.entries(spark, d), top_n=12)


_MINED = f"""{SQL_TEMPLATED}, c as (select template, count(*) as count, min(line_number) as seen,
 arg_min(substring(message, 1, 300), line_number) as example from v_t group by template),
r as (select *, row_number() over (order by count desc, seen) - 1 as template_id from c)"""
ORACLES["mine_templates"] = f"""with {_MINED} select cast(template_id as integer) as template_id, template as pattern, count, example,
 round(count::double / (select count(*) from v_t), 4) as frequency from r where template_id < 12"""


@query("template_assignments")
def _(spark, d):
    return tm.assign_templates(V.entries(spark, d), top_n=12)


ORACLES["template_assignments"] = f"""with {_MINED} select t.file, t.line_number,
 cast(least(r.template_id, 12) as integer) as template_id from v_t t join r on t.template = r.template"""


@query("cluster_normalize")
def _(spark, d):
    return V.entries(spark, d).select(*KEY, T.cluster_text("message").alias("normalized"))


ORACLES["cluster_normalize"] = f"""with {V.SQL_ENTRIES} select file, line_number,
 {S.subs(S.strip('lower(message)'), K.CLUSTER_RULES)} as normalized from v_entries"""


@query("line_signature")
def _(spark, d):
    return V.log_lines(spark, d).select(*KEY, T.line_signature("text").alias("signature"))


_SIG = S.strip(S.subs("text", K.SIGNATURE_RULES + [K.SIGNATURE_HEX]))
ORACLES["line_signature"] = f"with {V.SQL_LINES} select file, line_number, {_SIG} as signature from v_log_lines"


@query("repeating_signatures")
def _(spark, d):
    return tm.repeating_signatures(V.log_lines(spark, d))


ORACLES["repeating_signatures"] = f"""with {V.SQL_LINES}, s as (select {_SIG} as sig, file, line_number from v_log_lines),
c as (select sig, count(*) as count, min((file, line_number)) as seen from s where sig <> '' group by sig order by count desc, seen limit 15)
select substring(sig, 1, 80) as signature, count, round(count::double / (select count(*) from v_log_lines) * 100, 2) as percentage
from c where count > 2"""


@query("error_patterns")
def _(spark, d):
    return tm.error_patterns(V.log_lines(spark, d))


ORACLES["error_patterns"] = f"""with {V.SQL_LINES}, s as (select {S.subs('text', K.SIGNATURE_RULES)} as sig, file, line_number
 from v_log_lines where {S.any_of('lower(text)', K.ERROR_WORDS)}),
c as (select sig, count(*) as count, min((file, line_number)) as seen from s group by sig order by count desc, seen limit 20)
select substring(sig, 1, 100) as signature, count,
 case when count > 5 then 'HIGH' when count > 2 then 'MEDIUM' else 'LOW' end as severity from c"""
