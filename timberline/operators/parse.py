"""Format detection and parsing of entries into typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline import constants as K
from timberline.functions import fields as L, text as T

_SEP = "\x01"
_SLOTS = ["ts", "level", "message", "source", "ip", "user", "code"]
_FORMATS = {name: (pattern, groups) for name, pattern, groups in K.LINE_FORMATS}


def format_of(c: str | Column) -> Column:
    """The first format, in registry order, whose pattern matches the line."""
    text = T.col(c)
    out = F
    for name, pattern, _ in K.LINE_FORMATS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.when(text.rlike(K.JSON_LINE), F.lit("json"))


def detect_format(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """(file, detected): per file, the format of most of its lines, or null.

    All lines are counted, pre-aggregated per task; with ``sample`` only the first lines of each file.
    """
    head = lines.select("file", "line_number", "text")
    if sample is not None:
        first = Window.partitionBy("file").orderBy("line_number")
        head = head.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= sample)
    head = head.select("file", "line_number", format_of("text").alias("detected"))
    counts = head.groupBy("file", "detected").agg(
        F.count("*").alias("n"), F.min("line_number").alias("at"))
    best = counts.groupBy("file").agg(
        F.sum("n").alias("sampled"),
        F.max_by(F.struct("detected", "n"),
                 F.when(F.col("detected").isNotNull(), F.struct("n", -F.col("at")))).alias("top"))
    enough = F.col("top.n") >= F.greatest(F.lit(1.0), F.col("sampled") * 0.3)
    return best.select("file", F.when(enough, F.col("top.detected")).alias("detected"))


def _captured(text: Column, name: str) -> Column:
    """All fields of one format in a single pass of its pattern; null if it does not match."""
    pattern, groups = _FORMATS[name]
    template = _SEP.join([f"${g}" if g else "" for g in groups] + [name])
    parts = F.split(F.regexp_replace(text, pattern, template), _SEP)
    return F.when(F.size(parts) == len(_SLOTS) + 1, parts)


def parse_as(lines: DataFrame, name: str) -> DataFrame:
    """Parse every line with one format; lines that do not match are dropped."""
    captured = lines.withColumn("_p", _captured(F.col("text"), name)).filter(F.col("_p").isNotNull())
    return _typed(_slots(captured), 1900)


def _slots(captured: DataFrame) -> DataFrame:
    """The captured parts as columns of their own, so later steps do not repeat the pattern."""
    return captured.select(
        "file", "line_number", F.col("text").alias("raw"),
        *[T.blank_to_null(F.get("_p", F.lit(i))).alias(s) for i, s in enumerate(_SLOTS)],
        F.get("_p", F.lit(len(_SLOTS))).alias("log_type"))


def _typed(slots: DataFrame, default_year: int) -> DataFrame:
    """Final types and fallbacks. IP and code are searched in the message of regex formats."""
    read = slots.withColumn("message", F.coalesce("message", "raw"))
    searched = ~F.col("log_type").isin("json", "UNCLASSIFIED")
    return read.select(
        "file", "line_number", "raw",
        L.parse_timestamp(F.col("ts"), default_year).alias("timestamp"),
        L.normalize_level(F.col("level")).alias("log_level"),
        "message",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("ip", F.when(searched, T.first_ip("message"))).alias("ip_address"),
        F.when(~(searched & (F.col("user") == "-")), F.col("user")).alias("username"),
        F.coalesce("code", F.when(searched, T.error_code("message"))).alias("error_code"),
        "log_type")


def _json_parts(fields: Column) -> Column:
    """The same slots out of a JSON object."""
    names = K.INLINE_JSON_KEYS
    return F.array(
        L.first_key(fields, names["timestamp"]), L.first_key(fields, names["level"]),
        L.first_key(fields, names["message"]), L.first_key(fields, names["source"]),
        L.first_filled(fields, names["ip"]), L.first_filled(fields, names["user"]),
        L.first_filled(fields, names["code"]), F.lit("json"))


def _with_json(lines: DataFrame) -> DataFrame:
    opens = F.ltrim("text").startswith("{")
    return lines.withColumn("_j", F.when(opens, L.string_map(F.col("text"))))


def parse_inline_json(lines: DataFrame) -> DataFrame:
    """Lines holding one JSON object."""
    read = _with_json(lines).filter(F.col("_j").isNotNull())
    return _typed(_slots(read.withColumn("_p", _json_parts(F.col("_j")))), 1900)


def parse_entries(lines: DataFrame, detected: DataFrame | None = None,
                  default_year: int = 1900) -> DataFrame:
    """Typed entries of merged lines.

    A JSON object is read as such whatever the file's format. Other lines are read
    with the format detected for their file, or with the first matching format when
    none was detected; what matches nothing is UNCLASSIFIED. Texts stay whole.
    """
    if detected is None:
        detected = detect_format(lines)
    # one small row per file: the join is left to the optimiser, which broadcasts or splits skewed files
    known = lines.select("file", "line_number", "text").join(detected.select("file", "detected"), "file", "left")
    text = F.col("text")
    by_format = F.when(F.col("_j").isNotNull(), _json_parts(F.col("_j")))
    for name in _FORMATS:
        by_format = by_format.when(F.col("detected") == name, _captured(text, name))
    # no detected format: the first format that matches
    open_choice = F.col("detected").isNull()
    for name in _FORMATS:
        by_format = by_format.when(open_choice & text.rlike(_FORMATS[name][0]), _captured(text, name))
    unread = F.array(*[F.lit("UNCLASSIFIED") if i == len(_SLOTS) else F.lit(None).cast("string")
                       for i in range(len(_SLOTS) + 1)])
    ready = _with_json(known).withColumn("_p", F.coalesce(by_format, unread))
    return _typed(_slots(ready), default_year)
