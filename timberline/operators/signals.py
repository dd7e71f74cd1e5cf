"""Signals read from raw lines: components, levels, timelines, snippets, known issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from timberline import constants as K
from timberline.functions import text as T


def _has(words: list[str]) -> Column:
    """Does the line contain one of the upper-case words, ignoring case?"""
    return T.contains_any(F.upper("text"), words)


def component_stats(lines: DataFrame, n: int = 20) -> DataFrame:
    """Lines, errors and warnings per component, most errors first."""
    name = F.coalesce(*[T.blank_to_null(F.regexp_extract("text", p, 1)) for p in K.COMPONENT_SHAPES])
    is_error = _has(["ERROR", "FATAL", "CRITICAL"])
    stats = (
        lines.withColumn("name", name).filter("name is not null").groupBy("name")
        .agg(F.count("*").alias("count"), F.count_if(is_error).alias("error_count"),
             F.count_if(~is_error & _has(["WARN"])).alias("warn_count"),
             F.min(F.struct("file", "line_number")).alias("seen")))
    errors = F.col("error_count")
    return stats.orderBy(errors.desc(), F.col("count").desc(), "seen").limit(n).select(
        "name", "count", "error_count", "warn_count",
        F.when(errors > 5, "HIGH").when(errors > 0, "MEDIUM").otherwise("LOW").alias("severity"))


def line_severity_dist(lines: DataFrame) -> DataFrame:
    """Lines per level word, all six levels listed."""
    level = F
    for name, pattern in K.SIGNAL_LEVELS:
        level = level.when(F.upper("text").rlike(pattern), F.lit(name))
    names = [n for n, _ in K.SIGNAL_LEVELS] + ["UNKNOWN"]
    row = lines.select(level.otherwise("UNKNOWN").alias("level")).agg(
        *[F.count_if(F.col("level") == n).alias(n) for n in names])
    return row.unpivot([], names, "level", "count")


def signal_timeline(lines: DataFrame, width: int = 10, n: int | None = None) -> DataFrame:
    """Lines and errors per leading part of the timestamp found in the line; all of them, or the first ``n``."""
    stamp = F.coalesce(*[T.blank_to_null(F.regexp_extract("text", p, 1)) for p in K.SIGNAL_TIMESTAMPS])
    is_error = _has(["ERROR", "FATAL", "CRITICAL"])
    out = (
        lines.select(T.clip(stamp, width).alias("time"), is_error.alias("is_error"))
        .filter("time is not null").groupBy("time")
        .agg(F.count("*").alias("total_count"), F.count_if("is_error").alias("error_count"))
        .withColumn("error_rate", F.col("error_count") / F.col("total_count")).orderBy("time"))
    return out if n is None else out.limit(n)


def key_snippets(lines: DataFrame, n: int = 10) -> DataFrame:
    """The lines of highest evidence score."""
    level = (F.when(_has(["CRITICAL", "FATAL"]), 10).when(_has(["ERROR"]), 7).when(_has(["WARN"]), 5).otherwise(0))
    words = T.count_words(F.lower("text"), K.SNIPPET_WORDS) * 3
    size = F.length("text")
    score = level + words + F.when((size > 50) & (size < 500), 1).otherwise(0)
    return (lines.withColumn("score", score).orderBy(F.col("score").desc(), "file", "line_number").limit(n)
            .select("file", "line_number", "score", T.strip(F.col("text")).alias("snippet")))


def issue_commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, commands) for name, _, commands in K.ISSUE_RULES], "issue string, commands array<string>")


def actionable_patterns(lines: DataFrame) -> DataFrame:
    """Known issues per file with commands to look into them; the port of the first conflict."""
    text = F.col("text")
    flags = [F.max(text.rlike(pattern)).alias(name) for name, pattern, _ in K.ISSUE_RULES]
    port = T.blank_to_null(F.regexp_extract(text, K.ISSUE_RULES[0][1], 1))
    per_file = lines.groupBy("file").agg(
        *flags, F.min_by(port, F.when(port.isNotNull(), F.col("line_number"))).alias("port"))
    found = per_file.unpivot(["file", "port"], [r[0] for r in K.ISSUE_RULES], "issue", "hit").filter("hit")
    # seven constant rows
    joined = found.join(F.broadcast(issue_commands(lines.sparkSession)), "issue")
    own_port = F.when(F.col("issue") == "port_conflict", F.col("port"))
    filled = F.transform("commands", lambda c: F.replace(c, F.lit("{port}"), F.coalesce(own_port, F.lit("{port}"))))
    return joined.select("file", "issue", own_port.alias("port"), filled.alias("commands"))


def raw_line_metrics(lines: DataFrame) -> DataFrame:
    """One row of word counts, error rate and a score from the error density."""
    def hits(pattern: str) -> Column:
        return F.coalesce(F.sum(F.regexp_count("text", F.lit(pattern))), F.lit(0))

    row = lines.agg(
        F.count_if(F.col("text").rlike(r"\S")).alias("total_logs"),
        hits(r"(?i)\bERROR\b|\bFATAL\b|\bCRITICAL\b").alias("error_count"),
        hits(r"(?i)\bWARN\b|\bWARNING\b").alias("warn_count"), hits(r"(?i)\bINFO\b").alias("info_count"),
        hits(r"(?i)\bFATAL\b").alias("fatal_count"))
    rate = F.when(F.col("total_logs") > 0, F.round(
        (F.col("error_count") + F.col("fatal_count")) / F.col("total_logs") * 100, 1)).otherwise(0.0)
    r = F.col("error_rate")
    return row.withColumn("error_rate", rate).withColumn(
        "anomaly_score", F.when(r > 50, 85).when(r > 20, 65).when(F.col("error_count") > 0, 45).otherwise(20))


def bracket_components(lines: DataFrame) -> DataFrame:
    """Occurrences of each bracketed word."""
    n = F.col("failures")
    return (lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[(\w+)\]"), F.lit(1))).alias("component"))
            .groupBy("component").agg(F.count("*").alias("failures"))
            .withColumn("severity", F.when(n > 5, "HIGH").when(n > 2, "MEDIUM").otherwise("LOW")))


def evidence_lines(lines: DataFrame, first: int | None = None) -> DataFrame:
    """Lines with an error word, or with ``first`` those among the first lines of each file."""
    if first is not None:
        head = Window.partitionBy("file").orderBy("line_number")
        lines = lines.withColumn("_rn", F.row_number().over(head)).filter(F.col("_rn") <= first)
    return (lines.filter(T.contains_any(F.lower("text"), ["error", "failed", "exception", "critical"]))
            .select("file", "line_number", T.strip(F.col("text")).alias("log_line")))
