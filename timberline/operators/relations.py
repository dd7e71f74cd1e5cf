"""Groups of logs sharing entities and time, and ranked incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from timberline import constants as K
from timberline.functions import text as T, timing as M

_KEYS = ["ip", "code", "src", "slot"]


def _keyed(reports: DataFrame, minutes: int) -> DataFrame:
    slot = F.coalesce(F.date_format(M.time_bucket("timestamp", minutes), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    return reports.select(
        "file", "line_number", F.coalesce("ip_address", F.lit("")).alias("ip"),
        F.coalesce("error_code", F.lit("")).alias("code"), F.coalesce("source", F.lit("")).alias("src"),
        slot.alias("slot"))


def relationship_groups(reports: DataFrame, minutes: int = 10, n: int = 30) -> DataFrame:
    """The largest groups of rows agreeing on IP, code, source and time bucket."""
    size = F.col("size")
    groups = (
        _keyed(reports, minutes).groupBy(*_KEYS)
        .agg(F.count("*").alias("size"), F.min(F.struct("file", "line_number")).alias("seen"))
        .filter(size >= 2))
    parts = F.concat_ws(
        ", ", F.when(F.col("code") != "", F.concat(F.lit("code "), "code")),
        F.when(F.col("ip") != "", F.concat(F.lit("IP "), "ip")),
        F.when(F.col("src") != "", F.concat(F.lit("source "), "src")))
    title = F.when(parts != "", F.concat(F.lit("Relationship group: "), parts)).otherwise("Relationship group")
    top = groups.orderBy(size.desc(), "seen").limit(n)
    place = F.row_number().over(Window.orderBy(size.desc(), "seen"))  # at most n rows
    return top.select(place.cast("bigint").alias("group_id"), title.alias("title"), *_KEYS, "size",
                      F.round(F.least(F.lit(1.0), 0.35 + size * 0.1), 3).alias("confidence"))


def relationship_members(reports: DataFrame, groups: DataFrame, minutes: int = 10) -> DataFrame:
    """(group_id, file, line_number) of the groups kept."""
    few = groups.select("group_id", *_KEYS)  # the top groups only
    return _keyed(reports, minutes).join(F.broadcast(few), _KEYS).select("group_id", "file", "line_number")


def incidents(root_causes: DataFrame, groups: DataFrame) -> DataFrame:
    """First eight root causes, filled up to three from relationship groups, most severe first."""
    order = [F.col("confidence").desc(), "first_file", "first_line"]
    first = root_causes.orderBy(*order).limit(8)
    have = first.agg(F.count("*")).scalar()
    causes = first.select(
        "title", "severity", F.round("confidence", 3).alias("confidence"),
        F.array_compact(F.array("dominant_source")).alias("affected_components"),
        F.col("event_count").alias("log_count"), "summary", F.slice("recommended_action", 1, 4).alias("actions"),
        F.lit(0).alias("kind"), F.concat_ws(":", "first_file", F.lpad(F.col("first_line").cast("string"), 20, "0")).alias("tie"))
    related = groups.filter(F.col("group_id") <= 3 - have).select(
        "title", F.lit("MEDIUM").alias("severity"), "confidence",
        F.array_compact(F.array(T.blank_to_null(F.col("src")))).alias("affected_components"),
        F.col("size").alias("log_count"),
        F.lit(K.GROUP_SUMMARY).alias("summary"),
        T.lit_array(K.GROUP_ACTIONS).alias("actions"),
        F.lit(1).alias("kind"), F.lpad(F.col("group_id").cast("string"), 20, "0").alias("tie"))
    return (causes.unionByName(related)
            .orderBy(T.severity_rank("severity").desc(), F.col("confidence").desc(), "kind", "tie")
            .limit(10).drop("kind", "tie"))
