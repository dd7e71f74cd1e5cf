"""Analysis sessions and their messages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert_sessions(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes by id: new rows are added, known ones keep their timestamp.

    A null in a change leaves the stored value, so a summary alone can be replaced.
    """
    b, c = base.alias("b"), changes.alias("c")
    joined = b.join(c, F.col("b.id") == F.col("c.id"), "full_outer")
    return joined.select(
        F.coalesce("b.id", "c.id").alias("id"), F.coalesce("b.timestamp", "c.timestamp").alias("timestamp"),
        *[F.coalesce(f"c.{x}", f"b.{x}").alias(x) for x in ("summary", "risk_level", "metadata")])


def recent_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """Newest sessions with their metadata object as a map."""
    newest = sessions.orderBy(F.col("timestamp").desc(), "id").limit(n)
    return newest.select(
        "id", F.col("timestamp").alias("created_at"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("risk_level", F.lit("")).alias("risk_level"),
        F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))


def session_messages(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Messages of each session in time order; optionally the last few as context."""
    if last is None:
        return messages.orderBy("session_id", "timestamp", "seq")
    newest = Window.partitionBy("session_id").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    return (messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= last).drop("_rn")
            .orderBy("session_id", "timestamp", "seq"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given session ids."""
    return (sessions.join(ids.select("id"), "id", "left_anti"),
            messages.join(ids.select(F.col("id").alias("session_id")), "session_id", "left_anti"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Number of sessions, mean confidence (missing counts as 0), critical ones."""
    value = F.coalesce(F.get_json_object("metadata", "$.confidence").try_cast("double"), F.lit(0.0))
    return sessions.agg(
        F.count("*").alias("total_analyses"), F.coalesce(F.round(F.avg(value)), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_issues"))
