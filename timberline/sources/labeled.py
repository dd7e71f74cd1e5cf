"""Labelled examples: reading them and generating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberline.functions import text as T

# message shapes of generated examples
NORMAL = [
    "Shipment {id} left the depot", "Rendered the start page in {ms} milliseconds", "Heartbeat of node n{ip} received",
    "Reused a pooled socket for client {id}", "Replica caught up with the primary",
    "Nightly compaction of segment {id} finished", "Stored invoice {id} in the archive",
    "Answered query {id} from the read replica",
]
ANOMALOUS = [
    "FATAL: worker {pid} was stopped, no memory left", "Broker at 172.16.0.{ip}:9092 refuses connections",
    "Process {pid} crashed with signal 11 while resizing images", "CRITICAL: volume /srv/data is 97% full",
    "ERROR: uncaught exception in the billing worker",
    "CRITICAL: the certificate of gateway n{ip} is no longer valid",
    "Boot of node n{ip} halted, root file system missing",
    "ERROR: two transactions blocked each other on table bookings",
]
LEVELS = ["INFO", "DEBUG", "WARNING", "ERROR", "CRITICAL"]


def labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(message, is_anomaly, severity) from CSV with a header."""
    raw = spark.read.csv(path, header=True, schema="message string, is_anomaly string, severity string", escape='"')
    return raw.select(
        "message", F.lower(F.trim("is_anomaly")).isin("true", "1", "yes").alias("is_anomaly"),
        F.upper(F.trim(F.coalesce("severity", F.lit("LOW")))).alias("severity"))


def _draw(id_col: Column, salt: int, n: int) -> Column:
    """A repeatable pseudo-random number below n for an id."""
    mixed = (id_col * 7919 + salt * 104729) % 1000003
    return (mixed * 31 + salt) % n


def generate_labeled(ids: DataFrame, id_column: str = "id") -> DataFrame:
    """One labelled example per id: a quarter anomalous, eight shapes of each kind."""
    i = F.col(id_column)
    bad = _draw(i, 1, 100) < 25
    shape = _draw(i, 2, 8)
    picked = F.when(bad, F.get(T.lit_array(ANOMALOUS), shape)).otherwise(F.get(T.lit_array(NORMAL), shape))
    values = {"id": 100 + _draw(i, 3, 900), "pid": 1000 + _draw(i, 4, 9000), "ip": 1 + _draw(i, 5, 254),
              "ms": 1 + _draw(i, 6, 50)}
    for name, value in values.items():
        picked = F.replace(picked, F.lit("{" + name + "}"), value.cast("string"))
    coin = _draw(i, 7, 2) == 0
    severity = (F.when(bad, F.when(coin, "HIGH").otherwise("CRITICAL"))
                .otherwise(F.when(coin, "LOW").otherwise("MEDIUM")))
    return ids.select(i.alias("id"), picked.alias("message"), bad.alias("is_anomaly"), severity.alias("severity"))


def generate_lines(ids: DataFrame, id_column: str = "id", ts_column: str = "ts") -> DataFrame:
    """One line of a service log per id and time, for load tests."""
    i = F.col(id_column)
    return ids.select(i.alias("id"), F.concat(
        F.date_format(ts_column, "yyyy-MM-dd HH:mm:ss"), F.lit(" app.service [1]: "),
        F.get(T.lit_array(LEVELS), _draw(i, 8, 5)), F.lit(": item "), i.cast("string"),
        F.lit(" handled, checksum "), _draw(i, 9, 10000).cast("string")).alias("line"))
