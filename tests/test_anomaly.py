"""Scores on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from timberline.operators import alerts, anomaly, forest, severity

T0 = datetime(2024, 1, 15, 10, 0, 0)
SCHEMA = ("file string, line_number long, timestamp timestamp_ntz, log_level string, message string, source string, "
          "ip_address string, username string, error_code string")


def entries(spark, items):
    return spark.createDataFrame(
        [("a.log", i + 1, ts, level, msg, "app", None, None, None) for i, (ts, level, msg) in enumerate(items)], SCHEMA)


def test_spike_in_one_second_but_not_over_minutes(spark):
    burst = entries(spark, [(T0, "INFO", f"m{i}") for i in range(11)])
    assert anomaly.frequency_spikes(burst).filter("spike_conf is not null").count() == 11
    slow = entries(spark, [(T0 + timedelta(minutes=i), "INFO", f"m{i}") for i in range(5)])
    assert anomaly.frequency_spikes(slow).filter("spike_conf is not null").count() == 0


def test_blocks_of_ten_without_times(many_cells):
    rows = entries(many_cells, [(None, "INFO", f"m{i}") for i in range(25)])
    hit = anomaly.sequential_spikes(rows.repartition(3)).filter("spike_conf is not null")
    assert sorted(r["line_number"] for r in hit.collect()) == list(range(1, 21))


def test_repeated_errors(spark):
    rows = entries(spark, [(T0, "ERROR", "Connection refused")] * 5 + [(T0, "ERROR", "other")] * 2)
    got = anomaly.repeated_errors(rows).filter("repeat_conf is not null").collect()
    assert len(got) == 5 and got[0]["repeat_conf"] == 0.8


def test_best_rule_and_details(spark):
    got = anomaly.rule_engine(entries(spark, [(T0, "CRITICAL", "fatal: kernel panic")])).first()
    assert (round(got["rule_score"], 6), got["rule_type"]) == (0.7, "critical_keyword")
    assert got["rule_details"] == "Critical keywords found: fatal, kernel panic; Log level is CRITICAL"
    plain = anomaly.rule_engine(entries(spark, [(T0, "INFO", "ok")])).first()
    assert plain["rule_type"] is None and plain["rule_score"] == 0.0


def test_small_batches_score_zero(spark):
    two = anomaly.with_features(entries(spark, [(T0, "INFO", "a"), (T0, "ERROR", "b" * 500)]))
    assert {r["stat_score"] for r in anomaly.zscore_outliers(two).collect()} == {0.0}
    assert {r["ml_score"] for r in forest.isolation_forest(two).collect()} == {0.0}


def _planted(spark):
    rows = [(T0 + timedelta(hours=i % 24), "INFO", f"request {i} served in time") for i in range(400)]
    rows.append((T0, "CRITICAL", "error fail exception timeout refused " + "x" * 3000))
    return anomaly.with_features(entries(spark, rows))


def test_forest_finds_a_planted_outlier_whatever_the_partitions(spark):
    base = _planted(spark)
    scores = {}
    for n in (1, 7):
        got = forest.isolation_forest(base.repartition(n))
        by_line = {r["line_number"]: r["ml_score"] for r in got.collect()}
        assert max(by_line, key=by_line.get) == 401 and by_line[401] == 1.0
        assert min(by_line.values()) == 0.0
        scores[n] = by_line
    assert scores[1] == scores[7]


def test_constant_rows_have_no_outlier(spark):
    same = anomaly.with_features(entries(spark, [(T0, "INFO", "same")] * 40))
    assert {r["ml_score"] for r in forest.isolation_forest(same).collect()} == {0.0}


def test_severity_levels(spark):
    rows = spark.createDataFrame([("a", 1, "CRITICAL", 1.0), ("a", 2, "INFO", 0.0)],
                                 "file string, line_number long, log_level string, confidence double")
    got = {r["line_number"]: r for r in severity.severity_scores(rows).collect()}
    assert got[1]["severity"] == "CRITICAL" and got[1]["severity_score"] == 0.965
    assert got[2]["severity"] == "LOW"


def test_cooldown_suppresses_then_fires_again(spark):
    rule = alerts.AlertRule("db", None, "Database", 10)
    times = [0, 1, 9, 10, 15, 20, 31]
    rows = entries(spark, [(T0 + timedelta(seconds=s), "ERROR", "database down") for s in times]).withColumn(
        "severity", F.lit("LOW"))
    fired = alerts.alert_cooldown(alerts.alert_matches(rows, [rule, rule._replace(name="off", enabled=False)]))
    assert sorted((r["second"] - T0).seconds for r in fired.collect()) == [0, 10, 20, 31]


def test_scoring_is_dealt_over_the_tasks_asked_for(spark):
    """After the joins of the rules there were as many tasks as cores, however many rows: one grew with the batch."""
    from pyspark.sql import functions as F

    from timberline.operators import anomaly

    rows = spark.range(3000).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").alias("line_number"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 20).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 5 == 0, "ERROR").otherwise("INFO").alias("log_level"),
        F.concat(F.lit("connection failed "), F.col("id") % 50).alias("message"), F.lit("s").alias("source"),
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("error_code"))
    plain, dealt = anomaly.rule_engine(rows), anomaly.rule_engine(rows, tasks=37)
    assert dealt.rdd.getNumPartitions() == 37
    order = ["file", "line_number"]
    assert plain.orderBy(order).collect() == dealt.orderBy(order).collect()
