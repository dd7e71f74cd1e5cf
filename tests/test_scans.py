"""Ordered scans, skew-safe joins and percentiles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import ordered as od, skew


def _data(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, 40), i, rng.choice([None, None, i])) for i in range(n)]


SCHEMA = "k string, t long, id long, v long"
ORDER = ["k", "t", "id"]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_a_loop(many_cells, seed):
    data = _data(seed)
    cells = od.order_cells(many_cells.createDataFrame(data, SCHEMA).repartition(5), ORDER)
    assert cells.select("_cell").distinct().count() > 1
    out = od.with_previous(cells, ORDER, ["id"])
    out = od.with_carried(out, ORDER, F.col("v"), "last_v")
    out = od.with_index(out, ORDER, "pos")
    out = od.with_key_index(out, ORDER, ["k"], "kpos")
    got = {r["id"]: (r["prev"] and r["prev"]["id"], r["last_v"], r["pos"], r["kpos"]) for r in out.collect()}
    last, prev, seen, want = None, None, {}, {}
    for pos, (k, t, i, v) in enumerate(sorted(data, key=lambda r: r[:3])):
        last = v if v is not None else last
        want[i] = (prev, last, pos, seen.get(k, 0))
        seen[k] = seen.get(k, 0) + 1
        prev = i
    assert got == want


def test_percentiles_are_exact(many_cells):
    df = many_cells.createDataFrame([(float(x % 37),) for x in range(1000)], "x double").repartition(7)
    want = df.agg(F.percentile("x", 0.95), F.percentile("x", 0.99), F.percentile("x", 0.5)).first()
    got = od.percentiles(df, "x", [0.95, 0.99, 0.5]).first()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]
    one = od.percentiles(many_cells.createDataFrame([(5.0,)], "x double"), "x", [0.95]).first()
    assert one["p95"] == 5.0


def test_attach_serves_hot_and_cold_keys(spark):
    rows = spark.createDataFrame(
        [("f", i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [("f", 9999, None)],
        "file string, line_number long, key string")
    stats = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    got = skew.attach(rows, stats, ["key"], "n", hot_keys=100)
    want = rows.join(stats, "key", "left").select("file", "line_number", "key", "n")
    assert got.count() == rows.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attach_spreads_null_keys(many_cells):
    """Rows that can't match don't meet in one partition, even without a broadcast join."""
    spark = many_cells
    rows = spark.range(40_000).selectExpr(
        "'f' as file", "id as line_number", "case when id % 20 = 0 then concat('k', id % 4000) end as key").repartition(5)
    stats = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
                                             "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # no key is hot, so all matches are made in the shuffle join
        out = skew.attach(rows, stats, ["key"], "n", hot_keys=1)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert out.filter("key is not null and n is null").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / 16
