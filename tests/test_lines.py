"""Lines, formats and fields on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.functions import fields as L, text as T
from timberline.operators import lines as ln, parse as ps


def rows(spark, texts, file="a.log"):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "file string, line_number long, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_merge_folds_traces_and_leading_continuation(spark):
    got = ln.merge_multiline(rows(spark, [
        "  stray line", "2024-01-15 10:00:00 start", "   at module.f", "\tat\x1b[31m module.g\x1b[0m", "   ",
        " 2024-01-15 10:00:01 indented entry", "next"])).orderBy("line_number").collect()
    assert [(r["line_number"], r["text"]) for r in got] == [
        (1, "stray line"), (2, "2024-01-15 10:00:00 start at module.f at module.g"),
        (6, "2024-01-15 10:00:01 indented entry"), (7, "next")]


def test_merge_does_not_depend_on_partitions(many_cells):
    texts = [("  " if i % 3 else "") + f"line {i}" for i in range(500)]
    base = rows(many_cells, texts).unionByName(rows(many_cells, texts[1:], "b.log"))
    want = sorted(map(tuple, ln.merge_multiline(base.coalesce(1)).collect()))
    for n in (3, 16):
        assert sorted(map(tuple, ln.merge_multiline(base.repartition(n)).collect())) == want
    assert len(want) == 167 + 167  # the second file opens with its own stray entry


@pytest.mark.parametrize("raw, want", [
    ("2024-01-15 10:30:45,123", datetime(2024, 1, 15, 10, 30, 45, 123000)),
    ("2024-01-15T10:30:45.5Z", datetime(2024, 1, 15, 10, 30, 45, 500000)),
    ("Jan  5 01:02:03", datetime(1900, 1, 5, 1, 2, 3)),
    ("15/Jan/2024:10:30:45 +0530", datetime(2024, 1, 15, 5, 0, 45)),
    ("1/15/2024 1:02:03 PM", datetime(2024, 1, 15, 13, 2, 3)),
    ("2024-02-30 10:00:00", None), ("yesterday", None), ("2024-01-15T10:30:45,123", None),
])
def test_timestamps(spark, raw, want):
    assert one(spark, L.parse_timestamp(F.lit(raw))) == want


def test_detection_needs_a_third_of_the_sample(spark):
    mixed = rows(spark, ["ERROR: x"] * 2 + ["plain words"] * 8)
    assert ps.detect_format(mixed).first()["detected"] is None
    clear = rows(spark, ["ERROR: x"] * 4 + ["plain words"] * 6)
    assert ps.detect_format(clear).first()["detected"] == "simple_level"


def test_parse_falls_back_to_unclassified_and_json_wins(spark):
    got = ps.parse_entries(rows(spark, [
        "2024-01-15 10:30:45,123 - app.db - ERROR - Connection failed to 10.0.0.5 code: E42",
        '{"level": "warn", "msg": "inline", "user": "bob", "status": 503}', "free text",
        "2024-01-15 10:30:46,000 - app.db - INFO - fine"])).orderBy("line_number").collect()
    assert [r["log_type"] for r in got] == ["python", "json", "UNCLASSIFIED", "python"]
    assert (got[0]["ip_address"], got[0]["error_code"], got[0]["source"]) == ("10.0.0.5", "E42", "app.db")
    assert (got[1]["log_level"], got[1]["message"], got[1]["username"], got[1]["error_code"]) == (
        "WARNING", "inline", "bob", "503")
    assert got[2]["message"] == "free text" and got[2]["log_level"] == "UNKNOWN"


def test_access_line_fields(spark):
    line = '10.1.2.3 - - [15/Jan/2024:10:30:45 +0000] "GET /x HTTP/1.1" 200 12 "-" "curl"'
    r = ps.parse_entries(rows(spark, [line] * 3)).first()
    assert (r["ip_address"], r["username"], r["error_code"], r["log_level"]) == ("10.1.2.3", None, "200", "UNKNOWN")


def test_syslog_has_no_level(spark):
    r = ps.parse_entries(rows(spark, ["Jan 15 10:30:45 web1 sshd[12]: ERROR: Failed password"])).first()
    assert (r["log_type"], r["log_level"], r["source"], r["message"]) == (
        "syslog", "UNKNOWN", "web1", "ERROR: Failed password")


@pytest.mark.parametrize("message, want", [
    ("Connection to 10.0.0.1:5432 failed after 30 s", "Connection to <IP> failed after <NUM> s"),
    ("id 550e8400-e29b-41d4-a716-446655440000 at 0x1f", "id <UUID> at <HEX>"),
    ("took 1.5 12 ms", "took <FLOAT> ms"), ("open /var/log/a.log now", "open <PATH> now"),
    ('user "bob" said', "user <STR> said"), ("", ""),
])
def test_templates(spark, message, want):
    assert one(spark, T.extract_template(F.lit(message))) == want


def test_tags_and_categories(spark):
    assert one(spark, T.semantic_tags(F.lit("Login failed: connection refused"), F.lit(""))) == [
        "authentication", "network"]
    assert one(spark, T.error_category(F.lit("Process killed: OUT OF MEMORY"))) == "resource"
    assert one(spark, T.error_tokens(F.lit("ERR-42 saw 503 and 12"))) == ["503", "ERR-42"]
    assert one(spark, T.error_tokens(F.lit("saw 503"))) == []


def test_merge_moves_only_border_lines(spark, tmp_path):
    """Lines read in order are folded in place: no exchange of the plan carries the text of a whole table."""
    texts = [t for i in range(3000) for t in (f"2024-01-15 10:00:{i % 60:02} entry {i}", "   at frame", "   ")[:1 + i % 3]]
    rows(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/one")
    lines = spark.read.parquet(f"{tmp_path}/one")
    seen = []
    real = ln.order_cells
    ln.order_cells = lambda df, order: seen.append(df.count()) or real(df, order)
    try:
        got = ln.merge_multiline(lines)
        assert got.count() == 3000 and "repartition" not in got._jdf.queryExecution().toString().lower()
    finally:
        ln.order_cells = real
    assert seen[0] <= 2 * lines.rdd.getNumPartitions()
    assert {r["text"].count("at frame") for r in got.collect()} == {0, 1}


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_reading_line_by_line(many_cells, seed):
    import random

    rng = random.Random(seed)
    texts = [rng.choice(["x head", "  more", "   ", "2024-01-01 10:00:00 at", "\tat y"]) for _ in range(200)]
    missing = set(rng.sample(range(200), 30))
    kept = [("f", i + 1, t) for i, t in enumerate(texts) if i not in missing]
    want, first = {}, None
    for _, n, t in kept:
        flags = rows(many_cells, [t]).select(T.normalize_line("text").alias("n"), T.is_continuation("text").alias("c"))
        clean, more = _line(flags, t)
        if first is None or not more:
            first = n
            want[n] = clean
        elif clean:
            want[first] += " " + clean
    frame = many_cells.createDataFrame(kept, "file string, line_number long, text string")
    for n in (1, 5):
        got = {r["line_number"]: r["text"] for r in ln.merge_multiline(frame.repartitionByRange(n, "line_number")).collect()}
        assert got == want


_FLAGS = {}


def _line(flags, text):
    if text not in _FLAGS:
        _FLAGS[text] = tuple(flags.first())
    return _FLAGS[text]
