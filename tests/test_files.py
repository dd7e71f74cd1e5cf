"""Files, stored reports and streams."""

import json
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline.operators import alerts
from timberline.sources import json_logs, reports, text as tx
from timberline.streaming import alerts as sa, counts, follow, monitor, partial, tail

T0 = datetime(2024, 1, 15, 10, 0, 0)


def test_numbers_across_blocks_and_blank_lines(spark, tmp_path):
    for name in ("a.log", "b.TXT"):
        (tmp_path / name).write_text("\n".join("" if i % 5 == 4 else f"{name} {i}" for i in range(3000)))
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "empty.log").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = tx.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * 2400
    assert all(r["text"].split()[1] == str(r["line_number"] - 1) for r in got)
    assert tx.dir_scan(spark, str(tmp_path)).count() == 2


def test_large_files_are_listed(spark, tmp_path):
    with (tmp_path / "large.log").open("wb") as f:
        f.truncate(150 << 20)  # sparse
    (tmp_path / "small.log").write_text("x")
    (tmp_path / "empty.log").write_text("")
    found = {r["file"].rsplit("/", 1)[1]: r["size"] for r in tx.scan_filter(spark, str(tmp_path)).collect()}
    assert found == {"large.log": 150 << 20, "small.log": 1}
    assert tx.scan_filter(spark, str(tmp_path), max_bytes=1 << 20).count() == 1


def test_bad_bytes_and_encodings(spark, tmp_path):
    (tmp_path / "u.log").write_bytes(b"ok \xff end\n")
    assert tx.scan_lines(spark, str(tmp_path)).first()["text"] == "ok � end"
    assert tx.scan_lines(spark, str(tmp_path), encoding="ISO-8859-1").first()["text"] == "ok \xff end"


@pytest.mark.parametrize("codec, encoding", [("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE"), ("utf-32-le", "UTF-32LE")])
def test_wide_lines_end_on_code_units(spark, tmp_path, codec, encoding):
    """Characters whose bytes look like a line end when read across two code units, over several blocks."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(["\u0a05", "\u0100", "\u0a00", "a", "\u000b", "\u010a", "\U0001f600"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    (tmp_path / "w.log").write_bytes(("\ufeff" + "\n".join(texts) + "\n").encode(codec))
    (tmp_path / "v.log").write_bytes("plain\r\nlines\n".encode(codec))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = tx.scan_lines(spark, str(tmp_path), encoding=encoding, keep_empty=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["file"][-5:], r["line_number"]): r["text"] for r in rows}
    assert got == {("w.log", i + 1): t for i, t in enumerate(texts)} | {("v.log", 1): "plain", ("v.log", 2): "lines"}


def test_stream_of_one_folder_only(spark, tmp_path):
    (tmp_path / "a b" / "sub").mkdir(parents=True)
    (tmp_path / "a b" / "x.log").write_text("top\n")
    (tmp_path / "a b" / "sub" / "y.log").write_text("below\n")
    for recursive, want in ((False, {"top"}), (True, {"top", "below"})):
        stream = tail.dir_stream(spark, str(tmp_path / "a b"), recursive=recursive)
        sub = tmp_path / str(recursive)
        sub.mkdir()
        _finish(stream.select("text"), sub)
        assert {r["text"] for r in spark.read.parquet(str(sub / "sink")).collect()} == want


def test_batches_of_files_are_bounded_by_their_bytes(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for i in range(1100):
        (tmp_path / "logs" / f"{i}.log").write_text(f"line {i}\n" + "x" * 90 + "\n")

    def batches(name, **bound):
        sizes = []
        stream = tail.dir_stream(spark, str(tmp_path / "logs"), **bound)
        (stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start().awaitTermination())
        return sizes

    assert batches("a") == [2200]
    assert batches("b", files_per_trigger=600) == [1200, 1000]
    cut = batches("c", bytes_per_trigger=60_000)
    assert sum(cut) == 2200 and 2 <= len(cut) <= 3 and max(cut) <= 2 * 60_000 / 98  # a file has 98 bytes or more


def test_json_lines_arrays_and_numeric_levels(spark, tmp_path):
    (tmp_path / "l.json").write_text('\n{"time": 1705314645123, "level": 50, "msg": "boom"}\nnot json\n'
                                     '{"arbitrary_key": "value"}\n')
    (tmp_path / "r.json").write_text(json.dumps(
        [{"TimeStamp": "2024-01-15T10:30:45Z", "level": "50", "Msg": "a"}, 7, {"msg": "b", "name": "svc"}]))
    got = json_logs.json_entries(json_logs.json_scan(spark, str(tmp_path))).collect()
    by = {(r["file"][-6:], r["line_number"]): r for r in got}
    assert set(by) == {("l.json", 1), ("l.json", 3), ("r.json", 1), ("r.json", 3)}
    assert by["l.json", 1]["log_level"] == "ERROR"
    assert by["l.json", 1]["timestamp"] == datetime(2024, 1, 15, 10, 30, 45, 123000)
    assert by["l.json", 3]["message"] == '{"arbitrary_key": "value"}'
    assert by["r.json", 1]["log_level"] == "UNKNOWN" and by["r.json", 1]["message"] == "a"
    assert by["r.json", 1]["timestamp"] == datetime(2024, 1, 15, 10, 30, 45)
    assert by["r.json", 3]["source"] == "svc"


def _odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "x", "\n", " "]) for _ in range(rng.randint(0, 8)))
    if kind < 4:
        return rng.choice([None, True, -1.5, 7])
    if kind == 4:
        return [_odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i},": _odd_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("seed", range(3))
def test_arrays_are_cut_at_the_commas_between_items(many_cells, tmp_path, seed):
    """Items with quotes, escapes, commas and brackets in strings, over several blocks, compact and spread over lines."""
    rng = random.Random(seed)
    want = {}
    for name, indent, n in (("a.json", None, 300), ("b.json", 2, 200), ("c.json", None, 1), ("d.json", None, 0)):
        items = [_odd_value(rng, 0) if rng.random() < 0.3 else {"id": i, "v": _odd_value(rng, 1)} for i in range(n)]
        (tmp_path / name).write_text("  " + json.dumps(items, indent=indent, ensure_ascii=bool(rng.getrandbits(1))) + " \n")
        want |= {(name, k + 1): v for k, v in enumerate(items) if isinstance(v, dict)}
    for name, text in (("open.json", '[{"a": 1}, {"b": 2}'), ("twice.json", '[{"a": 1}], [{"b": 2}]'), ("gap.json", '[{"a": 1},, {"b": 2}]'),
                       ("quote.json", '[{"a": "1}, {"b": 2}]'), ("bare.json", '[{"a": 1}, {b}]')):
        (tmp_path / name).write_text(text)
    (tmp_path / "lines.json").write_text('{"a": [1, 2]}\n{"b": 3}\n')
    before = many_cells.conf.get("spark.sql.files.maxPartitionBytes")
    many_cells.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = json_logs.json_scan(many_cells, str(tmp_path)).collect()
    finally:
        many_cells.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["file"].rsplit("/", 1)[1], r["line_number"]): json.loads(r["text"]) for r in rows}
    assert got == want | {("lines.json", 1): {"a": [1, 2]}, ("lines.json", 2): {"b": 3}}


def test_monitor_reads_new_files_once(spark, tmp_path):
    logs, out, state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
    logs.mkdir()

    def roll(name, level):
        (logs / name).write_text("".join(
            f"2024-01-15 10:00:{i:02d},000 - app - {level} - Connection refused by 10.0.0.{i}\n" for i in range(40)))

    def run():
        lines = tail.dir_stream(spark, str(logs))
        monitor.run_monitor(lines, str(out), str(state), deep=False).awaitTermination()
        return spark.read.parquet(str(out))

    roll("one.log", "ERROR")
    first = run()
    assert first.count() == 40 and first.filter("severity = 'LOW'").count() < 40
    roll("two.log", "INFO")
    assert run().count() == 80
    assert run().count() == 80
    stored = reports.read_reports(spark, str(out))
    day = stored.filter("event_date = date'2024-01-15'")
    assert day.count() == 80 and stored.filter("event_date = date'2024-01-16'").count() == 0
    assert "event_date" in day._jdf.queryExecution().toString().split("PartitionFilters:")[1][:200]
    assert sorted(r[0] for r in run().select("line_number").distinct().collect()) == list(range(1, 41))


def test_failing_batch_does_not_stop_the_stream(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("ERROR: x\n")
    out = str(tmp_path / "o")
    with monkeypatch.context() as m:
        m.setattr(monitor, "analyse", lambda *a, **k: 1 / 0)
        q = monitor.run_monitor(tail.dir_stream(spark, str(tmp_path / "logs")), out, str(tmp_path / "s"))
        q.awaitTermination()
        assert q.exception() is None
    monitor.replay_failed(spark, out, 0, deep=False)  # its lines were kept
    assert [r["log_level"] for r in spark.read.parquet(f"{out}/batch_id=0").collect()] == ["ERROR"]


def _batches(spark, folder, frames):
    """Write frames one after another, so a stream takes them in that order."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return (spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))


def _finish(stream, tmp_path, mode="append"):
    q = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode)
         .trigger(availableNow=True).start(str(tmp_path / "sink")))
    q.awaitTermination()


def test_cooldown_is_kept_between_batches(spark, tmp_path):
    def frame(seconds):
        return spark.createDataFrame(
            [(T0 + timedelta(seconds=s), "f", s, "LOW", "database down") for s in seconds],
            "timestamp timestamp_ntz, file string, line_number long, severity string, message string")

    stream = _batches(spark, tmp_path / "in", [frame([0, 3, 9]), frame([10, 12]), frame([21, 40])])
    _finish(sa.stream_alerts(stream, [alerts.AlertRule("db", None, "database", 10)]), tmp_path)
    got = sorted((r["second"] - T0).seconds for r in spark.read.parquet(str(tmp_path / "sink")).collect())
    assert got == [0, 10, 21, 40]


def test_late_rows_are_dropped(spark, tmp_path):
    def frame(minutes):
        return spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in minutes], "timestamp timestamp_ntz")

    stream = _batches(spark, tmp_path / "in", [frame([0, 0, 1]), frame([60]), frame([61]), frame([0, 120])])
    _finish(counts.spike_windows(stream, 60, 2), tmp_path)
    got = {r["start"]: (r["count"], r["is_spike"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert got[T0] == (2, True) and got[T0 + timedelta(minutes=1)] == (1, False)
    assert got[T0 + timedelta(minutes=60)] == (1, False)


def test_means_and_percentiles_of_windows_are_exact(spark, tmp_path):
    rng = random.Random(3)
    durations = {h: [rng.randrange(1, 25_000) / 100 for _ in range(32)] for h in range(40)}
    durations[40] = [float(i) for i in range(1, 30_001)]
    rng.shuffle(durations[40])
    durations[44] = [1.0]  # moves the watermark on
    rows = [(T0 + timedelta(hours=h, microseconds=i), x) for h, v in durations.items() for i, x in enumerate(v)]
    spark.createDataFrame(rows, "ts timestamp_ntz, duration_ms double").selectExpr("*", "true as success").repartition(5).write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, duration_ms double, success boolean").parquet(str(tmp_path / "in"))
    made = counts.sliding_requests(stream, "1 hour", "1 hour")
    (made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
     .trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination())
    got = {int((r["start"] - T0).total_seconds() // 3600): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == set(durations) - {44}
    for h, r in got.items():
        values = sorted(durations[h])
        assert r["avg_latency_ms"] == round(sum(round(x * 100) for x in values) / 100, 2) / len(values)
        assert r["p95_latency_ms"] == values[-(-95 * len(values) // 100) - 1]


def test_hot_rule_and_hot_template_over_batches(spark, tmp_path):
    """Thousands of rows of one rule and one template: the same alerts and sessions as walking through all rows."""
    rng = random.Random(4)
    batches = [sorted(1000 * k + rng.choice([0, 0, 3, 400, 401]) + rng.random() for _ in range(2500)) for k in range(3)]

    def frame(seconds):
        return spark.createDataFrame([(T0 + timedelta(seconds=x), "f", i, "LOW", "database down", "t") for i, x in enumerate(seconds)],
                                     "timestamp timestamp_ntz, file string, line_number long, severity string, message string, template string")

    frames = [frame(b) for b in batches] + [frame([9000.0])]
    stream = _batches(spark, tmp_path / "in", frames)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    _finish(sa.stream_alerts(stream, [alerts.AlertRule("db", None, "database", 2)]), tmp_path / "a")
    whole = sorted(int(x) for b in batches for x in b) + [9000]
    fired, last = {}, None
    for x in whole:
        if last is None or x - last >= 2:
            fired[x] = whole.count(x)
            last = x
    got = {int((r["second"] - T0).total_seconds()): r["matches"] for r in spark.read.parquet(str(tmp_path / "a" / "sink")).collect()}
    assert got == fired
    _finish(counts.session_groups(stream, 100), tmp_path / "b")
    sessions, times = [], sorted(x for b in batches for x in b)
    for x in times:
        if sessions and x - sessions[-1][1] < 100:
            sessions[-1] = (sessions[-1][0], x, sessions[-1][2] + 1)
        else:
            sessions.append((x, x, 1))
    rows = spark.read.parquet(str(tmp_path / "b" / "sink")).collect()
    assert sorted((r["start"], r["end"], r["event_count"]) for r in rows) == [
        (T0 + timedelta(seconds=a), T0 + timedelta(seconds=b), n) for a, b, n in sessions]


def test_rows_are_added_up_before_the_shuffle(spark):
    rows = spark.createDataFrame([(T0 + timedelta(milliseconds=7 * i), "t") for i in range(9000)] + [(None, "t")],
                                 "timestamp timestamp_ntz, template string").coalesce(1)
    got = partial.per_second(rows, ["template"]).collect()
    assert len(got) == 63 and sum(r["n"] for r in got) == 9000
    assert min(r["first"] for r in got) == T0 and max(r["last"] for r in got) == T0 + timedelta(milliseconds=7 * 8999)


def _followed(spark, tmp_path, **options):
    """Lines read so far by one query that is stopped and started again."""
    q = (tail.tail_stream(spark, str(tmp_path / "logs"), **options).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "follow-cp")).trigger(availableNow=True).start(str(tmp_path / "follow-out")))
    q.awaitTermination()
    return Counter(r["text"] for r in spark.read.schema("text string, file string, block bigint").parquet(str(tmp_path / "follow-out")).collect())


def test_tail_reads_appended_complete_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("line1\nhalf")
    assert _followed(spark, tmp_path) == {}  # from the end
    with (logs / "a.log").open("a") as f:
        f.write(" whole\r\n\nline2\nopen")
    (logs / "b.log").write_text("new file\n")
    assert _followed(spark, tmp_path) == {"half whole": 1, "line2": 1, "new file": 1}
    assert _followed(spark, tmp_path).total() == 3
    with (logs / "a.log").open("ab") as f:
        f.write(b" end \xff\n")
    assert _followed(spark, tmp_path) == {"half whole": 1, "line2": 1, "new file": 1, "open end \ufffd": 1}


def test_tail_follows_rotation_and_truncation(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "s.log").write_text("line1\nline2\n")
    assert _followed(spark, tmp_path) == {}
    with (logs / "s.log").open("a") as f:
        f.write("last of old\n")
    (logs / "s.log").rename(logs / "s.log.1")
    (logs / "s.log").write_text("first of new, longer than all that was read of the old one\n")
    want = Counter({"last of old": 1, "first of new, longer than all that was read of the old one": 1})
    assert _followed(spark, tmp_path) == want
    (logs / "s.log").write_text("cut\n")
    assert _followed(spark, tmp_path) == want + Counter({"cut": 1})


def test_chunks_of_a_followed_file_hold_every_line_once(tmp_path):
    rng = random.Random(2)
    lines = ["x" * rng.choice([0, 1, 5, 40]) + str(i) for i in range(500)]
    (tmp_path / "f.log").write_text("\n".join(lines) + "\n")
    for chunk in (1, 7, 64, 10 ** 6):
        reader = follow.LineReader({"path": str(tmp_path), "chunk": str(chunk), "since": "0"})
        spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [t for s in spans for b in reader.read(s) for t in b["text"].to_pylist()]
        assert got == lines


def test_json_arrays_are_scanned_without_range_partitions(spark, tmp_path, monkeypatch):
    """States of array pieces are summed within blocks, then over the blocks of a file: files are read once as lines and once
    as pieces, and no global order of all pieces is made (it was, nine times over)."""
    from timberline.operators import ordered
    from timberline.sources import json_logs

    def never(*_):
        raise AssertionError("pieces of all files were put in one order")

    monkeypatch.setattr(ordered, "order_cells", never)
    monkeypatch.setattr(json_logs, "order_cells", never, raising=False)
    items = [{"a": "x,]" * k, "b": [k, {"c": ","}]} for k in range(300)]
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(__import__("json").dumps(items, indent=1))
    with_blocks = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in with_blocks}
    try:
        for k, v in with_blocks.items():
            spark.conf.set(k, v)
        rows = json_logs.json_scan(spark, str(tmp_path)).orderBy("file", "line_number").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.line_number for r in rows] == [*range(1, 301)] * 2
    assert [__import__("json").loads(r.text) for r in rows] == items * 2


def test_stream_files_are_written_by_more_than_four_tasks(spark, tmp_path, monkeypatch):
    """The files of a stream were always four, whatever the number of rows."""
    import os

    from timberline.plans import files

    monkeypatch.setattr(files, "_once", lambda spark, d, name, write: write(str(tmp_path / name)) or str(tmp_path / name))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        path = files._time_files(spark, "", "rows", spark.range(6000).withColumnRenamed("id", "timestamp"), "timestamp")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 12
