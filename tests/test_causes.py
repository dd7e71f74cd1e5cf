"""Root causes, cascades and patterns against brute force."""

import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from timberline.operators import chunks, patterns, root_cause as rc, settle

T0 = datetime(2024, 1, 15, 10, 0, 0)
EVENTS = ("event_id string, title string, description string, start timestamp_ntz, end timestamp_ntz, confidence double, "
          "severity string, template_pattern string, event_count long, first_file string, first_line long")
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def _events(seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randint(0, 6000))
        end = start + timedelta(seconds=rng.choice([0, 5, 60, 900]))
        words = " ".join(rng.sample(["db", "down", "retry", "<NUM>", "timeout", "auth"], 3))
        timed = rng.random() > 0.1
        out.append((f"f:{i}", f"t{i}", "d", start if timed else None, end if timed else None,
                    round(rng.uniform(0.3, 1.0), 3), rng.choice(list(RANK)), words, rng.randint(2, 9), "f", i))
    return out


def _score(a, b):
    if a[3] is None or b[3] is None:
        temporal = 0.0
    else:
        gap = (max(a[3], b[3]) - min(a[4], b[4])).total_seconds()
        temporal = 1.0 if gap <= 0 else max(0.0, 1 - gap / 120)
    step = RANK[b[6]] - RANK[a[6]]
    escalation = min(0.5, step * 0.2) if step > 0 else 0.0
    x, y = set(a[7].lower().split()), set(b[7].lower().split())
    return round(temporal * 0.5 + escalation * 0.3 + round(len(x & y) / len(x | y) * 0.3, 3) * 0.2, 3)


def _greedy(data):
    """event_id to leader, one after the other in order of confidence."""
    data = sorted(data, key=lambda e: (-e[5], e[9], e[10]))
    want = {}
    for i, lead in enumerate(data):
        if lead[0] in want:
            continue
        want[lead[0]] = lead[0]
        for other in data[i + 1:]:
            if other[0] not in want and _score(lead, other) >= 0.4:
                want[other[0]] = lead[0]
    return want


@pytest.mark.parametrize("seed, block", [(3, 50_000), (4, 50_000), (5, 50_000), (4, 7)])
def test_cascades_equal_the_sequential_greedy(spark, seed, block):
    data = _events(seed)
    events = spark.createDataFrame(data, EVENTS)
    leaders = rc.cut(rc.cascade_leaders(events, block=block))
    got = {r["event_id"]: r["leader_id"] for r in rc.cascade_map(events, leaders).collect()}
    assert got == _greedy(data)
    done = rc.detect_cascades(events, rc.cascade_map(events, leaders))
    assert done.agg(F.sum("event_count")).first()[0] == sum(e[8] for e in data)


def _chain(n, seconds):
    return [(f"e{i:03}", "t", "d", T0 + timedelta(seconds=seconds * i), T0 + timedelta(seconds=seconds * i + 5), 0.5, "LOW", "a b", 2, "f", i)
            for i in range(n)]


@pytest.mark.parametrize("seconds, block, rounds", [(20, 50_000, 1), (300, 50_000, 1), (300, 20, 1), (20, 50, 5)])
def test_chains_of_equal_confidence_take_few_rounds(spark, monkeypatch, seconds, block, rounds):
    """Each group waits for the one before it; a block settles them all the same. A chain longer than a block goes on
    from block to block."""
    data = _chain(200, seconds)
    seen = []
    monkeypatch.setattr(rc, "_verdicts", lambda *a, f=rc._verdicts: seen.append(1) or f(*a))
    leaders = rc.cascade_leaders(spark.createDataFrame(data, EVENTS), block=block)
    want = _greedy(data)
    assert {r["event_id"] for r in leaders.collect()} == set(want.values())
    assert len(seen) <= rounds


def test_long_events_across_many_blocks(many_cells):
    """A third of the events spans everything."""
    rng = random.Random(8)
    data = _events(8, 60)
    data = [e if i % 3 else (*e[:3], T0 + timedelta(seconds=rng.randint(0, 500)), T0 + timedelta(seconds=6000), *e[5:])
            for i, e in enumerate(data)]
    leaders = rc.cascade_leaders(many_cells.createDataFrame(data, EVENTS), block=5)
    assert {r["event_id"] for r in leaders.collect()} == set(_greedy(data).values())


def test_events_after_a_guest_too_many_wait_for_it(spark):
    """Eight guests come before the one that absorbs the later block; they are absorbed where they began."""
    def event(i, start, end, confidence):
        at = [T0 + timedelta(seconds=s) for s in (start, end)]
        return (f"e{i:03}", "t", "d", *at, confidence, "LOW", "a b", 2, "f", i)

    data = [event(0, 0, 60, 0.99), *[event(i, i, 400, 0.98 - i / 100) for i in range(1, 9)], event(9, 200, 1000, 0.8)]
    data += [event(10, 390, 395, 0.5), *[event(i, 540 + i, 541 + i, 0.6) for i in range(11, 20)],
             *[event(i, 800 + i, 801 + i, 0.6) for i in range(20, 30)]]
    leaders = rc.cascade_leaders(spark.createDataFrame(data, EVENTS), block=10)
    assert {r["event_id"] for r in leaders.collect()} == {"e000", "e009"} == set(_greedy(data).values())


def test_many_guests_equal_the_sequential_greedy(many_cells, monkeypatch):
    monkeypatch.setattr(rc, "_settle_long", lambda *a, f=rc._settle_long: f(*a, guests=1))
    rng = random.Random(1)
    data = _events(1, 80)
    data = [e if e[3] is None else (*e[:4], e[3] + timedelta(seconds=rng.choice([0, 200, 900])), *e[5:]) for e in data]
    leaders = rc.cascade_leaders(many_cells.createDataFrame(data, EVENTS), block=8)
    assert {r["event_id"] for r in leaders.collect()} == set(_greedy(data).values())


def _reports(spark, items):
    return spark.createDataFrame(
        [("a.log", i + 1, ts, msg, sev, "app", "why") for i, (ts, msg, sev) in enumerate(items)],
        "file string, line_number long, timestamp timestamp_ntz, message string, severity string, source string, summary string")


def test_sessions_split_on_pauses_and_keep_untimed_rows(many_cells):
    items = [(T0 + timedelta(seconds=s), f"db down {i}", "LOW") for i, s in enumerate([0, 100, 200, 900, 1000])]
    items += [(None, "db down 9", "HIGH"), (None, "db down 8", "LOW"), (T0, "other", "LOW")]
    got = rc.sessionize_templates(_reports(many_cells, items).repartition(3), 300)
    sizes = Counter(r["event_id"] for r in got.collect())
    assert sorted(sizes.values()) == [1, 2, 2, 3]
    groups, members = rc.aggregate_root_causes(_reports(many_cells, items), 300)
    assert members.count() == 7 and groups.count() == 3


def test_escalation_and_actions(spark):
    items = [(T0 + timedelta(seconds=20 * i), f"Connection timeout to 10.0.0.{i}", s)
             for i, s in enumerate(["LOW", "LOW", "CRITICAL", "CRITICAL"])]
    causes, members = rc.build_root_causes(_reports(spark, items))
    r = causes.first()
    assert (r["severity"], r["event_count"], r["n_ips"], r["confidence"]) == ("CRITICAL", 4, 4, 0.9)
    assert r["recommended_action"][0].startswith("Inspect downstream dependency health")
    assert "Observed entities: 4 distinct IP(s), source=app." in r["summary"]
    assert members.count() == 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_pair_equals_counting_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows = [(T0 + timedelta(minutes=30 * rng.randint(0, 25)), rng.choice(words)) for _ in range(90)]
    seen = {(t, w) for t, w in rows}
    pairs, first = Counter(), {}
    for t in sorted({t for t, _ in seen}):
        here = sorted(w for s, w in seen if s == t)
        for i, a in enumerate(here):
            for b in here[i + 1:]:
                pairs[a, b] += 1
                first.setdefault((a, b), t)
    best = min(pairs, key=lambda p: (-pairs[p], first[p], p))
    timed = spark.createDataFrame([("f", i, t, w) for i, (t, w) in enumerate(rows)],
                                  "file string, line_number long, timestamp timestamp_ntz, template string")
    for seeds, block in ((2, 3), (50, 4096)):
        e = patterns.correlated_templates(timed, seeds=seeds, block=block).first()["evidence"]
        assert (e["template_a"], e["template_b"], int(e["cooccurrence_windows"])) == (*best, pairs[best])


@pytest.mark.parametrize("seed", range(6))
def test_best_pair_of_bitmaps_equals_counting(seed):
    rng = random.Random(seed)
    sides = []
    for side in "ab":
        rows = [(f"{side}{i}", sorted(rng.sample(range(0, 200, 3), rng.randint(2, 12)))) for i in range(40)]
        sides.append(sorted(rows, key=lambda r: (-len(r[1]), r[0])))

    def plain(pairs):
        found = [(-len(s), min(s), *sorted((p, q))) for (p, v), (q, w) in pairs if len(s := set(v) & set(w)) >= 2]
        return min(found, default=None)

    left, right = sides
    across = patterns.best_pair(left, right, 2)
    assert (across and across.rank()) == plain((x, y) for x in left for y in right)
    inside = patterns.best_pair(left, None, 2)
    assert (inside and inside.rank()) == plain((x, y) for i, x in enumerate(left) for y in left[i + 1:])
    assert patterns.best_pair(left, right, -across.rank()[0] + 1) is None


def test_a_crowded_window_makes_no_pairs(spark, monkeypatch):
    """3000 templates in one window, each in one more: rows out of the tasks grow with blocks, not with pairs."""
    rows = [("f", i, T0, f"t{i:04}") for i in range(3000)]
    rows += [("f", i, T0 + timedelta(minutes=30 * (1 + i % 1490)), f"t{i:04}") for i in range(3000)]
    timed = spark.createDataFrame(rows, "file string, line_number long, timestamp timestamp_ntz, template string")
    made = []
    monkeypatch.setattr(patterns, "_over_blocks", lambda *a, f=patterns._over_blocks: made.append(f(*a)) or made[-1])
    e = patterns.correlated_templates(timed, block=1000).first()["evidence"]
    assert (e["template_a"], e["template_b"], e["cooccurrence_windows"]) == ("t0000", "t1490", "2")
    assert made[0].count() <= 3


def test_runs_across_cells(many_cells):
    rows = [("f", i, T0 + timedelta(seconds=i), "boom") for i in range(40)]
    rows.append(("f", 99, T0 + timedelta(hours=2), "boom"))
    timed = many_cells.createDataFrame(rows, "file string, line_number long, timestamp timestamp_ntz, template string")
    steps = patterns.ordered_steps(timed.repartition(4))
    run = patterns.repeating_sequences(steps).collect()
    assert len(run) == 1 and run[0]["evidence"]["count"] == "40" and run[0]["confidence"] == 1.0
    gap = patterns.unusual_gap(steps).first()
    assert gap["evidence"]["gap_seconds"] == str(2 * 3600 - 39)


def test_a_returning_date_is_a_chunk_of_its_own(many_cells):
    texts = ["2024-01-01 ERROR a"] * 12 + ["2024-01-02 ok"] * 12 + ["2024-01-01 ERROR b", "undated"] * 6
    lines = many_cells.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)],
                                       "file string, line_number long, text string")
    got = chunks.temporal_chunks(chunks.index_lines(lines.repartition(3))).collect()
    all_chunks = [(r["label"], r["start_index"], r["end_index"], r["line_count"]) for r in got]
    assert sorted(all_chunks) == [("2024-01-01", 0, 11, 12), ("2024-01-01", 24, 35, 12)]
    got = chunks.temporal_chunks(chunks.index_lines(lines), last_only=True).collect()
    assert [(r["label"], r["start_index"], r["end_index"], r["line_count"]) for r in got] == [("2024-01-01", 24, 35, 12)]


def test_normal_chunks_cover_exactly_the_rest(many_cells):
    lines = many_cells.createDataFrame([("f", i + 1, f"line {i}") for i in range(95)],
                                       "file string, line_number long, text string")
    spans = many_cells.createDataFrame([("f", 5, 9), ("f", 8, 20), ("f", 90, 94)],
                                       "file string, start_index long, end_index long")
    got = chunks.normal_chunks(chunks.index_lines(lines), spans, 30).orderBy("start_index").collect()
    assert [(r["start_index"], r["end_index"], r["line_count"]) for r in got] == [(0, 45, 30), (46, 75, 30), (76, 89, 14)]


def test_one_file_of_many_chunks(many_cells):
    """20 000 spans in one file: the lines between them, without a window over the file."""
    spans = many_cells.range(20_000).selectExpr("'f' as file", "id * 10 as start_index", "id * 10 + id % 7 as end_index")
    indexed = many_cells.range(200_005).selectExpr("'f' as file", "id as index")
    got = chunks.normal_chunks(indexed, spans, 1000).orderBy("start_index").collect()
    free = [i for i in range(200_005) if i >= 200_000 or i % 10 > (i // 10) % 7]
    want = [(free[k], free[min(k + 1000, len(free)) - 1], min(1000, len(free) - k)) for k in range(0, len(free), 1000)]
    assert [(r["start_index"], r["end_index"], r["line_count"]) for r in got] == want


@pytest.mark.parametrize("seed, width", [(1, 7), (2, 50), (3, 5000)])
def test_merged_chunks_equal_comparing_all(spark, seed, width):
    rng = random.Random(seed)
    sides = []
    for kind in ("a", "b", "c"):
        rows = []
        for i in range(80):
            start = rng.randint(0, 600)
            end = start + rng.choice([0, 3, 20, 90, 400])
            rows.append((rng.choice("fg"), kind, 1, start, end, rng.randint(1, end - start + 1), 1, f"{kind}{i}"))
        sides.append(rows)
    frames = [spark.createDataFrame(rows, "file string, chunk_type string, priority int, start_index long, end_index long, "
                                          "line_count long, error_count long, label string") for rows in sides]
    got = {r["label"] for r in chunks.merge_chunks(frames, width).collect()}
    want, kept = {r[7] for r in sides[0]}, list(sides[0])
    for new in sides[1:]:
        passed = [n for n in new if not any(min(n[4], a[4]) - max(n[3], a[3]) + 1 > min(n[5], a[5]) * 0.5 and n[0] == a[0]
                                            and min(n[4], a[4]) >= max(n[3], a[3]) for a in kept)]
        kept += passed
        want |= {r[7] for r in passed}
    assert got == want


def test_settling_is_shipped_to_workers_without_the_package():
    code = cloudpickle.dumps((settle.Event, settle.settle))
    run = ("import sys, pickle; sys.modules['timberline'] = None; _, f = pickle.loads(bytes.fromhex(sys.stdin.read())); print(f([], 1, 0.4))")
    done = subprocess.run([sys.executable, "-c", run], input=code.hex(), capture_output=True, text=True)
    assert done.stdout.strip() == "[]", done.stderr
