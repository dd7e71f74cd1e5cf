"""Cooldowns as jump tables against walking through the seconds."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from timberline.operators import alerts


def walked(seconds, wait, e=None):
    fired, last = [], None
    for s in sorted(seconds):
        if (e is None or s >= e) and (last is None or s - last >= wait):
            fired.append(s)
            last = s
    return fired


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(-50, 300), max_size=80), st.integers(0, 60), st.integers(-60, 320))
def test_marks_and_exit_equal_walking(seconds, wait, e):
    s = np.array(sorted(seconds), np.int64)
    fired = walked(seconds, wait, e)
    assert s[alerts.fired_from(s, wait, e)].tolist() == fired
    if len(s) and e < s[0] + max(wait, 1):
        assert alerts.firing_of(s, wait).after(np.array([e])).tolist() == [fired[-1] + max(wait, 1) if fired else e]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 39), max_size=30), min_size=3, max_size=3), st.integers(0, 90))
def test_composition_is_associative_and_equals_the_whole(parts, wait):
    stretches = [np.array(sorted(40 * k + x for x in p), np.int64) for k, p in enumerate(parts)]
    a, b, c = (alerts.firing_of(s, wait) for s in stretches)
    left = alerts.composed(alerts.composed(a, b, wait), c, wait)
    right = alerts.composed(a, alerts.composed(b, c, wait), wait)
    whole = alerts.firing_of(np.concatenate(stretches), wait)
    for f in (left, right):
        assert f.enters.tolist() == whole.enters.tolist() and f.leaves.tolist() == whole.leaves.tolist()
    assert len(whole.enters) <= wait + 1


@pytest.mark.parametrize("span, fan", [(alerts.DAY, alerts.FAN), (100, 2), (37, 3)])
def test_a_rule_over_many_stretches(spark, span, fan, monkeypatch):
    """One rule over many days next to a rare one, a cooldown longer than a stretch, and times before 1970."""
    rng = random.Random(5)
    want, rows = set(), []
    for rule, wait, lo, hi, n in (("often", 7, -2000, 2000, 1500), ("slow", 450, 0, 4000, 300), ("once", 60, 10, 11, 1), ("all", 0, 0, 90, 40)):
        seconds = sorted(rng.sample(range(lo, hi), n))
        rows += [(rule, wait, s) for s in seconds]
        want |= {(rule, wait, s) for s in walked(seconds, wait)}
    table = spark.createDataFrame(rows, "rule string, cooldown_seconds bigint, at bigint").repartition(4)
    assert {tuple(r) for r in alerts.firing_seconds(table, span, fan).collect()} == want
    assert alerts.firing_seconds(table.limit(0), span, fan).count() == 0
