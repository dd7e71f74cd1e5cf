"""Alert rules and cooldowns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline import constants as K
from timberline.functions import timing as M
from timberline.session import cut


class AlertRule(NamedTuple):
    name: str
    severity: str | None = None
    keyword: str | None = None
    cooldown_seconds: int = 300
    enabled: bool = True


DEFAULT_RULES = [AlertRule(*r) for r in K.ALERT_RULES]


def alert_matches(reports: DataFrame, rules: list[AlertRule] | None = None) -> DataFrame:
    """(rule, cooldown_seconds, timestamp, file, line_number, severity, message, details).

    A rule matches on equal severity or on its keyword; the keyword is the reason given
    when both hold. Rules are configuration, so they become expressions, not a join.
    """
    found = []
    for r in rules if rules is not None else DEFAULT_RULES:
        if not r.enabled:
            continue
        reason = F.lit(None).cast("string")
        if r.severity:
            reason = F.when(F.col("severity") == r.severity,
                            F.concat(F.lit("Severity "), "severity", F.lit(" matched threshold")))
        if r.keyword:
            reason = F.when(F.contains(F.lower("message"), F.lit(r.keyword.lower())),
                            F.lit(f"Message matched keyword '{r.keyword}'")).otherwise(reason)
        found.append(F.when(reason.isNotNull(), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.cooldown_seconds).alias("cooldown_seconds"),
            reason.alias("details"))))
    hits = reports.select(
        "timestamp", "file", "line_number", "severity", "message",
        F.explode(F.array_compact(F.array(*found))).alias("m"))
    return hits.select("m.rule", "m.cooldown_seconds", "timestamp", "file", "line_number", "severity",
                       "message", "m.details")


DAY = 86_400  # seconds of a leaf of the firing tree
FAN = 64  # leaves or nodes under one node


class Firing(NamedTuple):
    """What a stretch of matches does to an alert that may fire from some second on, as a jump table.

    From second e on, the first match at or after e fires; ``leaves[k]`` is the second from which the next alert may
    fire after the stretch if ``enters[k]`` is that match. Later than the last match, nothing fires and e stays.
    """

    enters: np.ndarray
    leaves: np.ndarray

    def after(self, e: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.enters, e)
        found = np.append(self.leaves, 0)[k]
        return np.where(k < len(self.enters), found, e)


def firing_of(seconds: np.ndarray, wait: int) -> Firing:
    """Jump table of ordered seconds: the next match to fire is followed by doubling."""
    n = len(seconds)
    last = np.append(np.searchsorted(seconds, seconds + wait), n)  # n: beyond the stretch
    last[:n] = np.maximum(last[:n], np.arange(1, n + 1))
    final = np.where(last[:n] == n, np.arange(n), -1)  # the last one to fire, once it is known
    jump = last.copy()
    while (final < 0).any():
        open_ = np.flatnonzero(final < 0)
        final[open_] = final[jump[open_]]
        jump = jump[jump]
    return _needed(seconds, seconds[final] + max(wait, 1), wait) if n else Firing(seconds, seconds)


def _needed(enters: np.ndarray, leaves: np.ndarray, wait: int) -> Firing:
    """An alert enters a stretch less than the cooldown after its first match could fire, so later entries go."""
    upto = np.searchsorted(enters, enters[0] + wait) + 1
    return Firing(enters[:upto], leaves[:upto])


def composed(first: Firing, then: Firing, wait: int) -> Firing:
    """The jump table of two stretches, one after the other; this is associative."""
    if not len(first.enters):
        return then
    more = then.enters > first.enters[-1]
    return _needed(np.concatenate([first.enters, then.enters[more]]),
                   np.concatenate([then.after(first.leaves), then.leaves[more]]), wait)


def fired_from(seconds: np.ndarray, wait: int, e: int) -> np.ndarray:
    """Which of the ordered seconds fire if an alert may fire from e on: marks spread by doubling jumps."""
    n = len(seconds)
    jump = np.append(np.maximum(np.searchsorted(seconds, seconds + wait), np.arange(1, n + 1)), n)
    fired = np.zeros(n + 1, bool)
    fired[np.searchsorted(seconds, e)] = True
    while True:
        more = fired.copy()
        more[jump[fired]] = True
        if (more == fired).all():
            return fired[:n]
        fired, jump = more, jump[jump]


_TABLE = "rule string, cooldown_seconds bigint, node bigint, enters array<bigint>, leaves array<bigint>"
_ENTRY = "rule string, cooldown_seconds bigint, node bigint, entry bigint"
_EARLIEST = -(2 ** 62)
_ORIGIN = 2 ** 37


def _children(table: pa.Table) -> list[tuple[int, Firing]]:
    found = [(r["node"], Firing(np.array(r["enters"], np.int64), np.array(r["leaves"], np.int64))) for r in table.to_pylist()]
    return sorted(found, key=lambda c: c[0])


def _leaf(key: tuple, table: pa.Table) -> pa.Table:
    rule, wait, node = (k.as_py() for k in key)
    f = firing_of(np.sort(table["at"].to_numpy()), wait)
    return pa.table({"rule": [rule], "cooldown_seconds": [wait], "node": [node], "enters": [f.enters], "leaves": [f.leaves]})


def _parent(key: tuple, table: pa.Table) -> pa.Table:
    rule, wait, node = (k.as_py() for k in key)
    (_, f), *later = _children(table)
    for _, g in later:
        f = composed(f, g, wait)
    return pa.table({"rule": [rule], "cooldown_seconds": [wait], "node": [node], "enters": [f.enters], "leaves": [f.leaves]})


def _handed_down(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
    rule, wait, _ = (k.as_py() for k in key)
    nodes, entries = [], []
    if table.num_rows:
        e = entry["entry"][0].as_py() if entry.num_rows else _EARLIEST
        for node, f in _children(table):
            nodes.append(node)
            entries.append(e)
            e = int(f.after(np.array([e]))[0])
    return pa.table({"rule": [rule] * len(nodes), "cooldown_seconds": [wait] * len(nodes), "node": nodes, "entry": entries},
                    pa.schema([("rule", pa.string()), ("cooldown_seconds", pa.int64()), ("node", pa.int64()), ("entry", pa.int64())]))


def _marked(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
    rule, wait, _ = (k.as_py() for k in key)
    seconds = np.sort(table["at"].to_numpy()) if table.num_rows else np.zeros(0, np.int64)
    fired = seconds[fired_from(seconds, wait, entry["entry"][0].as_py() if entry.num_rows else _EARLIEST)]
    return pa.table({"rule": pa.array([rule] * len(fired), pa.string()), "cooldown_seconds": pa.array([wait] * len(fired), pa.int64()),
                     "at": pa.array(fired, pa.int64())})


def firing_seconds(seconds: DataFrame, span: int = DAY, fan: int = FAN) -> DataFrame:
    """(rule, cooldown_seconds, at): the seconds that fire, of distinct (rule, cooldown_seconds, at) in epoch seconds.

    Whether a second fires depends on all before it. So every rule and day becomes a jump table from entry to exit, tables
    of neighbouring days are composed ``fan`` at a time until one is left per rule, the entry of every day is handed
    down the same tree, and the days are marked on their own. A task holds the seconds of one rule and day, or
    ``fan`` tables of at most a cooldown of seconds each.
    """
    keys = ["rule", "cooldown_seconds", "node"]
    # counted from long ago, so that numbers are positive and meet in one root
    leaves = seconds.withColumn("node", F.floor((F.col("at") + _ORIGIN) / span))
    levels = [cut(leaves.groupBy(*keys).applyInArrow(_leaf, _TABLE))]
    up = F.floor(F.col("node") / fan)
    # as many levels as the number of days asks for
    while not levels[-1].groupBy("rule", "cooldown_seconds").agg((F.min("node") < F.max("node")).alias("_m")).filter("_m").isEmpty():
        levels.append(cut(levels[-1].groupBy("rule", "cooldown_seconds", up.alias("_up")).applyInArrow(_parent, _TABLE)))
    entries = levels[-1].select(*keys, F.lit(_EARLIEST).cast("bigint").alias("entry"))
    for level in levels[-2::-1]:
        below = level.groupBy("rule", "cooldown_seconds", F.floor(F.col("node") / fan).alias("_up"))
        above = entries.groupBy("rule", "cooldown_seconds", F.col("node").alias("_up"))
        entries = cut(below.cogroup(above).applyInArrow(_handed_down, _ENTRY))
    return leaves.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(
        _marked, "rule string, cooldown_seconds bigint, at bigint")


def alert_cooldown(matches: DataFrame, span: int = DAY, fan: int = FAN) -> DataFrame:
    """The matches that fire: at least the cooldown after the rule's last fired alert.

    Alerts keep time in whole seconds. Matches are reduced to the first one per rule and second; which seconds fire is
    found by ``firing_seconds``, and their matches are joined back.
    """
    row = F.struct("timestamp", "file", "line_number", "severity", "message", "details")
    second = F.date_trunc("second", "timestamp").cast("timestamp_ntz")
    thin = cut(
        matches.filter("timestamp is not null")
        .groupBy("rule", F.col("cooldown_seconds").cast("bigint").alias("cooldown_seconds"), second.alias("second"))
        .agg(F.min_by(row, F.struct("timestamp", "file", "line_number")).alias("r"))
        .withColumn("at", F.floor(M.epoch_micros("second") / 1_000_000).cast("bigint")))
    fired = firing_seconds(thin.select("rule", "cooldown_seconds", "at"), span, fan)
    return (thin.join(fired, ["rule", "cooldown_seconds", "at"], "left_semi")
            .select("rule", F.col("cooldown_seconds").cast(matches.schema["cooldown_seconds"].dataType).alias("cooldown_seconds"),
                    "second", "r.*"))
