"""Behaviour over time: spikes, runs, co-occurrence, gaps, rare templates."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline.functions import timing as M
from timberline.operators.ordered import order_cells, with_carried, with_index, with_previous
from timberline.operators.templates import with_template
from timberline.session import cut

ORDER = ["timestamp", "file", "line_number"]


def _insight(df: DataFrame, kind: str, title: Column, summary: Column, confidence: Column,
             evidence: dict[str, Column], order: Column) -> DataFrame:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(kind).alias("insight_type"), title.alias("title"), summary.alias("summary"),
        confidence.alias("confidence"), F.create_map(*pairs).alias("evidence"), order.alias("position"))


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def timed_anomalies(reports: DataFrame) -> DataFrame:
    return with_template(reports).filter("timestamp is not null").select(*ORDER, "template")


def spike(timed: DataFrame, minutes: int = 15, zscore: float = 2.0) -> DataFrame:
    """The most prominent bucket; empty buckets count as zeros in mean and deviation."""
    counts = timed.groupBy(M.time_bucket("timestamp", minutes).alias("slot")).agg(F.count("*").alias("c"))
    total, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
    span = F.timestamp_diff("MINUTE", F.min("slot"), F.max("slot")) / minutes + 1
    var = F.when(span > 1, (squares - total * total / span) / (span - 1)).otherwise(0.0)
    base = counts.agg(F.struct((total / span).alias("mean"), F.sqrt(var).alias("std"))).scalar()
    s, c, z = F.col("_s"), F.col("c"), F.col("z")
    hits = (counts.withColumn("_s", base).filter(s["std"] > 0)
            .withColumn("z", (c - s["mean"]) / s["std"]).filter(z >= zscore)
            .withColumn("conf", F.least(F.lit(1.0), 0.45 + z * 0.1)))
    top = hits.orderBy(F.col("conf").desc(), "slot").limit(1)
    return _insight(
        top, "frequency_spike",
        F.concat(F.lit("Anomaly spike at "), F.date_format("slot", "yyyy-MM-dd'T'HH:mm")),
        F.format_string(
            f"Anomaly volume reached %d events within the {minutes}m bucket; "
            "this is %.1fσ above the local average (%.1f).", c, z, s["mean"]),
        F.col("conf"),
        {"bucket_start": _iso("slot"), "event_count": c, "z_score": F.round("z", 3)}, F.lit(1))


def ordered_steps(timed: DataFrame) -> DataFrame:
    """Anomalies in time order, each with the one before it. Shared by runs and gaps."""
    return with_previous(order_cells(timed, ORDER), ORDER, ["timestamp", "template"])


def repeating_sequences(steps: DataFrame, gap_seconds: int = 120) -> DataFrame:
    """Runs of one template without long pauses; the two strongest."""
    prev = F.col("prev")
    continues = (prev["template"] == F.col("template")) & (
        M.seconds_between(prev["timestamp"], F.col("timestamp")) <= gap_seconds)
    start = F.when(~F.coalesce(continues, F.lit(False)), F.struct(*ORDER))
    runs = (
        with_carried(steps, ORDER, start, "run").groupBy("run")
        .agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"),
             F.min("template").alias("template"))
        .filter("n >= 3").withColumn("conf", F.least(F.lit(1.0), 0.35 + F.col("n") * 0.08)))
    top = runs.orderBy(F.col("conf").desc(), "run").limit(2)
    seconds = F.floor(M.seconds_between(F.col("a"), F.col("b"))).cast("bigint")
    return _insight(
        top, "repeating_sequence", F.lit("Repeating error sequence detected"),
        F.format_string(
            "A template recurred %d times within ~%ds. This suggests a systematic trigger "
            "rather than a single transient fault.", F.col("n"), seconds),
        F.col("conf"),
        {"template": F.col("template"), "count": F.col("n"), "start": _iso("a"), "end": _iso("b")},
        F.lit(2))


def _numbered_windows(timed: DataFrame, window: int) -> DataFrame:
    """(template, slot, no): the windows of each template, numbered in order of time from 0."""
    seen = cut(timed.select(M.time_bucket("timestamp", window).alias("slot"), "template").distinct())
    slots = seen.select("slot").distinct()
    numbers = with_index(order_cells(slots, ["slot"]), ["slot"], "no").select(F.col("slot").alias("_slot"), "no")
    return cut(seen.join(numbers, F.col("slot") == F.col("_slot")).drop("_slot"))


class Pair(NamedTuple):
    """Two templates: shared windows, the first of them, and the names in order; larger pairs come first."""

    k: int
    first: int
    a: str
    b: str

    def rank(self) -> tuple:
        return -self.k, self.first, self.a, self.b


def best_pair(left: list[tuple[str, list[int]]], right: list[tuple[str, list[int]]] | None, least: int) -> Pair | None:
    """The pair with most shared windows, at least ``least``; ties to the earliest shared window, then names.

    Sides are (name, windows), from most windows to fewest; with no right side, pairs within the left one. Windows become
    bitmaps over those that occur here. A row meets only partners that have as many windows as the best pair found so far, and
    reading ends where no row has.
    """
    slots = np.unique(np.concatenate([np.array(w) for _, w in (left + (right or []))]))

    def bitmaps(side):
        dense = np.zeros((len(side), -(-len(slots) // 64) * 64), np.uint8)
        for row, (_, windows) in zip(dense, side):
            row[np.searchsorted(slots, windows)] = 1
        return np.packbits(dense, axis=1, bitorder="little").view("<u8"), np.array([len(w) for _, w in side])

    (x, nx), (y, ny) = bitmaps(left), bitmaps(right if right is not None else left)
    names = [n for n, _ in (right if right is not None else left)]
    best = None
    for i, (name, _) in enumerate(left):
        if nx[i] < least:
            break
        low, high = (i + 1 if right is None else 0), int(np.searchsorted(-ny, -least, side="right"))
        if low >= high:
            continue
        both = y[low:high] & x[i]
        k = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        top = int(k.max())
        if top < least:
            continue
        tied = np.flatnonzero(k == top)
        bits = np.unpackbits(both[tied].view(np.uint8), axis=1, bitorder="little")
        first = slots[bits.argmax(axis=1)]
        for t in np.flatnonzero(first == first.min()):
            other = names[low + tied[t]]
            pair = Pair(top, int(first[t]), min(name, other), max(name, other))
            if best is None or pair.rank() < best.rank():
                best = pair
        least = max(least, top)
    return best


def _over_blocks(kinds: DataFrame, bound: int, block: int) -> DataFrame:
    """(k, first, template, other): the best pair of every two blocks of ``kinds`` (template, windows, n).

    Blocks follow one another from most windows to fewest; two of them can only beat ``bound`` if both reach it. Pairs stay inside
    the tasks, one row per two blocks comes out.
    """
    order = ["_few", "template"]
    cells = order_cells(kinds.withColumn("_few", -F.col("n")), order)
    dealt = cut(with_index(cells, order, "_at").select("template", "windows", "n", F.floor(F.col("_at") / block).alias("block")))
    tops = cut(dealt.groupBy("block").agg(F.max("n").alias("most")).filter(F.col("most") >= bound))
    two = (tops.select(F.col("block").alias("i")).join(tops.select(F.col("block").alias("j")), F.col("i") <= F.col("j"))
           .select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: (-r["n"], r["template"]))
        left, right = ([(r["template"], r["windows"]) for r in rows if r["block"] == b] for b in (i, j))
        found = best_pair(left, None if i == j else right, bound)
        return pa.Table.from_pylist([found._asdict()] if found else [], schema=pa.schema(
            [("k", pa.int64()), ("first", pa.int64()), ("a", pa.string()), ("b", pa.string())]))

    return (dealt.join(two, "block").groupBy("i", "j").applyInArrow(run, "k bigint, first bigint, a string, b string")
            .select("k", "first", F.col("a").alias("template"), F.col("b").alias("other")))


def correlated_templates(timed: DataFrame, minutes: int = 15, seeds: int = 50, block: int = 4096) -> DataFrame:
    """The two templates sharing most time windows.

    Pairs are not listed. Templates seen in exactly the same windows are one kind, of which the two first by name
    matter; the best pair of a kind and of the ``seeds`` most widespread templates is a lower bound m. The kinds seen in at least m
    windows are dealt to blocks by falling number of windows, and the bitmaps of every two blocks are compared in a task,
    which gives up what can't reach the best pair found.
    """
    window = max(minutes * 2, 30)
    if 60 % window:
        window = 60
    seen = _numbered_windows(timed, window)
    spread = seen.groupBy("template").agg(F.count("*").alias("n"))
    head = spread.orderBy(F.col("n").desc(), "template").limit(seeds).select("template")
    few = seen.join(F.broadcast(head), "template").select("no", "template")  # at most `seeds` templates per window
    both = few.join(few.select("no", F.col("template").alias("other")), "no").filter("template < other")
    shared = both.groupBy("template", "other").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
    sets = (seen.groupBy("template").agg(F.array_sort(F.collect_list("no")).alias("windows"))  # at most one per window
            .withColumn("n", F.size("windows").cast("bigint")).filter("n >= 2"))
    by_name = Window.partitionBy("windows").orderBy("template")
    first_two = cut(sets.withColumn("_place", F.row_number().over(by_name)).filter(F.col("_place") <= 2))
    twins = first_two.groupBy("windows", "n").agg(F.min("template").alias("template"), F.max("template").alias("other")).filter(
        "template < other").select(F.col("n").alias("k"), F.col("windows")[0].alias("first"), "template", "other")
    bound = max(2, shared or 0, twins.agg(F.max("k")).first()[0] or 0)
    kinds = first_two.filter((F.col("_place") == 1) & (F.col("n") >= bound)).select("template", "windows", "n")
    counted = twins.unionByName(_over_blocks(kinds, bound, block))
    top = counted.filter("k >= 2").orderBy(F.col("k").desc(), "first", "template", "other").limit(1)
    k = F.col("k")
    return _insight(
        top, "correlated_anomalies", F.lit("Correlated anomaly templates"),
        F.format_string(
            "Templates co-occurred in the same time windows %d times. "
            "This may indicate a shared underlying failure mode.", k),
        F.least(F.lit(1.0), 0.3 + k * 0.15),
        {"template_a": F.col("template"), "template_b": F.col("other"), "cooccurrence_windows": k},
        F.lit(3))


def unusual_gap(steps: DataFrame, zscore: float = 2.0) -> DataFrame:
    """The longest pause between neighbours when it stands out."""
    prev = F.col("prev")
    gaps = steps.filter("prev is not null").select(
        F.floor(M.seconds_between(prev["timestamp"], F.col("timestamp"))).cast("bigint").alias("gap"),
        prev["timestamp"].alias("a"), F.col("timestamp").alias("b"), "file", "line_number")
    top = gaps.agg(
        F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"),
        F.min_by(F.struct("gap", "a", "b"), F.struct(-F.col("gap"), "b", "file", "line_number")).alias("w"))
    z = (F.col("w.gap") - F.col("mean")) / F.col("std")
    hit = top.filter("std > 0").withColumn("z", z).filter(F.col("z") >= zscore)
    return _insight(
        hit, "unusual_time_gap", F.lit("Unusual pause between anomalies"),
        F.format_string(
            "Consecutive anomalies are separated by %ds, which is %.1fσ above the typical gap (%.1fs).",
            F.col("w.gap"), F.col("z"), F.col("mean")),
        F.least(F.lit(1.0), 0.35 + F.col("z") * 0.1),
        {"gap_seconds": F.col("w.gap"), "z_score": F.round("z", 3), "start": _iso("w.a"), "end": _iso("w.b")},
        F.lit(4))


def rare_templates(timed: DataFrame, share: float = 0.02) -> DataFrame:
    """The three rarest templates that occur at least twice."""
    total = timed.agg(F.count("*")).scalar()
    counts = timed.groupBy("template").agg(F.count("*").alias("c"), F.min(F.struct(*ORDER)).alias("seen"))
    rare = (counts.filter((F.col("c") >= 2) & (F.col("c") / total <= share))
            .orderBy("c", "seen").limit(3))
    listed = rare.agg(F.array_sort(F.collect_list(F.struct("c", "seen", "template"))).alias("r"))
    texts = F.transform("r", lambda x: F.concat(x["template"], F.lit(" x"), x["c"].cast("string")))
    return _insight(
        listed.filter(F.size("r") > 0), "rare_templates", F.lit("Rare log template activity"),
        F.lit("A small number of templates appear infrequently, which may indicate a secondary "
              "or edge-case failure mode."),
        F.lit(0.4), {"rare_templates": F.array_join(texts, "; ")}, F.lit(5))


def detect_patterns(reports: DataFrame, minutes: int = 15, zscore: float = 2.0, gap_seconds: int = 120,
                    rare_share: float = 0.02) -> DataFrame:
    """All insights, in the order spike, runs, co-occurrence, gap, rare."""
    timed = timed_anomalies(reports)
    steps = ordered_steps(timed)
    parts = [
        spike(timed, minutes, zscore), repeating_sequences(steps, gap_seconds),
        correlated_templates(timed, minutes), unusual_gap(steps, zscore),
        rare_templates(timed, rare_share)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
