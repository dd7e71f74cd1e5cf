"""SimHash near duplicates: a hierarchical index over fingerprints in Gray order.

Two fingerprints of 64 bits that differ in at most 4 places agree in at least one of 5 parts (in at least b - 4 of b).
So the top nodes of the index are masked bit patterns, one mask per choice of parts: every distinct
fingerprint belongs to one top node per mask, and these are dealt over the cluster by a shuffle. Within a top node
fingerprints are sorted by Gray rank, which puts such that differ in few bits side by side; eight neighbours make a node, eight
nodes the next one. A node keeps the bits its members share and that its parent doesn't share yet, so a search adds up
differences on the way down and leaves a whole group as soon as there are more than 4, or when the group is known to be
in the searcher's component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from timberline.llm.common import cut, map_rows
from timberline.llm.components import components
from timberline.operators.ordered import order_cells, with_key_index
from timberline.operators.skew import attach

DISTANCE = 4
WORDS = 4
SEED = 42
GROUP = 4096  # fingerprints of a top node; larger ones are divided into chunks
FAN = 8
STRIP = 65_536  # fingerprints of top nodes that are searched together
BLOCK = 2048  # searchers at a time


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half the hashes of the 4-word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and space and 09 to 0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[WORDS - 1:] if len(words) >= WORDS else ends[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:len(last)].tolist(), last.tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed bigint) of every row."""
    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, texts in batches:
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield {"doc_id": ids, "fp": found.view(np.int64)}

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], run,
                    "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def split_masks(free: int, parts: int, keep: int) -> list[int]:
    """Masks of ``keep`` of ``parts`` nearly equal parts of the bits set in ``free``, for every choice of parts."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    sets = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(sets, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Level:
    """Nodes of one height: their shared bits without the parent's, and the borders of their children."""

    def __init__(self, first: np.ndarray, shared: np.ndarray, child: np.ndarray):
        self.first, self.shared, self.child = first, shared, child  # child: borders, one more than nodes
        self.own = shared.copy()


def build(keys: np.ndarray, x: np.ndarray) -> list[Level]:
    """Levels from the top nodes (one per key) down to the fingerprints; rows sorted by key, then Gray rank."""
    levels = [Level(x, np.full(len(x), 2 ** 64 - 1, np.uint64), np.arange(len(x) + 1))]
    group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
    while True:
        below = levels[-1]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        if len(starts) == len(group) and len(levels) > 1:
            break
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        at = np.flatnonzero(place % FAN == 0)
        sizes = np.diff(np.append(at, len(group)))
        lead = below.first[at]
        same = np.bitwise_and.reduceat(below.shared & ~(below.first ^ np.repeat(lead, sizes)), at)
        below.own = below.shared & ~np.repeat(same, sizes)
        levels.append(Level(lead, same, np.append(at, len(group))))
        group = group[at]
    return levels[::-1]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places, and all that had their labels, the smallest label."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        if np.array_equal(before, label):
            return


def joined(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component of every row among the rows of its key: the first row it is linked to, directly or not."""
    levels = build(keys, x)
    n = len(x)
    label = np.arange(n)
    top = levels[0]
    reach = [None] * len(levels)  # rows below the nodes of each level
    reach[-1] = np.arange(n + 1)
    for k in range(len(levels) - 2, -1, -1):
        reach[k] = reach[k + 1][levels[k].child]
    for a in range(0, n, BLOCK):
        z = min(n, a + BLOCK)
        # which component all rows of a node are in, -1 if in several
        whole = [None] * len(levels)
        whole[-1] = label
        for k in range(len(levels) - 2, -1, -1):
            at, inner = levels[k].child[:-1], whole[k + 1]
            low, high = np.minimum.reduceat(inner, at), np.maximum.reduceat(inner, at)
            whole[k] = np.where(low == high, low, -1)
        who = np.arange(a, z)
        node = np.searchsorted(reach[0], who, side="right") - 1
        far = np.zeros(len(who), np.int64)
        for k, level in enumerate(levels):
            if k:
                sizes = levels[k - 1].child[node + 1] - levels[k - 1].child[node]
                before = np.cumsum(sizes) - sizes
                node = np.repeat(levels[k - 1].child[node] - before, sizes) + np.arange(sizes.sum())
                who, far = np.repeat(who, sizes), np.repeat(far, sizes)
            far = far + np.bitwise_count((x[who] ^ level.first[node]) & level.own[node])
            # later rows only, so that every pair is met once
            keep = (far <= DISTANCE) & (reach[k][node + 1] - 1 > who) & (whole[k][node] != label[who])
            who, node, far = who[keep], node[keep], far[keep]
        if len(who):
            _merged(label, who, node)
    return label


def links(rows: DataFrame) -> DataFrame:
    """a, b: links that hold the fingerprints of each top node together. ``rows``: mask, pattern, part, fp, distinct.

    A component of m fingerprints in a node gives m - 1 links, each to the half-way one before it, so none has many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def solve(part: np.ndarray) -> pa.RecordBatch:
            keys = np.cumsum(np.concatenate([[0], (part[1:, :3] != part[:-1, :3]).any(axis=1).astype(np.int64)]))
            x = part[:, 3].copy().view(np.uint64)
            order = np.lexsort((gray_rank(x), keys))
            x, label = x[order], joined(keys[order], x[order])
            turn = np.argsort(label, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], label[turn][1:] != label[turn][:-1]]))
            start = np.repeat(starts, np.diff(np.append(starts, len(turn))))
            place = np.arange(len(turn)) - start
            b = np.flatnonzero(place > 0)
            a = start[b] + (place[b] - 1) // 2
            return pa.RecordBatch.from_pydict({"a": x[turn[a]].view(np.int64), "b": x[turn[b]].view(np.int64)})

        for batch in batches:
            kept.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1))
            if sum(map(len, kept)) >= STRIP:
                part = np.concatenate(kept)
                borders = np.flatnonzero((part[1:, :3] != part[:-1, :3]).any(axis=1)) + 1
                if len(borders):  # the last node may go on in the next batch
                    yield solve(part[:borders[-1]])
                    part = part[borders[-1]:]
                kept = [part]
        if sum(map(len, kept)):
            yield solve(np.concatenate(kept))

    key = ["mask", "pattern", "part"]
    dealt = rows.select(*key, "fp").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def top_nodes(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """mask, pattern, part, fp: every fingerprint under one masked pattern per mask.

    The number of parts follows from the number of fingerprints, so that patterns stay small on average as they
    grow in number. A pattern of more than ``group`` fingerprints is divided in Gray order into chunks of ``group``. A
    chunk keeps the bits that all its members share; two chunks whose shared bits differ in more than 4 places hold no
    link and are never brought together, any other two are a node of their own (``part`` numbers both chunks).
    """
    total, parts = fps.count(), DISTANCE + 1
    while parts < 12 and total > (group // 8) << (64 * (parts - DISTANCE) // parts):
        parts += 1
    masks = F.array(*[F.lit(_signed(m)) for m in split_masks(2 ** 64 - 1, parts, parts - DISTANCE)])
    rows = (fps.withColumn("mask", F.explode(masks))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), F.lit(-1).cast("bigint").alias("part"), "fp"))
    key = ["mask", "pattern"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    large = cut(counts.filter(F.col("_n") > group))
    if large.isEmpty():
        return rows
    told = cut(attach(rows, large, key, "_n"))
    ranked = told.filter("_n is not null").select("mask", "pattern", "fp", F.col("fp").alias("rank"))
    for shift in (1, 2, 4, 8, 16, 32):
        ranked = ranked.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    order = [*key, "rank"]
    placed = cut(with_key_index(order_cells(ranked, order), order, key, "_at")
                 .select(*key, F.floor(F.col("_at") / group).alias("chunk"), "fp"))
    upper = cut(placed.groupBy(*key, "chunk").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")))

    def side(name: str) -> DataFrame:
        shared = F.bitwise_not(F.col("low").bitwiseXOR(F.col("high")))
        return upper.select(*key, F.col("chunk").alias(name), F.col("low").alias(f"{name}_bits"), shared.alias(f"{name}_shared"))

    apart = F.bit_count(F.col("i_bits").bitwiseXOR(F.col("j_bits")).bitwiseAND(F.col("i_shared")).bitwiseAND(F.col("j_shared")))
    pairs = (side("i").join(side("j"), key).filter((F.col("i") <= F.col("j")) & (apart <= DISTANCE))
             .select(*key, (F.shiftleft("i", 31) + F.col("j")).alias("part"),
                     F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")))
    return (told.filter("_n is null").drop("_n")
            .unionByName(placed.join(pairs, [*key, "chunk"]).select(*key, "part", "fp")))


def near_classes(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    Documents are linked if their fingerprints differ in at most 4 bits; component_id is the smallest doc_id of all
    that links lead to, itself included. Texts without words (null and empty ones too) have fingerprint zero and are linked like any
    other. Rows with a null doc_id take part and name no component: where no row of a component has an id, component_id is
    null. Repeated rows give a row each; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs).withColumn("_row", F.monotonically_increasing_id()))
    kinds = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    near = cut(links(top_nodes(kinds, group)))
    linked = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    labels = components(linked, near).select(F.col("node").alias("fp"), "label")
    known = cut(kinds.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = attach(known.select("fp", "n", "label"), least, ["label"], "_n").select("fp", "n", "component_id")
    met = attach(rows, named, ["fp"], "n")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return met.select("doc_id", digits.alias("fingerprint"), "component_id")
