"""Near-duplicates: ProbMinHash of word shingles, banding, verification, classes.

Exact copies (the same words in the same order) are one node from the start. Nodes that share a band of their
signatures are compared by the exact Jaccard similarity of their shingle sets. Groups are never paired out:
first every member of a bucket is compared with the bucket's first one, which is linear. Buckets that still hold
more than one class are compared block by block, where a pair of blocks is a product of two matrices in one task and
gives a spanning forest of its links. Only two blocks of the largest class of a group never meet, so no link is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline.llm.common import cut, map_rows, release, worker_state
from timberline.llm.components import components

_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


def shingles(text: str | None, n: int = 5) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes of the word n-grams of a whole text, how often each occurs, and a digest of all words.

    Words are lower-cased runs of letters, digits and underscores. A text of fewer than ``n`` words has one
    shingle of all of them; one without words has none.
    """
    known = worker_state("words", _Words)
    words = np.fromiter(map(known.__getitem__, _WORD.findall((text or "").lower())), np.uint64)
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    if not len(words):
        return words, words, digest
    size = max(1, len(words) - n + 1)
    h = np.full(size, n, np.uint64)
    for k in range(min(n, len(words))):
        h = _mix(h * _GOLDEN + words[k:k + size])
    found, count = np.unique(h, return_counts=True)
    return found, count, digest


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signature: two of them agree in a register with the probability Jaccard similarity.

    Every element is a Poisson process with its weight as rate; an arrival picks a register, which keeps
    its earliest arrival. An element is dropped once its next arrival is later than the latest time in any
    register. Arrivals are hashes of element and number, drawn some at a time for all elements.
    """
    time, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    active, rate = elements, weights.astype(float)
    clock, number = np.zeros(len(elements)), 1
    while len(active):
        draws = max(1, 2 * m // len(active))
        step = np.arange(number, number + draws, dtype=np.uint64)
        number += draws
        bits = _mix(active[:, None] + step * _GOLDEN)
        gap = -np.log(((bits >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52) / rate[:, None]
        at = clock[:, None] + np.cumsum(gap, axis=1)
        register = (_mix(bits) % np.uint64(m)).astype(np.int64).ravel()
        order = np.argsort(-at.ravel(), kind="stable")  # the earliest arrival is written last
        first = np.full(m, np.inf)
        who = np.zeros(m, np.uint64)
        first[register[order]] = at.ravel()[order]
        who[register[order]] = np.repeat(active, draws)[order]
        better = first < time
        time[better], owner[better] = first[better], who[better]
        clock = at[:, -1]
        go_on = clock < time.max()
        active, rate, clock = active[go_on], rate[go_on], clock[go_on]
    return owner


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, a digest of the words, band hashes and the set of shingle hashes (32 bits) per row."""
    def sign(batches: Iterator[list[list]]) -> Iterator[dict]:
        for ids, hashes, texts in batches:
            out: dict[str, list] = {"doc_id": ids, "text_hash": hashes, "digest": [], "bands": [], "shingles": []}
            for text in texts:
                found, _, digest = shingles(text, n)
                out["digest"].append(digest if len(found) else None)
                band: list[int] | np.ndarray = []
                if len(found):
                    # equal weights: registers agree with the similarity of the sets, by which links are verified
                    parts = prob_min_hash(found, np.ones(len(found)), bands * rows).reshape(bands, rows)
                    h = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        h = _mix(h * _GOLDEN + parts[:, k])
                    band = h.view(np.int64)
                out["bands"].append(band)
                out["shingles"].append(np.unique((found >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield out

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(keyed, ["doc_id", "text_hash", "text"], sign,
                    "doc_id bigint, text_hash bigint, digest binary, bands array<bigint>, shingles array<int>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``least``."""
    a, b = sets.select(F.col("row").alias("a"), F.col("shingles").alias("_a")), sets.select(
        F.col("row").alias("b"), F.col("shingles").alias("_b"))
    joined = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    either = F.size("_a") + F.size("_b") - shared
    return joined.filter(shared >= least * either - 1e-9).select("a", "b")


def _first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the first member of every bucket with each of its others."""
    heads = members.groupBy("bucket").agg(F.min("row").alias("a"))
    return members.join(heads, "bucket").filter("row <> a").select("a", F.col("row").alias("b")).distinct()


def near_rows(values: np.ndarray, lengths: np.ndarray, first: int, least: float) -> np.ndarray:
    """Smallest linked row of every row; rows are sets of ``lengths`` different ``values`` each.

    All rows are compared if ``first`` is their number, else the ``first`` ones with the others. Shared values are
    counted as the product of 0/1 matrices, some columns at a time.
    """
    n = len(lengths)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count > 1
    kept = often[column]
    owner, column = np.repeat(np.arange(n), lengths)[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, step, rest = int(often.sum()), 4096, 0 if first == n else first
    shared = np.zeros((first, n - rest), np.float32)
    for start in range(0, width, step):
        low, high = np.searchsorted(column, [start, start + step])
        part = np.zeros((n, min(step, width - start)), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        shared += part[:first] @ part[rest:].T
    either = lengths[:first, None] + lengths[None, rest:] - shared.astype(float)
    a, b = np.nonzero(shared >= least * either - 1e-9)
    b = b + rest
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            return label


def _groups(members: DataFrame, block: int) -> DataFrame:
    """by_bucket, group, row, label: what has to be compared. Buckets that share members are one group, so that a row
    travels once for all its bands; where that would be more than 8 blocks, every bucket is a group."""
    own = members.select(F.col("row").alias("node")).distinct()
    near = components(own, _first_pairs(members)).select(F.col("node").alias("row"), F.col("label").alias("near"))
    sizes = near.groupBy("near").agg(F.count("*").alias("_n"))
    large = F.col("_n") > 8 * block
    return (members.join(near.join(sizes, "near"), "row")
            .select(large.alias("by_bucket"), F.when(large, F.col("bucket")).otherwise(F.col("near")).alias("group"), "row", "label")
            .distinct())


def _block_links(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): links that join the near rows of every group, found in pairs of blocks of about ``block`` rows.

    Rows outside the largest class of their group meet all rows; two blocks of the largest class have nothing to tell.
    """
    key = ["by_bucket", "group"]
    placed = cut(_groups(members, block))
    tops = (placed.groupBy(*key, "label").agg(F.count("*").alias("_size")).groupBy(*key)
            .agg(F.max(F.struct("_size", "label")).alias("_top"), F.sum("_size").alias("_n")))
    told = placed.join(tops, key)
    one, top, at = F.col("_n") <= block, F.col("label") == F.col("_top.label"), F.xxhash64("row")
    outer, inner = F.ceil((F.col("_n") - F.col("_top._size")) / block), F.ceil(F.col("_top._size") / block)
    zero = F.lit(0).cast("bigint")
    part = F.when(one, zero).when(top, outer + F.pmod(at, inner)).otherwise(F.pmod(at, outer))
    others = F.sequence(zero, F.when(one, zero).when(top, outer - 1).otherwise(outer + inner - 1))
    dealt = (told.select(*key, part.alias("part"), "row", F.explode(others).alias("_other"))
             .select(*key, F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "row"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")])
        row, parts = table["row"].to_numpy(), table["part"].to_numpy()
        sets = table["shingles"].combine_chunks()
        lengths = sets.value_lengths().to_numpy().astype(np.int64)
        whole = table["i"][0].as_py() == table["j"][0].as_py()
        first = len(row) if whole else int((parts == parts[0]).sum())
        label = np.arange(len(row))
        if whole or first < len(row):  # else one of the two blocks is empty
            label = near_rows(sets.flatten().to_numpy(), lengths, first, least)
        moved = np.flatnonzero(label != np.arange(len(row)))
        return pa.table({"a": row[label[moved]], "b": row[moved]})

    return dealt.join(sets, "row").groupBy(*key, "i", "j").applyInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, n: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5,
            block: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id and kept.

    class_id is the smallest doc_id of the near-duplicate class: documents joined by any number of links of
    Jaccard similarity of at least ``least`` between their sets of ``n``-word shingles, or by being exact copies.
    kept marks the first document of a class. Every shingle of a set weighs the same in the signatures, however
    often it occurs; with ``bands`` x ``rows`` registers two documents of Jaccard similarity 0.8 miss each
    other with a chance of 7 in 100 000. Texts that are null or have no word are classes of their own. Rows that repeat both id
    and text are one document. Null ids come after all others. Other columns are not looked at.
    """
    table = cut(signatures(docs, n, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    copies = table.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("node"))
    first = cut(table.select("row", "bands").join(copies.select(F.col("node").alias("row")), "row", "left_semi"))
    spread = first.select("row", F.posexplode("bands").alias("_band", "_value"))
    bucketed = spread.select("row", F.xxhash64("_band", "_value").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = cut(bucketed.join(shared, "bucket"))
    nodes = buckets.select(F.col("row").alias("node")).distinct()
    sets = cut(table.select("row", "shingles").join(nodes.select(F.col("node").alias("row")), "row", "left_semi"))
    release(docs.sparkSession)
    links = cut(_similar(_first_pairs(buckets), sets, least))
    labels = components(nodes, links)
    release(docs.sparkSession)  # the files and plans of the round
    members = buckets.join(labels.withColumnRenamed("node", "row"), "row")
    mixed = (members.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
             .filter("_low <> _high").select("bucket"))
    mixed = cut(members.join(mixed, "bucket"))
    if not mixed.isEmpty():
        labels = components(nodes, cut(links.union(_block_links(mixed, sets, least, block))))
        release(docs.sparkSession)
    found = (table.select("row", "doc_id", "text_hash", "digest").join(copies, "digest", "left")
             .withColumn("node", F.coalesce("node", "row")).join(labels, "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heads = found.groupBy("label").agg(F.min(order).alias("_head"))
    return found.join(heads, "label").select(
        "doc_id", "text_hash", F.col("_head.doc_id").alias("class_id"), (F.col("row") == F.col("_head.row")).alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classes`` found to be the first of their class.

    Rows that repeat both id and text are one document and stay together. Rows without an id are documents of their
    own: of those with the text of the first of their class one stays.
    """
    groups = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("_kept"), F.min("kept").alias("_every"))
    marks = cut(groups.filter("not _kept or (doc_id is null and not _every)").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_kept"))
    match = docs["doc_id"].eqNullSafe(marks["_id"]) & (F.xxhash64(docs["text"]) == marks["_hash"])
    one = docs.filter("doc_id is null").dropDuplicates(["text"])  # before the join, so that no key is hot
    return docs.join(marks, match, "left_anti").unionByName(
        one.join(marks.filter("_kept"), F.xxhash64(one["text"]) == marks["_hash"], "left_semi"))
