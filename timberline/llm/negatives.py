"""Hard negatives by exact integer scores from Kronecker-packed products.

A shard of candidates is packed by component: the j-th components of all its candidates, lifted to be
non-negative, stand in fields of equal width in one wide integer. An anchor multiplies each of these integers once
by its own j-th component and adds the products up, so every field holds one candidate's inner product. Fields are
wide enough that no sum reaches into its neighbour; one added constant keeps them non-negative. Unpacking gives the
exact scores of the whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from timberline.llm import vectors
from timberline.llm.common import cut, spread

SHARD = 16_384
LARGEST = 2 ** 63 - 1


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: int64 where that is sure to hold it, Python ints otherwise."""
    x = np.floor(scale * vectors.matrix(column))
    if x.size == 0 or np.abs(x).max() < 2.0 ** 62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


class Packed:
    """Candidates of one shard, packed for anchors whose components have absolute values of at most ``weight`` in sum."""

    def __init__(self, rows: np.ndarray, weight: int):
        self.n, _ = rows.shape
        self.low = int(rows.min())
        self.span = int(rows.max()) - self.low
        self.width = max(1, -(-(2 * weight * self.span).bit_length() // 8))  # bytes of a field
        self.words = [self._join([int(v) - self.low for v in column]) for column in rows.T]
        self.ones = self._join([1] * self.n)

    def _join(self, fields: list[int]) -> int:
        if self.width <= 8:
            cells = np.array(fields, "<u8").view(np.uint8).reshape(self.n, 8)[:, :self.width]
            return int.from_bytes(cells.tobytes(), "little")
        return int.from_bytes(b"".join(f.to_bytes(self.width, "little") for f in fields), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of an anchor with all candidates. Beyond 64 bits they are Python ints."""
        lift = sum(map(abs, anchor)) * self.span
        total = lift * self.ones
        for a, packed in zip(anchor, self.words):
            if a:
                total += a * packed
        raw = total.to_bytes(self.n * self.width, "little")
        back = self.low * sum(anchor) - lift
        if self.width < 8 and abs(back) < 2 ** 62:
            cells = np.zeros((self.n, 8), np.uint8)
            cells[:, :self.width] = np.frombuffer(raw, np.uint8).reshape(self.n, self.width)
            return cells.view("<i8")[:, 0] + back
        return np.array([int.from_bytes(raw[k:k + self.width], "little") + back
                         for k in range(0, len(raw), self.width)], object)


def _best(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k of ``at`` with the highest scores; ties to the earlier position."""
    mine = scores[at]
    if len(at) > 4 * k and mine.dtype != object:
        floor = np.partition(mine, len(mine) - k)[len(mine) - k]
        at, mine = at[mine >= floor], mine[mine >= floor]
    return at[np.argsort(-mine, kind="stable")[:k]]


def _saturated(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-LARGEST, min(LARGEST, int(s))) for s in scores], np.int64)


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding, one row per vec_id; see ``mine`` for who is left out."""
    good = vectors.usable(rows.filter("label is not null"), zero=True)
    labels = rows.filter("label is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    return (labels.join(good, ["vec_id", "embedding"], "left_semi").groupBy("vec_id")
            .agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"))


def _per_shard(shards: DataFrame, asked: DataFrame, n_shards: int, n_asked: int, block: int, weight: int, scale: int,
               find, names: str) -> DataFrame:
    """Every anchor row of ``asked`` meets every shard. A shard is copied once per ``block`` anchors; inside a task it
    comes first and its anchors stream past it, one Arrow batch at a time."""
    blocks = spread(n_asked, block)
    columns = asked.columns
    target = pa.schema([(name, pa.int64()) for name in names.split()])
    here = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(0).alias("_turn"),
                         F.col("members"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns])
    there = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block"), F.lit(1).alias("_turn"),
                         F.lit(None).cast(shards.schema["members"].dataType).alias("members"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = ids = labels = None
        for batch in batches:
            out: list[dict] = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                members = row["members"][0]
                if members.is_valid:  # a shard begins
                    inner = members.values
                    order = np.argsort(inner.field("vec_id").to_numpy(zero_copy_only=False), kind="stable")
                    inner = inner.take(pa.array(order))
                    ids = inner.field("vec_id").to_numpy(zero_copy_only=False)
                    codes = inner.field("label").dictionary_encode()
                    labels = codes.indices.to_numpy(), codes.dictionary.to_pylist()
                    packed = Packed(integers(inner.field("embedding"), scale), weight)
                    continue
                anchor = integers(row["embedding"], scale)[0]
                label = row["label"][0].as_py()
                same = labels[0] == (labels[1].index(label) if label in labels[1] else -1)
                out += find(row, ids, same, packed.scores([int(v) for v in anchor]))
            yield pa.RecordBatch.from_pylist(out, schema=target)

    tasks = max(n_shards * blocks, shards.sparkSession.sparkContext.defaultParallelism)
    met = here.unionByName(there).repartition(tasks, "shard", "_block").sortWithinPartitions("shard", "_block", "_turn")
    return met.mapInArrow(run, ", ".join(f"{name} bigint" for name in names.split()))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10),
         high: tuple[int, int] = (9, 10), scale: int = 256, shard: int = SHARD, block: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; ``anchors`` names the anchors by vec_id. The positives of an anchor are its
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other labels whose score n lies
    in low * p <= n <= high * p of the positive's score p (fractions as integer pairs) are returned, best first, ties to
    the smaller vec_id. A negative p allows nothing, p = 0 allows n = 0.

    Left out: rows with a null vec_id, label or vector, empty vectors, vectors with null or non-finite components or
    with another number of components than most. Of different rows with one vec_id the one with the smallest (label,
    vector) takes part; equal rows count once. Other columns are ignored. Scores beyond 64 bits are ranked exactly
    inside a shard and saturate at +-(2^63 - 1) in the result. Empty tables give no rows.

    Candidates are dealt by a hash of their id to shards of about ``shard``; two passes over them find positives and
    then negatives; between them only the few best per shard travel.
    """
    taking = cut(taking_part(rows))
    who = anchors.select(F.col("vec_id").cast("bigint").alias("vec_id")).filter("vec_id is not null").distinct()
    asked = cut(taking.join(who, "vec_id", "left_semi"))
    n_rows, n_asked = taking.count(), asked.count()
    n_shards = spread(n_rows, shard)
    # a bound of the absolute components' sum, rounded up; fields are sized by it
    sums = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")) * scale + 1)
    heaviest = asked.agg(F.max(sums)).first()[0] or 0.0
    weight = int(heaviest * 1.000001) + 1 if heaviest < float("inf") else 2 ** 1100
    shards = cut(taking.withColumn("shard", vectors.shard_of("vec_id", n_shards)).groupBy("shard")
                 .agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias("members")))

    def best_of_label(row, ids, same, scores):
        own = row["vec_id"][0].as_py()
        top = _best(np.flatnonzero(same & (ids != own)), scores, positives)
        return [{"anchor_id": own, "positive_id": int(i), "positive_score": s}
                for i, s in zip(ids[top], _saturated(scores[top]))]

    found = _per_shard(shards, asked, n_shards, n_asked, block, weight, scale, best_of_label,
                       "anchor_id positive_id positive_score")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut(found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives)
                 .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("chosen")))
    with_positives = asked.join(chosen, asked["vec_id"] == chosen["anchor_id"]).select("vec_id", "label", "embedding", "chosen")

    def best_in_band(row, ids, same, scores):
        own, others, known, out = row["vec_id"][0].as_py(), np.flatnonzero(~same), {}, []
        theirs = scores[others]
        for p in row["chosen"][0].as_py():
            s = p["positive_score"]
            if s not in known:
                least, most = -(-low[0] * s // low[1]), high[0] * s // high[1]
                top = _best(others[(theirs >= max(least, -LARGEST)) & (theirs <= min(most, LARGEST))], scores, negatives)
                known[s] = list(zip(ids[top].tolist(), _saturated(scores[top]).tolist()))
            out += [{"anchor_id": own, "positive_id": p["positive_id"], "positive_score": s, "negative_id": i,
                     "negative_score": n} for i, n in known[s]]
        return out

    pairs = _per_shard(shards, with_positives, n_shards, n_asked, block, weight, scale, best_in_band,
                       "anchor_id positive_id positive_score negative_id negative_score")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
