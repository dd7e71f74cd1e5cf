"""Isolation forest: trees grown in parallel on bounded samples, rows scored in batches."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from timberline import constants as K


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of (feature, cut, left, right, path length); feature -1 marks a leaf."""
    nodes: list[list[float]] = [[]]
    todo = [(0, points, 0)]
    while todo:
        at, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            nodes[at] = [-1, 0.0, -1, -1, depth + _average_path(len(rows))]
            continue
        feature = int(rng.choice(spread))
        cut = rng.uniform(rows[:, feature].min(), rows[:, feature].max())
        below = rows[:, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [[], []]
        nodes[at] = [feature, cut, left, right, 0.0]
        todo += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return np.array(nodes, dtype=float)


def _mean_depth(points: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(points))
    for tree in trees:
        at = np.zeros(len(points), dtype=int)
        while True:
            feature = tree[at, 0].astype(int)
            inner = np.flatnonzero(feature >= 0)
            if len(inner) == 0:
                break
            node = tree[at[inner]]
            below = points[inner, feature[inner]] <= node[:, 1]
            at[inner] = np.where(below, node[:, 2], node[:, 3]).astype(int)
        total += tree[at, 4]
    return total / len(trees)


def _draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A hash of every row for one tree."""
    with np.errstate(over="ignore"):
        x = (keys + np.uint64(1 + tree)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sketch:
    """The rows with the smallest draws for each tree; sketches of parts add up to that of the whole."""

    def __init__(self, trees: int, sample: int):
        self.sample = sample
        self.draws = [np.zeros(0, np.uint64) for _ in range(trees)]
        self.rows = [np.zeros((0, len(K.FEATURES))) for _ in range(trees)]

    def add(self, tree: int, draws: np.ndarray, rows: np.ndarray) -> None:
        mine = self.draws[tree]
        if len(mine) == self.sample:
            near = draws < mine[-1]
            draws, rows = draws[near], rows[near]
        if len(draws):
            draws, rows = np.concatenate([mine, draws]), np.concatenate([self.rows[tree], rows])
            # equal draws are told apart by the features, so the order in which parts come doesn't matter
            first = np.lexsort((*rows.T[::-1], draws))[:self.sample]
            self.draws[tree], self.rows[tree] = draws[first], rows[first]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for tree, (draws, rows) in enumerate(zip(self.draws, self.rows)):
            if len(draws):
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree], pa.int32()), "draws": pa.array([draws.tobytes()], pa.binary()),
                    "rows": pa.array([rows.tobytes()], pa.binary())})

    def read(self, tree: int, draws: bytes, rows: bytes) -> None:
        found = np.frombuffer(draws, np.uint64)
        self.add(tree, found, np.frombuffer(rows, float).reshape(len(found), -1))


PARTS = 64
_SKETCH = "tree int, draws binary, rows binary"


def sample_trees(featured: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, draws, rows): for every tree the ``sample`` rows with the smallest hash of row and tree.

    One pass over the rows: each task keeps a sketch, sketches are added up in two steps, so a task
    meets a ``PARTS``th of them, some 16 KB each. Every tree has its own draw from all rows, the same for any
    partitioning.
    """
    key = F.xxhash64(F.lit(seed), "file", "line_number")
    read = featured.select(key.alias("_key"), *[F.col(f).cast("double").alias(f) for f in K.FEATURES])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(trees, sample)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            points = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for tree in range(trees):
                sketch.add(tree, _draws(keys, tree, seed), points)
        yield from sketch.batches()

    def add(table: pa.Table) -> pa.Table:
        sketch = Sketch(trees, sample)
        for r in table.to_pylist():
            sketch.read(r["tree"], r["draws"], r["rows"])
        return pa.Table.from_batches(list(sketch.batches()))

    parts = read.mapInArrow(first, _SKETCH).withColumn("part", F.spark_partition_id() % PARTS)
    return parts.groupBy("tree", "part").applyInArrow(add, _SKETCH).groupBy("tree").applyInArrow(add, _SKETCH)


def grow_forest(featured: DataFrame, trees: int = K.FOREST_TREES, sample: int = K.FOREST_SAMPLE,
                seed: int = K.FOREST_SEED) -> tuple[list[np.ndarray], int]:
    """The trees, each grown on its own sample of the rows, and the size of a sample."""
    def grow(table: pa.Table) -> pa.Table:
        r = table.to_pylist()[0]
        points = np.frombuffer(r["rows"], float).reshape(-1, len(K.FEATURES))
        limit = math.ceil(math.log2(max(len(points), 2)))
        nodes = _grow(points, limit, np.random.default_rng([seed, r["tree"]]))
        return pa.table({"tree": pa.array([r["tree"]], pa.int32()), "n": pa.array([len(points)], pa.int32()),
                         "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})

    grown = sample_trees(featured, trees, sample, seed).groupBy("tree").applyInArrow(grow, "tree int, n int, nodes binary")
    rows = grown.orderBy("tree").collect()  # one small model per tree
    return [pickle.loads(bytes(r["nodes"])) for r in rows], max((r["n"] for r in rows), default=0)


def isolation_forest(featured: DataFrame, trees: int = K.FOREST_TREES, sample: int = K.FOREST_SAMPLE,
                     seed: int = K.FOREST_SEED, min_rows: int = K.FOREST_MIN_ROWS,
                     batch: DataFrame | None = None) -> DataFrame:
    """Add ml_score in 0-1, 1 for the most anomalous row; 0 for batches of fewer than ``min_rows``.

    ``batch`` holds the same rows with a shorter lineage, for growing the trees.
    """
    source = featured if batch is None else batch
    grown, drawn = grow_forest(source, trees, sample, seed)
    forest = featured.sparkSession.sparkContext.broadcast(grown)
    scale = _average_path(drawn) or 1.0

    @pandas_udf("double")
    def raw_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            depth = _mean_depth(pdf[K.FEATURES].to_numpy(dtype=float), forest.value)
            yield pd.Series(2.0 ** (-depth / scale))

    point = F.struct(*K.FEATURES)
    # the score range needs each distinct feature vector only once
    span = (source.select(*K.FEATURES).distinct().select(raw_score(point).alias("s"))
            .agg(F.struct(F.min("s").alias("low"), F.max("s").alias("high")))).scalar()
    size = source.agg(F.count("*")).scalar()
    width = F.col("_span.high") - F.col("_span.low")
    score = F.when((F.col("_size") < min_rows) | (width < 1e-10), 0.0).otherwise((F.col("_raw") - F.col("_span.low")) / width)
    return (featured.withColumn("_raw", raw_score(point)).withColumn("_span", span).withColumn("_size", size)
            .withColumn("ml_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
            .drop("_raw", "_span", "_size"))
