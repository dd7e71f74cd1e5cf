"""Vectors in shards, queries in blocks, and the merge of what each shard found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timberline.llm.common import spread


def usable(rows: DataFrame, zero: bool, like: DataFrame | None = None) -> DataFrame:
    """vec_id and embedding of the rows that take part in a search, each (id, vector) once.

    Left out: null ids, null or empty vectors, vectors holding null or non-finite components, all-zero
    vectors unless ``zero``, and vectors whose number of components isn't the most common one
    of these rows or, where given, of the usable rows ``like``.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(e, lambda x: x != 0)
    good = (rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
            .filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).filter(finite & some))
    sizes = (good if like is None else like).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return good
    return good.filter(F.size("embedding") == sizes["d"]).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def per_shard(shards: DataFrame, n_shards: int, queries: DataFrame, n_queries: int, block: int,
              search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring every block of queries together with every shard.

    ``shards`` has a column ``shard`` and rows of bounded total size per shard; ``queries`` (vec_id,
    embedding) are dealt to blocks of about ``block``. Each shard is repeated per block of queries and
    each query per shard, so a task holds one shard and one block, however many there are of either.
    """
    blocks = spread(n_queries, block)
    left = shards.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (queries.select(F.col("vec_id").alias("query_id"), "embedding",
                            F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))))
    return left.groupBy("shard", "_block").cogroup(right.groupBy("shard", "_block")).applyInArrow(search, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards: highest score first, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def shard_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, added from the first component to the last, so
    that equal vectors get equal scores wherever they stand."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total
