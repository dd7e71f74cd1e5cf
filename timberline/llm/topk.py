"""Exact top-k by integer inner product from sorted lists alone, without random access.

A shard of candidates is kept as one sorted list per component. A query reads the lists of its
positive weights from the top and those of its negative weights from the bottom. After each round of
reading every candidate has a lower bound (what was read of it, and the worst value of the other lists)
and an upper bound (what was read, and the last value read of the other lists). A query is done when its k
best by lower bound are exact and no other candidate, seen or not, can reach them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timberline.llm import vectors
from timberline.llm.common import cut, spread

SHARD = 16_384


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per component: candidate numbers by falling value, and the values in that order."""
    order = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
    return order, np.take_along_axis(x.T, order, 1)


def _read(order: np.ndarray, values: np.ndarray, depth: int, top: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the first ``depth`` entries of every list say (from the other end unless ``top``): values by
    candidate and component (0 if not read), whether not read, and the last value read per list."""
    d, n = order.shape
    part = slice(0, depth) if top else slice(n - depth, n)
    known, unread = np.zeros((n, d)), np.ones((n, d))
    column = np.arange(d)[:, None]
    known[order[:, part], column] = values[:, part]
    unread[order[:, part], column] = 0
    return known, unread, values[:, depth - 1] if top else values[:, n - depth]


def no_random_access(order: np.ndarray, values: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray,
                     k: int, first: int = 16, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: query number, candidate number, score.

    Reading starts with 1/``first`` of the lists and doubles. Candidates that no query still reading can
    use are set aside, so later rounds are over few. ``own`` is the id a query must not return. Sums are
    exact in doubles while they stay below 2^53. Ties go to the smaller id: a query isn't done while an
    outsider may still tie.
    """
    d, n = order.shape
    out: list[tuple[np.ndarray, ...]] = []
    least, most = values[:, -1], values[:, 0]
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        reading = np.arange(len(q))  # queries not done
        alive = np.arange(n)  # candidates that matter to one of them
        depth = max(1, -(-n // first))
        while len(reading):
            depth = min(depth, n)
            up, down = np.maximum(q[reading], 0), np.minimum(q[reading], 0)
            top, top_unread, top_last = _read(order, values, depth, True)
            low, low_unread, low_last = _read(order, values, depth, False)
            seen = np.concatenate([top[alive], low[alive]], axis=1) @ np.concatenate([up, down], axis=1).T
            unread = np.concatenate([top_unread[alive], low_unread[alive]], axis=1)
            upper = seen + unread @ np.concatenate([up * top_last, down * low_last], axis=1).T
            lower = seen + unread @ np.concatenate([up * least, down * most], axis=1).T
            mine = ids[alive][:, None] == own[a + reading][None, :]
            upper[mine] = lower[mine] = -np.inf
            kk = min(k, len(alive))
            border = np.partition(lower, len(alive) - kk, axis=0)[len(alive) - kk]  # k-th best lower bound
            rivals = upper >= border  # all that may be among the k best, ties included
            exact = (lower == upper) | ~rivals
            done = exact.all(axis=0) | (depth == n)
            for j in np.flatnonzero(done):
                c = alive[np.flatnonzero(rivals[:, j] & np.isfinite(upper[:, j]))]
                score = lower[np.searchsorted(alive, c), j]
                turn = np.lexsort((ids[c], -score))[:k]
                out.append((np.full(len(turn), a + reading[j]), c[turn], score[turn]))
            alive = alive[rivals[:, ~done].any(axis=1)]
            reading = reading[~done]
            depth *= 2
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard: int = SHARD,
          block: int = 4096) -> DataFrame:
    """The k highest integer inner products of every query (vec_id, embedding) with all other rows.

    Components x become floor(``scale`` * x). A query's own vec_id is no candidate; see
    ``vectors.usable`` for what takes no part (zero vectors do). Rows are dealt to shards of about
    ``shard`` by a hash of id and vector; every block of queries meets every shard. Returns
    query_id, rank, vec_id, score.
    """
    candidates = cut(vectors.usable(rows, zero=True))
    asked = cut(vectors.usable(queries, zero=True, like=candidates))
    shards = spread(candidates.count(), shard)

    def to_lists(table: pa.Table) -> pa.Table:
        order, values = sorted_lists(np.floor(scale * vectors.matrix(table["embedding"])))
        ids = table["vec_id"].to_numpy().astype(np.int64)
        return pa.table({"shard": table["shard"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()),
                         "order": pa.array([order.tobytes()], pa.binary()),
                         "listed": pa.array([values.astype(np.float64).tobytes()], pa.binary())})

    lists = cut(candidates.withColumn("shard", vectors.shard_of(F.struct("vec_id", "embedding"), shards))
                .groupBy("shard").applyInArrow(to_lists, "shard int, ids binary, order binary, listed binary"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        who, at, score, ids, own = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            g = left.to_pylist()[0]
            ids = np.frombuffer(g["ids"], np.int64)
            own = right["query_id"].to_numpy()
            q = np.floor(scale * vectors.matrix(right["embedding"]))
            who, at, score = no_random_access(np.frombuffer(g["order"], np.int32).reshape(-1, len(ids)),
                                              np.frombuffer(g["listed"], float).reshape(-1, len(ids)), ids, q, own, k)
        return pa.table({"query_id": own[who].astype(np.int64), "vec_id": ids[at].astype(np.int64),
                         "score": score.astype(np.int64)})

    found = vectors.per_shard(lists, shards, asked, asked.count(), block, find,
                              "query_id bigint, vec_id bigint, score bigint")
    return vectors.best(found, k)
