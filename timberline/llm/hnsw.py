"""Approximate nearest neighbours by inner product: one small-world graph per shard, results merged.

A graph is kept as flat arrays: vectors, the nodes of each level, and one row of neighbour numbers per node
and level (-1: none). Inserts and searches walk the graph for many vectors at once, one numpy row each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from timberline.llm import vectors
from timberline.llm.common import cut, spread

#: vectors of a shard; the graph of one takes about 4 MB at 64 components
SHARD = 8192
LINKS = 16  # neighbours of a node on upper levels; twice as many on the lowest


@dataclass
class Graph:
    """``level`` is each node's highest level; ``links[l]`` has a row for every node (-1 above its level)."""

    points: np.ndarray
    level: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = 0


def lift(points: np.ndarray) -> np.ndarray:
    """Add a component that gives all points the same length; queries get 0 there. Inner products stay, and
    the nearest by inner product become the nearest by distance, which graphs need."""
    squares = (points * points).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0)) if len(points) else squares
    return np.concatenate([points, rest[:, None]], axis=1).astype(np.float32)


def walk(graph: Graph, level: int, targets: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one level for all targets side by side: nodes (-1: none) and similarities, best first.

    Each step opens the best unopened node of every beam; a target is done when its beam is all open.
    """
    n, links = len(targets), graph.links[level]
    nodes = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    opened = np.ones((n, width), bool)
    seen = np.zeros((n, len(graph.points)), bool)
    row = np.arange(n)
    k = min(width, starts.shape[1])
    nodes[:, :k] = starts[:, :k]
    sims[:, :k] = np.where(nodes[:, :k] < 0, -np.inf, (graph.points[nodes[:, :k]] @ targets[:, :, None])[:, :, 0])
    opened[:, :k] = nodes[:, :k] < 0
    seen[row[:, None], np.maximum(nodes[:, :k], 0)] |= nodes[:, :k] >= 0
    active = row
    while len(active):
        open_sims = np.where(opened[active], -np.inf, sims[active])
        at = open_sims.argmax(axis=1)
        alive = np.isfinite(open_sims[np.arange(len(active)), at])
        active, at = active[alive], at[alive]
        if not len(active):
            break
        opened[active, at] = True
        around = links[nodes[active, at]]
        fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        who, where = np.nonzero(fresh)
        seen[active[who], around[who, where]] = True
        s = np.full(around.shape, -np.inf, np.float32)
        s[who, where] = np.einsum("nd,nd->n", graph.points[around[who, where]], targets[active[who]])
        all_sims = np.concatenate([sims[active], s], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        r = np.arange(len(active))[:, None]
        sims[active] = all_sims[r, keep]
        nodes[active] = np.concatenate([nodes[active], np.where(fresh, around, -1)], axis=1)[r, keep]
        opened[active] = np.concatenate([opened[active], ~fresh], axis=1)[r, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def choose(points: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Neighbours that point in different directions: taken in order of similarity unless an already chosen one
    is nearer to it than the node itself; free places go to the nearest left over."""
    n, width = nodes.shape
    there = points[np.maximum(nodes, 0)]
    between = there @ there.transpose(0, 2, 1)
    chosen = np.zeros((n, width), bool)
    count = np.zeros(n, int)
    for j in range(width):
        nearest = np.where(chosen, between[:, j], -np.inf).max(axis=1)
        take = (nodes[:, j] >= 0) & (count < most) & (nearest < sims[:, j])
        chosen[:, j] = take
        count += take
    rank = np.where(nodes < 0, 2, np.where(chosen, 0, 1)) * (width + 1) + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(nodes, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _connect(graph: Graph, level: int, new: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> None:
    most = graph.links[level].shape[1]
    picked = choose(graph.points, nodes, sims, most)
    graph.links[level][new] = picked
    who, where = np.nonzero(picked >= 0)
    target, source = picked[who, where], new[who]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    ends, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(ends), most + count.max() if len(ends) else most), -1, np.int64)
    wide[:, :most] = graph.links[level][ends]
    place = np.arange(len(target)) - np.repeat(first, count)
    wide[np.repeat(np.arange(len(ends)), count), most + place] = source
    wide.sort(axis=1)  # two new nodes may have chosen each other
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    near = np.where(wide < 0, -np.inf, (graph.points[np.maximum(wide, 0)] @ graph.points[ends][:, :, None])[:, :, 0])
    order = np.argsort(-near, axis=1, kind="stable")[:, :most + 32]
    wide, near = np.take_along_axis(wide, order, 1), np.take_along_axis(near, order, 1)
    full = (wide >= 0).sum(axis=1) > most
    graph.links[level][ends[~full]] = wide[~full, :most]
    if full.any():
        graph.links[level][ends[full]] = choose(graph.points, wide[full], near[full], most)


def descend(graph: Graph, targets: np.ndarray, down_to: int) -> np.ndarray:
    """The nearest node found for each target on the way down to above ``down_to``."""
    at = np.full((len(targets), 1), graph.entry, np.int64)
    for level in range(int(graph.level[graph.entry]), down_to, -1):
        at = walk(graph, level, targets, at, 4)[0][:, :1]
    return at


def build(points: np.ndarray, width: int = 64, batch: int = 256, seed: int = 1) -> Graph:
    """Insert the lifted points in batches that at most double the graph; points of a batch also see each other."""
    n = len(points)
    level = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(LINKS)).astype(int), 6)
    graph = Graph(points, level, [np.full((n, LINKS * (2 if h == 0 else 1)), -1, np.int64)
                                  for h in range(int(level.max(initial=0)) + 1)])
    done = 1
    while done < n:
        size = min(batch, done, n - done)
        new = np.arange(done, done + size)
        targets = points[new]
        among = targets @ targets.T
        np.fill_diagonal(among, -np.inf)
        top = int(graph.level[graph.entry])
        start = np.full((size, 1), graph.entry, np.int64)
        for h in range(max(top, int(level[new].max())), -1, -1):
            here = level[new] >= h
            if h <= top:
                nodes, sims = walk(graph, h, targets, start, width if here.any() else 4)
                start = np.where(nodes[:, :1] >= 0, nodes[:, :1], start)
            else:
                nodes, sims = np.full((size, 1), -1, np.int64), np.full((size, 1), -np.inf, np.float32)
            if here.any():
                mates = np.where(here[None, :], among, -np.inf)[here]
                nodes = np.concatenate([nodes[here], np.where(np.isfinite(mates), new[None, :], -1)], axis=1)
                sims = np.concatenate([sims[here], mates], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
                _connect(graph, h, new[here], np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1))
        highest = int(new[level[new].argmax()])
        if level[highest] > top:
            graph.entry = highest
        done += size
    return graph


def search(graph: Graph, targets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return walk(graph, 0, targets, descend(graph, targets, 0), width)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, width: int = 128, shard: int = SHARD,
            block: int = 4096) -> DataFrame:
    """The k nearest found of every query (vec_id, embedding), by inner product in double precision.

    A query's own vec_id is no candidate; see ``vectors.usable`` for what takes no part. Every row is
    indexed: equal vectors are one point of the graph, which carries its k + 1 smallest ids (more of them
    can't be in any result). Shards are dealt by a hash of the vector and built once; every block of queries
    then searches every shard. Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    points = (vectors.usable(rows, zero=False).withColumn("_rank", F.row_number().over(order))
              .filter(F.col("_rank") <= k + 1).groupBy("embedding")
              .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = cut(points)
    asked = cut(vectors.usable(queries, zero=False, like=points))
    shards = spread(points.count(), shard)

    def to_graph(table: pa.Table) -> pa.Table:
        x = vectors.matrix(table["embedding"])
        first = np.array([i[0] for i in table["ids"].to_pylist()])
        turn = np.argsort(first, kind="stable")  # the same graph whatever order the rows came in
        graph = build(lift(x[turn]))
        return pa.table({"shard": table["shard"].slice(0, 1), "embedding": pa.array([x[turn].tobytes()], pa.binary()),
                         "ids": pa.array([table["ids"].take(pa.array(turn)).combine_chunks().flatten().to_numpy().tobytes()], pa.binary()),
                         "n_ids": pa.array([np.array([len(table["ids"][int(t)]) for t in turn], np.int64).tobytes()], pa.binary()),
                         "level": pa.array([graph.level.astype(np.int64).tobytes()], pa.binary()),
                         "links": pa.array([[h.astype(np.int32).tobytes() for h in graph.links]], pa.list_(pa.binary())),
                         "entry": pa.array([graph.entry], pa.int64())})

    graphs = cut(points.withColumn("shard", vectors.shard_of("embedding", shards)).groupBy("shard").applyInArrow(
        to_graph, "shard int, embedding binary, ids binary, n_ids binary, level binary, links array<binary>, entry bigint"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            g = left.to_pylist()[0]
            n_ids = np.frombuffer(g["n_ids"], np.int64)
            x = np.frombuffer(g["embedding"], float).reshape(len(n_ids), -1)
            ids, first = np.frombuffer(g["ids"], np.int64), np.cumsum(n_ids) - n_ids
            graph = Graph(lift(x), np.frombuffer(g["level"], np.int64),
                          [np.frombuffer(h, np.int32).reshape(len(x), -1).astype(np.int64) for h in g["links"]], g["entry"])
            q, q_id = vectors.matrix(right["embedding"]), right["query_id"].to_numpy()
            for a in range(0, len(q), 1024):
                part, own = q[a:a + 1024], q_id[a:a + 1024]
                flat = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
                nodes = search(graph, flat, min(width, max(2, len(x))))[0][:, :2 * k + 2]
                who, where = np.nonzero(nodes >= 0)
                node = nodes[who, where]
                score = vectors.inner_products(part[who], x[node])
                who, score = np.repeat(who, n_ids[node]), np.repeat(score, n_ids[node])
                inside = np.arange(len(who)) - np.repeat(np.cumsum(n_ids[node]) - n_ids[node], n_ids[node])
                vec = ids[np.repeat(first[node], n_ids[node]) + inside]
                other = vec != own[who]
                who, score, vec = who[other], score[other], vec[other]
                turn = np.lexsort((vec, -score, who))
                who, score, vec = who[turn], score[turn], vec[turn]
                begins = np.searchsorted(who, np.arange(len(part)))
                top = np.arange(len(who)) - begins[who] < k
                out.append((own[who[top]], vec[top], score[top]))
        got = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": got[0].astype(np.int64), "vec_id": got[1].astype(np.int64), "score": got[2]})

    found = vectors.per_shard(graphs, shards, asked, asked.count(), block, find,
                              "query_id bigint, vec_id bigint, score double")
    return vectors.best(found, k)
