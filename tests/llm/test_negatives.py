"""Packed products and hard negatives against plain Python integers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from compare import compare, connect
from conftest import SF
from timberline.llm import negatives, queries

SCHEMA = "vec_id bigint, label int, embedding array<float>, shard int, members string, rank int, _block int, anchor_id int"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.sampled_from([1, 300, 2 ** 20, 2 ** 40, 2 ** 70]), st.integers(0, 10 ** 9))
def test_packed_products_are_exact(d, n, size, seed):
    rng = random.Random(seed)
    rows = [[rng.randint(-size, size) for _ in range(d)] for _ in range(n)]
    anchor = [rng.randint(-size, size) for _ in range(d)]
    for a in (anchor, [0] * d, [size] * d, [-size] * d):
        packed = negatives.Packed(np.array(rows, object), d * size)
        assert [int(s) for s in packed.scores(a)] == [sum(x * y for x, y in zip(a, r)) for r in rows]


def test_floors_of_components():
    column = pa.array([[-0.001, 0.5, 1.0], [1e30, -1e30, 0.0]], pa.list_(pa.float64()))
    assert negatives.integers(column, 256).tolist() == [[-1, 128, 256], [int(256e30), int(-256e30), 0]]


def plain(rows, anchors, positives=5, negatives_=10):
    """Every anchor against all rows, one pair after the other."""
    lengths = [len(v) for v in rows.values() for v in [v[1]]]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    vectors = {i: (label, [int(np.floor(256 * float(x))) for x in v]) for i, (label, v) in rows.items() if len(v) == d}
    out = []
    for a in anchors:
        if a not in vectors:
            continue
        score = {i: sum(x * y for x, y in zip(v, vectors[a][1])) for i, (_, v) in vectors.items()}
        turn = sorted((i for i in vectors if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in turn if vectors[i][0] == vectors[a][0]][:positives]:
            band = [i for i in turn if vectors[i][0] != vectors[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(band[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(negatives.SHARD, 65_536), (17, 3)])
def test_odd_rows(spark, shard, block):
    rng = random.Random(6)
    good = {i: (i % 3, [round(rng.uniform(-0.2, 0.9), 2) for _ in range(4)]) for i in range(120)}
    for i in range(100, 110):
        good[i] = (2, [0.5, 0.5, 0.5, 0.5])  # ties
    good[115] = (1, [0.0] * 4)
    rows = [(i, label, v) for i, (label, v) in good.items()]
    rows += [(7, *good[7]), (100, *good[100])]  # repeated
    rows += [(8, 9, good[8][1])]  # one id, a larger label: the smallest takes part
    rows += [(200, None, good[1][1]), (201, 1, None), (202, 1, []), (203, 1, [0.1, None, 0.1, 0.1]), (204, 1, [float("nan"), 0.1, 0.1, 0.1]),
             (205, 1, [float("inf"), 0.1, 0.1, 0.1]), (206, 1, [0.1, 0.2]), (None, 1, [0.9] * 4)]
    frame = spark.createDataFrame([(*r, 1, "m", 2, 3, 4) for r in rows], SCHEMA).repartition(4)
    anchors = frame.filter("vec_id % 5 = 0")
    got = sorted(tuple(r) for r in negatives.mine(frame, anchors, shard=shard, block=block).collect())
    as_floats = {i: (label, np.array(v, np.float32).astype(float).tolist()) for i, (label, v) in good.items()}
    assert got == plain(as_floats, [i for i in good if i % 5 == 0])
    assert negatives.mine(frame.limit(0), frame.limit(0)).count() == 0


def test_huge_components_saturate(spark):
    big = [(1, 0, [1e30, 1.0]), (2, 0, [1e30, 2.0]), (3, 1, [5e29, 0.0]), (4, 1, [0.0, 1.0])]
    frame = spark.createDataFrame(big, "vec_id bigint, label int, embedding array<double>")
    rows = negatives.mine(frame, frame.filter("vec_id = 1")).collect()
    assert {(r.positive_id, r.positive_score) for r in rows} <= {(2, negatives.LARGEST)}


def test_registered_query_equals_sql(spark):
    assert compare(spark, connect(SF), queries.op11_hard_negatives, queries.ORACLES["op11_hard_negatives"], SF) == []
