"""SimHash classes against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from conftest import SF
from timberline.llm import components, queries, simhash
from timberline.llm.common import table


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """Smallest reachable position for every fingerprint, by comparing all pairs."""
    x = np.array(fps, np.uint64)
    label = list(range(len(x)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    return [root(i) for i in range(len(x))]


def _clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    out = []
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 300))
def test_index_finds_all_links_within_a_key(seed, n):
    rng = random.Random(seed)
    x = np.array(_clustered(rng, n), np.uint64)
    keys = np.sort(np.array([rng.randrange(3) for _ in x]))
    order = np.lexsort((simhash.gray_rank(x), keys))
    label = simhash.joined(keys[order], x[order])
    for k in set(keys.tolist()):
        at = np.flatnonzero(keys[order] == k)
        assert (label[at] - at[0]).tolist() == plain_classes(x[order][at])


def test_gray_neighbours_differ_in_one_bit():
    x = np.array([i ^ i >> 1 for i in range(5000)], np.uint64)
    assert simhash.gray_rank(x).tolist() == list(range(5000))


@pytest.mark.parametrize("group", [60, 4096])
def test_top_nodes_lose_no_link_and_stay_small(spark, group):
    rng = random.Random(group)
    few = rng.getrandbits(64)
    # a third of all lies around one value, in the same bits
    fps = sorted(set(_clustered(rng, 600) + [few ^ rng.getrandbits(9) for _ in range(300)]))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    nodes = simhash.top_nodes(frame, group).collect()
    sizes, of = {}, {}
    for r in nodes:
        assert r.pattern == r.fp & r.mask
        # a fingerprint may stand in many nodes, but once in each
        sizes[r.mask, r.pattern] = sizes.get((r.mask, r.pattern, r.part), 0) + 1
        of.setdefault(r.fp % 2 ** 64, set()).add((r.mask, r.pattern, r.part))
    assert max(sizes.values()) <= 2 * group
    assert group == 4096 or any(r.part >= 0 for r in nodes)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                assert of[a] & of[b], (a, b)


def test_odd_rows(spark):
    near = [f"word{i}" for i in range(400)]
    other = near.copy()
    other[200] = "CHANGED"
    texts = [(9, " ".join(near)), (4, " ".join(other).upper()), (7, "\t".join(near)), (None, " ".join(near)), (None, None), (3, ""), (2, " \n"),
             (8, "one two"), (8, "one two"), (None, "lonely text here"), (6, "É é\x1cb"), (5, "x" * 100_000)]
    schema = "doc_id bigint, text string, fp int, label string, n int, component_id int, _row int"
    docs = spark.createDataFrame([(i, t, 1, "l", 2, 3, 4) for i, t in texts], schema).repartition(3)
    rows = simhash.near_classes(docs).collect()
    fps = [plain_fingerprint(t) for _, t in texts]
    roots = plain_classes(fps)
    least = {r: min((i for (i, _), o in zip(texts, roots) if o == r and i is not None), default=None) for r in roots}
    expected = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(texts, fps, roots)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert sorted(map(str, map(tuple, simhash.near_classes(docs, group=2).collect()))) == sorted(map(str, expected))
    assert simhash.near_classes(docs.limit(0)).count() == 0


def test_registered_query_equals_all_pairs(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    expected = [(r.doc_id, f"{f:016x}", docs[o].doc_id) for r, f, o in zip(docs, fps, plain_classes(fps))]
    assert sorted(map(tuple, queries.op13_simhash_near_dedup(spark, SF).collect())) == expected
    assert len({c for _, _, c in expected}) < len(docs)


def test_first_round_of_components_joins_no_labels(spark, monkeypatch):
    """Links are joined with labels in later rounds only; a path, a star and a node alone come out right."""
    plans = []
    monkeypatch.setattr(components, "cut", lambda df, f=components.cut: plans.append(df._jdf.queryExecution().analyzed().toString()) or f(df))
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node bigint")
    links = [(i, i + 1) for i in range(30)] + [(40, i) for i in range(41, 59)]
    got = {r["node"]: r["label"] for r in components.components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 if i <= 30 else 40 if 40 <= i < 59 else i for i in range(60)}
    joins = [p.count("Join") for p in plans[1:]]
    assert joins[0] == 3 and set(joins[1:]) == {5}
