"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from conftest import SF
from timberline.llm import hnsw, langid, lengths, neardup, packing, queries, sentencepieces, substrings, token_files, tokens, topk, toxicity
from timberline.session import scratch_dir

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, label int, score string, bucket int"
#: columns that share names with what the operators add
EXTRA = (5, -1, "x", 9)
EMBEDDINGS = "vec_id bigint, embedding array<float>, shard int, rank int"


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    near = _words(1, 200).split()
    changed = near.copy()
    changed[100] = "other"
    passage = _words(2, 60)
    long = _words(3, 30_000)
    return [
        (4, " ".join(near)), (9, " ".join(changed)), (2, " ".join(near)), (7, None), (3, ""), (5, ""), (None, "id is null"),
        (11, passage + " first"), (12, "second " + passage), (13, passage), (20, long), (21, long + " end"), (30, "短い文 é ½"),
        (31, "x"), (31, "x"), (32, "!!! 12 ..."), (40, "a" * 5000), (41, "a" * 49), (42, "a" * 50), (43, _words(4, 40)), (None, passage)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, *EXTRA) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(text, end):
    return tokens.encoder().encode(text) + np.array([end], "<u4").tobytes()


def test_packing(docs, texts, nothing):
    rows = packing.pack_documents(docs, group=10).collect()
    found, expected = [], []
    bins = defaultdict(list)
    for r in rows:
        found.append((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        data = _ids(t, 0)
        expected += [(str(i), k, 2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in
                     ((a // 8192, data[a:a + 8192]) for a in range(0, len(data), 8192))]
    assert sorted(found) == sorted(expected)
    for parts in bins.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert ends[-1] <= 2048 and [o for o, _ in parts] == [0, *ends[:-1]]
    assert packing.pack_documents(nothing).count() == 0


def test_token_files(spark, docs, texts, nothing):
    path = scratch_dir(spark, "test-files")
    token_files.write(docs, path, segment=2000)
    rows = token_files.read(spark.read.parquet(path), with_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (str(i), len(_ids(t, 1)) // 4, zlib.crc32(_ids(t, 1))) for i, t in texts)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    known = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert known == sorted(known)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    empty = scratch_dir(spark, "test-files")
    token_files.write(nothing, empty)
    assert token_files.read(spark.read.parquet(empty)).count() == 0


def test_sentencepieces(docs, texts, nothing):
    sp = sentencepieces.model().sp
    encoded = sentencepieces.encode(docs, chunk=60)  # three levels of the tree for the longest text
    rows = encoded.collect()
    assert sorted((str(r.doc_id), None if r.ids is None else bytes(r.ids)) for r in rows if r.ids is not None) == sorted(
        (str(i), np.array(sp.encode(t), "<u4").tobytes()) for i, t in texts if t is not None)
    assert sum(r.ids is None for r in rows) == 1
    back = sentencepieces.decode(encoded).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(i), str(t)) for i, t in texts)
    assert sentencepieces.encode(nothing).count() == 0


def test_substrings(docs, texts, nothing):
    rows = {(str(r.doc_id), r.n_bytes): r for r in substrings.digests(docs).collect()}
    order = sorted(((float("inf") if i is None else i), (t or "").encode(), i, t) for i, t in texts if True) if False else sorted(
        ((float("inf") if i is None else i, (t or "").encode(), i) for i, t in texts), key=lambda x: (x[0], x[1]))
    first = {}
    for owner, data, _ in order:
        for k in range(len(data) - 49):
            first.setdefault(data[k:k + 50], owner)
    for owner, data, i in order:
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k:k + 50]] < owner:
                gone[k:k + 50] = b"\1" * 50
        rest = bytes(b for b, g in zip(data, gone) if not g)
        r = rows[str(i), len(data)]
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(gone), spans, hashlib.sha256(rest).hexdigest()), i
    assert substrings.digests(nothing).count() == 0
    clean = substrings.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    kept = {r.doc_id: r for r in clean.collect()}
    assert kept[4].text == "" and kept[2].text == dict(texts)[2] and kept[7].text is None and kept[13].n_chars == 0
    assert substrings.cleaned(nothing).count() == 0


def test_a_crowded_anchor_is_split(spark, monkeypatch):
    """A line among different neighbours in all documents: no shard holds all fragments over its edges."""
    line = _words(20, 12)
    rows = [(k, f"{_words(3000 + k, 12)} {line} {_words(4000 + k % 290, 12)}") for k in range(300)]
    data = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in [*rows, (None, rows[5][1] + line)]], SCHEMA)
    monkeypatch.setattr(substrings, "CROWD", 20, raising=False)
    sort, largest = substrings.sort_fragments, []

    def measured(fragments, *rest):
        for r in fragments.filter("shard >= 0").groupBy("shard").agg(F.collect_list("pieces").alias("p")).collect():
            largest.append(int(substrings._unpack([bytes(b) for b in r.p], substrings._PIECE)["size"].astype(int).sum()))
        return sort(fragments, *rest)

    monkeypatch.setattr(substrings, "sort_fragments", measured)
    found = {r.doc_id: r.n_removed for r in substrings.digests(data).collect()}
    first, want = {}, {}
    for i, t in [*rows, (None, rows[5][1] + line)]:
        gone, b = bytearray(len(t)), t.encode()
        for k in range(len(b) - 49):
            if first.setdefault(b[k:k + 50], i) != i:
                gone[k:k + 50] = b"\1" * 50
        want[i] = sum(gone)
    assert found == want
    assert max(largest) < 8000  # 300 fragments of 50 bytes and more in one shard are 15 000


def test_characters_are_not_cut(spark):
    same = "é" * 40
    rows = [(1, "aé" + same, None, None, None, *EXTRA), (2, "xé"[1:] + same + "ü", None, None, None, *EXTRA)]
    kept = {r.doc_id: r.text for r in substrings.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {1: "aé" + same, 2: "ü"}


def test_near_duplicates(docs, nothing):
    rows = neardup.classes(docs).collect()
    found = {r.doc_id: (r.class_id, r.kept) for r in rows if r.doc_id not in (None, 31)}
    assert found[2] == (2, True) and found[4] == (2, False) and found[9] == (2, False)
    assert found[20] == (20, True) and found[21] == (20, False)
    assert found[11] == found[12][:0] + (11, True)
    for i in (7, 3, 5, 30, 32, 43):
        assert found[i] == (i, True), i
    assert len(rows) == docs.count()
    kept = neardup.keep_one(docs, neardup.classes(docs))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for i in [r.doc_id for r in docs.collect()] if i is not None and i not in (4, 9, 21, 12, 13))
    assert neardup.classes(nothing).count() == 0


def test_large_group_of_near_copies_and_its_neighbours(spark):
    """A crowded bucket, more classes than leaders of the first round, and links only between non-leaders."""
    base = _words(5, 120).split()
    rows = []
    for k in range(120):
        words = base.copy()
        words[k] = f"w{k}"
        rows.append((k, " ".join(words)))
    for k in range(12):  # a chain: each is near the next only
        words = base.copy()
        words[:8 * (k + 1)] = _words(6, 96).split()[:8 * (k + 1)]
        rows.append((200 + k, " ".join(words)))
    data = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in rows], SCHEMA)
    sets = {i: set(neardup.shingles(t)[0].tolist()) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    assert {r.doc_id: r.class_id for r in neardup.classes(data).collect()} == {i: top(i) for i in sets}


@pytest.mark.parametrize("block", [512, 40, 8])
def test_group_with_similarities_around_the_bound(spark, monkeypatch, block):
    """Pairs made of a group whose rows mostly are no links grow with its rows; classes as by brute force, also in blocks."""
    rng = random.Random(9)
    base = _words(5, 120).split()
    rows = []
    for k in range(300):
        words = base.copy()
        for x in rng.sample(range(120), rng.randint(1, 5)):
            words[x] = f"v{k}x{x}"
        rows.append((k, " ".join(words)))
    data = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in rows], SCHEMA)
    sets = {i: set(neardup.shingles(t)[0].tolist()) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    assert len({top(i) for i in sets}) > 20
    made, similar = [], neardup._similar
    monkeypatch.setattr(neardup, "_similar", lambda pairs, *more: made.append(pairs.count()) or similar(pairs, *more))
    kwargs = {} if block == 512 else {"block": block}
    found = {r.doc_id: r.class_id for r in neardup.classes(data, **kwargs).collect()}
    assert {i: top(i) for i in sets} == found
    assert sum(made) < 24 * 300


def test_one_of_equal_texts_without_an_id_stays(spark):
    """Null ids with equal texts: one stays if the first of the class is among them; texts without words all stay."""
    same, other = _words(30, 40), _words(31, 40)
    rows = [(None, same)] * 5 + [(None, same.upper())] * 2 + [(None, other)] * 3 + [(8, other)] * 2 + [(None, None)] * 2 + [(None, "!")] * 2
    data = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in rows], SCHEMA).repartition(4)
    kept = neardup.keep_one(data, neardup.classes(data))
    assert kept.columns == data.columns
    left = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([(None, same), (8, other), (8, other), (None, ""), (None, ""), (None, "!"), (None, "!")], key=str)


def test_refrains_that_repeat_a_different_number_of_times(spark):
    """Equal shingle sets whose shingles occur 40 times in one text and once in the other, against brute force."""
    rows = []
    for k in range(20):
        verse, refrain = _words(700 + k, 200), _words(800 + k, 10)
        rows += [(3 * k, f"{verse} {refrain} {refrain}"), (3 * k + 1, verse + f" {refrain}" * 41), (3 * k + 2, _words(850 + k, 200))]
    data = spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in rows], SCHEMA)
    sets = {i: set(neardup.shingles(t)[0].tolist()) for i, t in rows}
    first = {a: min(b for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for a in sets}
    assert sum(a != b for a, b in first.items()) == 20
    assert {r.doc_id: r.class_id for r in neardup.classes(data).collect()} == first


def test_language(spark, docs, nothing):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(source.filter("doc_id % 4 <> 2"))
    held = langid.predict(source.filter("doc_id % 4 = 2"), model, "doc_id", "lang").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (7, 3, 32))
    assert odd[43].lang_pred in model.langs
    assert langid.train(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0
    one = langid.train(docs)  # a single language
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"en", "und"}


def test_no_language_to_learn_keeps_the_corpus(spark, docs):
    """Without any lang the stage drops only what has no letter."""
    data = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_known_languages(spark, data, SF)
    assert kept.columns == data.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in data.collect() if r.doc_id not in (3, 5, 7, 32))


def test_toxicity(spark, docs, nothing):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, _words(100 + k, 40) + (" you utter numbskull " if bad else " ") + _words(900 + k, 5), None, None, None, *EXTRA))
        labels.append((k, None, int(bad) if k % 3 else None))
    data = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (1, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(data.filter("doc_id % 5 <> 0"), marks)
    held = toxicity.predict(data.filter("doc_id % 5 = 0"), model).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) and r.predicted == (r.score >= 0.5) for r in held)
    scores = [r.score for r in toxicity.predict(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.train(nothing, marks) is None
    assert toxicity.train(data, marks.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.predict(docs, None).collect()} == {0.0}
    assert toxicity.predict(nothing, model).count() == 0


def test_token_counts(spark, docs, texts, nothing):
    sizes = sorted(len(tokens.encoder().encode(t)) // 4 for _, t in texts)
    rows = lengths.token_counts(docs).collect()
    assert sorted(r.length for r in rows) == sorted(set(sizes))
    for r in rows:
        n = r.length
        assert (r.n_docs, r.docs_upto, r.docs_above) == (sizes.count(n), sum(s <= n for s in sizes), sum(s > n for s in sizes))
        assert r.tokens_upto == sum(s for s in sizes if s <= n) and r.n_tokens == sum(sizes)
        assert r.kept_tokens == sum(min(s, n) for s in sizes) and r.lost_tokens == r.n_tokens - r.kept_tokens
        assert abs(r["quantile"] - r.docs_upto / len(sizes)) < 1e-12
    assert lengths.token_counts(nothing).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32).round(2)
    x[50:120] = x[7]  # a very common vector
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(0, rows[0][1]), (900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8),
             (905, [float("inf")] * 8), (906, [1.0, 2.0]), (None, rows[3][1])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], EMBEDDINGS), x.astype(float)


def _best(x, ids, query, k):
    scores = {i: sum(a * b for a, b in zip(x[i], x[query])) for i in ids if i != query}
    return sorted(((-s, i) for i, s in scores.items()))[:k]


def test_nearest_neighbours(spark, vectors):
    table, x = vectors
    rows = hnsw.nearest(table, table.filter("vec_id % 20 = 0"), k=10, shard=100, block=7).collect()
    asked = [i for i in range(300) if i % 20 == 0]
    assert {r.query_id for r in rows} == set(asked)
    hit = 0
    for q in asked:
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and q not in [m[1] for m in mine]
        true = _best(x, range(300), q, 10)
        hit += len({m[1] for m in mine} & {i for _, i in true})
        assert all(m[2] == sum(a * b for a, b in zip(x[m[1]], x[q])) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
    assert hit / (10 * len(asked)) >= 0.95
    few = table.filter("vec_id < 5")
    assert hnsw.nearest(few, few, k=20).groupBy("query_id").count().collect()[0]["count"] == 4
    assert hnsw.nearest(table.limit(0), table.limit(0)).count() == 0


def test_exact_top_k(spark, vectors):
    table, x = vectors
    v = np.vstack([np.floor(256 * x), np.zeros((1, 8))])
    ids = [*range(300), 902]
    rows = topk.top_k(table, table.filter("vec_id % 50 = 0"), k=5, shard=90, block=3).collect()
    for q in (0, 50, 100, 150, 200, 250):
        mine = [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])]
        score = {i: int(v[300 if i == 902 else i] @ v[q]) for i in ids if i != q}
        assert mine == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_recall_of_the_registered_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table])
    found = defaultdict(set)
    for r in queries.QUERIES["op9_nearest_neighbours"](spark, SF).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hits.append(len(found[ids[k]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name
        path = scratch_dir(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    left = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(left) < len(before)
    assert len(set(left) & toxic) < len(set(before) & toxic)
    assert all(len(r.text) <= len(before[i].text) and len(r.text) == r.n_chars for i, r in left.items())
    assert all(r.lang == before[r.doc_id].lang for r in left.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_queries_of_another_length_take_no_part(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(8)], "vec_id bigint, embedding array<double>")
    odd = spark.createDataFrame([(100, [1.0, 2.0]), (101, [2.0, 1.0]), (102, [1.0, 0.0, 0.0])],
                                "vec_id bigint, embedding array<double>")
    for search in (hnsw.nearest, topk.top_k):
        assert {r.query_id for r in search(rows, odd, k=2).collect()} == {102}
