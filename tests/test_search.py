"""BM25, RRF and kNN against plain-Python references on small random corpora."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.operators import search
from codelens.operators.ranking import global_position, position_within

K1, B, EPS = 1.5, 0.75, 0.25


def py_bm25(corpus, query):
    """Plain BM25-Okapi over token lists (public algorithm)."""
    n = len(corpus)
    avgdl = sum(len(d) for d in corpus) / n
    df = {}
    for d in corpus:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: (EPS * mean if v < 0 else v) for t, v in idf.items()}
    scores = []
    for d in corpus:
        s = 0.0
        for q in query:
            tf = d.count(q)
            s += idf.get(q, 0) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / avgdl)))
        scores.append(s)
    return scores


def _corpus(seed, n_docs, vocab, max_len):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, max_len))) for _ in range(n_docs)]


@pytest.mark.parametrize("seed,n_docs,vocab,max_len", [(1, 30, 12, 15), (2, 6, 3, 8), (3, 25, 200, 5)])
def test_bm25_scores_and_topn(spark, seed, n_docs, vocab, max_len):
    texts = _corpus(seed, n_docs, vocab, max_len)
    queries = ["w1 w2 w2", "", "unknown w0", "w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    qdf = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    idx = search.BM25Index(docs)
    got = {(r.query_id, r.id): r.score for r in search.bm25_scores(idx, qdf).collect()}
    toks = [t.lower().split() for t in texts]
    n = 16
    top = {}
    for r in search.bm25_topk(idx, qdf, n, score_digits=9).collect():
        top.setdefault(r.query_id, []).append((r.rank, r.id))
    for qi, q in enumerate(queries):
        ref = py_bm25(toks, q.lower().split())
        for di, s in enumerate(ref):
            if (qi, di) in got:
                assert got[(qi, di)] == pytest.approx(s, abs=1e-9)
            else:
                assert s == 0 or not any(t in toks[di] for t in q.split())
        order = sorted(range(len(texts)), key=lambda d: (-round(ref[d], 9), d))[:n]
        assert [d for _, d in sorted(top.get(qi, []))] == order


def py_rrf(lists, limit, k=60):
    scores, first = {}, {}
    for li, lst in enumerate(lists):
        for rank, item in enumerate(lst):
            scores[item] = scores.get(item, 0) + 1.0 / (k + rank + 1)
            first.setdefault(item, (li, rank))
    return sorted(scores, key=lambda x: (-scores[x], first[x]))[:limit]


def test_rrf_matches_reference_order(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for q in range(20):
        dense = rnd.sample(range(30), 16)
        sparse = rnd.sample(range(30), 16)
        expect[q] = py_rrf([dense, sparse], 8)
        rows += [(q, d, r + 1, 0) for r, d in enumerate(dense)] + [(q, d, r + 1, 1) for r, d in enumerate(sparse)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, list int")
    fused = search.rrf_fuse([df.filter("list = 0"), df.filter("list = 1")], 8)
    got = {}
    for r in fused.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in expect:
        assert [i for _, i in sorted(got[q])] == expect[q]


def test_knn_exact_with_ties_and_self_exclusion(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    vecs[10] = vecs[11]  # exact duplicate: tie broken by id
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vector array<float>")
    queries = corpus.withColumnRenamed("id", "query_id")
    # one block pair / many blocks and tiles
    for excl, block, tile in ((False, None, None), (True, None, None), (False, 1024, 512), (True, 1024, 512)):
        if block:
            monkeypatch.setattr(search, "KNN_BLOCK_BYTES", block)
            monkeypatch.setattr(search, "_TILE_BYTES", tile)
        rows_ = search.knn_topk(queries, corpus, 5, exclude_self=excl).collect()
        got = {}
        for r in rows_:
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        v64 = vecs.astype(np.float64)
        for q in range(60):
            d = ((v64 - v64[q]) ** 2).sum(axis=1)
            order = sorted((i for i in range(60) if not (excl and i == q)), key=lambda i: (d[i], i))[:5]
            assert [i for _, i in sorted(got[q])] == order


def test_knn_corpus_smaller_than_k_and_bad_vectors(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 0.0])],
                                   "id long, vector array<float>")
    q = spark.createDataFrame([(9, [0.1, 0.1])], "query_id long, vector array<float>")
    got = [(r.rank, r.id) for r in search.knn_topk(q, corpus, 16).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_positions_with_hot_group(spark):
    rows = [(0 if i % 3 else i % 7, i) for i in range(3000)]  # group 0 holds two thirds
    df = spark.createDataFrame(rows, "g long, o long")
    for hot_min in (1 << 20, 10):  # all groups ordinary / group 0 hot
        got = {(r.g, r.o): r.pos for r in
               position_within(df, ["g"], [F.col("o")], num_partitions=6, hot_min_rows=hot_min).collect()}
        assert len(got) == len(rows)
        for g in {g for g, _ in rows}:
            os_ = sorted(o for gg, o in rows if gg == g)
            assert [got[(g, o)] for o in os_] == list(range(len(os_)))
    gp = {r.o: r.pos for r in global_position(df, [F.col("o")], num_partitions=5).collect()}
    assert [gp[o] for o in range(3000)] == list(range(3000))


def test_bm25_index_save_and_load(spark):
    import tempfile
    texts = _corpus(5, 20, 10, 12) + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    q = spark.createDataFrame([(0, "w1 w3")], "query_id long, query string")
    idx = search.BM25Index(docs)
    path = tempfile.mkdtemp(prefix="codelens-bm25-", dir="/tmp") + "/index"
    idx.save(path)
    back = search.BM25Index.load(spark, path)
    assert (back.n_docs, back.avgdl, back.mean_idf) == (idx.n_docs, idx.avgdl, idx.mean_idf) and idx.n_docs == 21
    a = {(r.query_id, r.id): r.score for r in search.bm25_topk(idx, q, 25).collect()}
    b = {(r.query_id, r.id): r.score for r in search.bm25_topk(back, q, 25).collect()}
    assert a == b and len(a) == 21


def test_knn_ignores_vectors_of_another_length(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0]), (4, None), (5, [float("nan"), 0.0])],
                                   "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0])], "query_id long, vector array<double>")
    got = [(r.query_id, r.id, r.rank) for r in search.knn_topk(queries, corpus, 5).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 3, 2)]


def test_knn_tiles_at_dim_768(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(1000, 768)), rng.normal(size=(300, 768))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in search.knn_topk(queries, corpus, 3).collect()}
    d = ((q[:, None, :100] - c[None, :, :100]) ** 2).sum(2) + sum(
        ((q[:, None, a:a + 167] - c[None, :, a:a + 167]) ** 2).sum(2) for a in range(100, 768, 167))
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got == {(i, j + 1): int(want[i, j]) for i in range(1000) for j in range(3)}


def test_hybrid_search_with_repeated_ids(spark):
    corpus = spark.createDataFrame(
        [("a.py:m", 0, "alpha beta", [1.0, 0.0]), ("a.py:m", 1, "gamma delta", [0.0, 1.0]),
         ("b.py:n", 0, "beta epsilon", None)], "id string, ordinal int, content string, vector array<double>")
    queries = spark.createDataFrame([(1, "gamma", [0.0, 1.0])], "query_id long, query string, vector array<double>")
    got = search.hybrid_search(corpus, queries, 2).orderBy("rank").collect()
    assert [(r.id, r.ordinal, r.rank) for r in got][0] == ("a.py:m", 1, 1)
    assert len({(r.id, r.ordinal) for r in got}) == len(got) == 2
    assert abs(got[0].score - 2 / 61) < 1e-9


def test_knn_cells_skip_most_distances(spark, monkeypatch):
    """Clustered vectors: the result is exact, few (query, row) pairs are
    compared; one cell is hot, and vectors repeat."""
    monkeypatch.setattr(search, "KNN_DIRECT_PAIRS", 0)
    monkeypatch.setattr(search, "KNN_BLOCK_BYTES", 8 * 6 * 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 20
    own = np.where(rng.random(3000) < 0.3, 0, rng.integers(0, 40, 3000))
    vecs = np.round(centres[own] + rng.normal(size=(3000, 6)), 3)
    vecs[10:20] = vecs[9]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vector array<double>")
    queries = corpus.filter("id % 7 = 2").withColumnRenamed("id", "query_id")
    for excl in (False, True):
        got = {}
        for r in search.knn_topk(queries, corpus, 5, exclude_self=excl).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.id
        for q in range(2, 3000, 7):
            d = ((vecs - vecs[q]) ** 2).sum(axis=1)
            want = sorted((i for i in range(3000) if not (excl and i == q)), key=lambda i: (d[i], i))[:5]
            assert [got[q][j] for j in range(1, 6)] == want
    cells = search.Cells(corpus.select(F.col("id").alias("_cid"), F.col("vector").alias("_cv")), 3000, 6)
    q = queries.select(F.col("query_id").alias("_qid"), F.col("vector").alias("_qv"))
    size = {r["cell"]: r["n"] for r in cells.summary}
    bound = spark.createDataFrame([(int(i), float(np.sort(((vecs - vecs[i]) ** 2).sum(1))[4] ** 0.5)) for i in range(2, 3000, 7)],
                                  "_qid long, bound double")
    compared = sum(size[r.cell] for p in (cells.pairs(q, 5, False), cells.pairs(q, 5, False, bound)) for r in p.collect())
    assert compared < 0.35 * 3000 * q.count()


def test_knn_cells_on_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "KNN_DIRECT_PAIRS", 0)
    inf = float("inf")
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 0.0]), (5, [inf, 0.0]),
                                    (6, [1.0]), (7, [3.0, 3.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(9, [0.1, 0.1]), (10, [inf, 0.0]), (11, None)], "query_id long, vector array<float>")
    got = [(r.query_id, r.rank, r.id) for r in search.knn_topk(q, corpus, 16).orderBy("query_id", "rank").collect()]
    assert got == [(9, 1, 1), (9, 2, 2), (9, 3, 7)]
    only = corpus.filter("id = 5")
    assert search.knn_topk(q, only, 2).count() == 0


def test_knn_without_clusters_sends_a_query_once_per_shard(spark, monkeypatch):
    """Vectors without clusters, far from the origin, where no cell can be
    ruled out: the rows that are written for the tasks grow with the queries,
    not with queries times cells, and the result is exact."""
    monkeypatch.setattr(search, "KNN_DIRECT_PAIRS", 0)
    rng = np.random.default_rng(8)
    vecs = np.round(rng.normal(size=(1200, 24)) + 1e5, 4)
    vecs[100:140] = vecs[99]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vector array<double>")
    queries = corpus.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    written, write = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.setdefault(label, []).append(write(df, label)) or written[label][-1])
    for excl in (False, True):
        written.clear()
        got = {}
        for r in search.knn_topk(queries, corpus, 5, exclude_self=excl).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.id
        for q in range(0, 1200, 3):
            d = ((vecs - vecs[q]) ** 2).sum(axis=1)
            want = sorted((i for i in range(1200) if not (excl and i == q)), key=lambda i: (d[i], i))[:5]
            assert [got[q][j] for j in range(1, 6)] == want
        assert sum(df.count() for label in ("knn-pairs", "knn-bounds") for df in written.get(label, [])) <= 6 * 400
    cells = search.Cells(corpus.select(F.col("id").alias("_cid"), F.col("vector").alias("_cv")), 1200, 24)
    shards, n = cells._shards(300), [r["n"] for r in cells.summary]
    assert sorted(at for s in shards for at in s) == list(range(len(n)))
    assert all(sum(n[at] for at in s) <= 300 for s in shards) and len(shards) <= 10


def test_bm25_shuffles_texts_and_matched_postings_only(spark, monkeypatch):
    """Neither one row per posting nor one per (query, document) is shuffled:
    texts meet by id before they are cut, matched postings by document or
    block before they meet the queries.  Rows of a repeated id add up."""
    monkeypatch.setattr(search, "BM25_BOUND_POSTINGS", 0)
    monkeypatch.setattr(search, "BM25_TASK_POSTINGS", 500)
    plans, write = {}, search.materialize

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)
    monkeypatch.setattr(search, "materialize", kept)
    texts = _corpus(4, 300, 40, 20)
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "id long, content string")
    index = search.BM25Index(docs)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w3 w9")], "query_id long, query string")
    hashed = lambda plan: plan.count("Exchange hashpartitioning(")
    assert hashed(plans["postings"]) == 1
    scores = search.bm25_scores(index, queries)
    bounded = search.bounded_scores(index, queries, 5)[0]
    for plan in (plans["open-blocks"], *(x._jdf.queryExecution().executedPlan().toString() for x in (scores, bounded))):
        assert hashed(plan) > 0 and "hashpartitioning(query_id" not in plan
    twice = index.postings.filter("id = 7").agg(F.sum("tf")).first()[0]
    assert twice == 2 * len(texts[7].split())


def test_bm25_topk_by_bounds(spark, monkeypatch):
    """The same lists as scoring every pair, from far fewer joined rows."""
    monkeypatch.setattr(search, "BM25_BOUND_POSTINGS", 0)
    monkeypatch.setattr(search, "BM25_BLOCK_DOCS", 8)
    rnd = random.Random(11)
    words, weights = [f"w{i}" for i in range(600)], [1 / (i + 1) for i in range(600)]
    texts = [" ".join(rnd.choices(words, weights, k=rnd.randint(0, 60))) for _ in range(1500)] + ["", "w1"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    qs = [(i, " ".join([f"w{rnd.randrange(200, 600)}", *rnd.choices(words, weights, k=4)])) for i in range(25)]
    qs += [(100, ""), (101, "unknown"), (102, "w0 w0 w1"), (103, None)]
    queries = spark.createDataFrame(qs, "query_id long, query string")
    index = search.BM25Index(docs)
    for digits in (None, 3):
        every = search.bm25_scores(index, queries)
        if digits:
            every = every.withColumn("score", F.round("score", digits))
        scores = {}
        for r in every.collect():
            scores.setdefault(r.query_id, {})[r.id] = r.score
        got = {}
        for r in search.bm25_topk(index, queries, 10, score_digits=digits).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
        for q, _ in qs:
            s = scores.get(q, {})
            order = sorted(range(len(texts)), key=lambda d: (-round(s.get(d, 0.0), 9), d))[:10]
            assert [got[q][i][0] for i in range(1, 11)] == order
            assert all(abs(got[q][i + 1][1] - s.get(d, 0.0)) < 1e-9 for i, d in enumerate(order))
    before = search.query_terms(queries).join(index.postings, "term").count()
    scored, blocks = search.bounded_scores(index, queries, 10)
    rows = index.blocks()[0]
    after = blocks.join(search.query_terms(queries), "query_id").join(rows, ["term", "block"]).count()
    assert after < 0.5 * before
