"""Batch and streaming incremental indexing end to end."""

import os
import tempfile

import random

import pytest
from pyspark.sql import functions as F

from codelens.operators import search
from codelens.operators import symbols
from codelens.operators.delta import delta_classify, with_hash
from codelens.operators.graph_runs import GraphRuns
from codelens.operators.index_runs import IndexRuns
from codelens.plans.indexing import index_corpus
from codelens.schemas import FILE_STATE
from codelens.sources import bucketed
from codelens.sources import files as src
from codelens.sources import sinks
from codelens.streaming.indexing import start_index_stream

A = "class SalesInvoice:\n    def validate(self):\n        helper()\n\ndef helper():\n    pass\n"
B = "def other():\n    helper()\n"


def test_batch_index_twice(spark):
    root = tempfile.mkdtemp(prefix="codelens-idx-", dir="/tmp")
    files = spark.createDataFrame([("m/a.py", A), ("m/b.py", B), ("m/c.py", "x = 1\n")], "path string, content string")
    r1 = index_corpus(files, root, "SalesInvoice", dim=16)
    assert r1["processed_files"] == 3
    table = src.open_vector_table(spark, r1["vectors"])
    assert table.count() == 4 and all(len(v.vector) == 16 for v in table.collect())
    state = {r.path for r in src.read_state(spark, f"{root}/state").collect()}
    assert state == {"m/a.py", "m/b.py"}  # chunkless c.py is retried next run
    # second run: b.py changed, c.py deleted, a.py unchanged
    files2 = spark.createDataFrame([("m/a.py", A), ("m/b.py", B + "\ndef more():\n    other()\n")],
                                   "path string, content string")
    r2 = index_corpus(files2, root, "SalesInvoice", dim=16)
    assert r2["processed_files"] == 1
    table2 = {(r.file_path, r.symbol_name) for r in src.open_vector_table(spark, r2["vectors"]).collect()}
    assert table2 == {("m/a.py", "SalesInvoice"), ("m/a.py", "validate"), ("m/a.py", "helper"),
                      ("m/b.py", "other"), ("m/b.py", "more")}
    nodes, edges = sinks.load_graph(spark, f"{root}/graph", "SalesInvoice")
    calls = {(r.src, r.dst) for r in edges.filter("type = 'CALLS'").collect()}
    # edges re-resolved over the whole corpus, including the unchanged file
    assert ("m/a.py:SalesInvoice:validate", "m/a.py:helper") in calls
    assert ("m/b.py:more", "m/b.py:other") in calls


def test_stream_picks_up_new_files(spark):
    base = tempfile.mkdtemp(prefix="codelens-stream-", dir="/tmp")
    srcdir = f"{base}/src"
    os.makedirs(srcdir)
    with open(f"{srcdir}/a.py", "w") as f:
        f.write(A)
    q = start_index_stream(spark, srcdir, f"{base}/idx", f"{base}/ckpt", "SalesInvoice", dim=8)
    q.awaitTermination(120)
    assert {r.path for r in src.read_state(spark, f"{base}/idx/state").collect()} == {"a.py"}
    with open(f"{srcdir}/b.py", "w") as f:
        f.write(B)
    q = start_index_stream(spark, srcdir, f"{base}/idx", f"{base}/ckpt", "SalesInvoice", dim=8)
    q.awaitTermination(120)
    assert {r.path for r in src.read_state(spark, f"{base}/idx/state").collect()} == {"a.py", "b.py"}


def files_under(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_bucketed_upsert_leaves_other_buckets_alone(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="codelens-bkt-", dir="/tmp")
    schema = spark.createDataFrame([], "file_path string, n int").schema
    rows = {f"f{i}": [i, -i] for i in range(40)}

    def df(d):
        return spark.createDataFrame([(p, n) for p, ns in d.items() for n in ns], schema)

    def table():
        out = {}
        for r in bucketed.read_bucketed(spark, base, schema).collect():
            out.setdefault(r.file_path, []).append(r.n)
        return {p: sorted(ns) for p, ns in out.items()}
    assert bucketed.read_bucketed(spark, base, schema).count() == 0
    bucketed.upsert_bucketed(base, schema, df(rows), buckets=16)
    assert table() == {p: sorted(ns) for p, ns in rows.items()}
    before = files_under(f"{base}/data")
    # one file changed, one new, one gone, one kept without rows
    gone = spark.createDataFrame([("f3",), ("f7",)], "path string")
    touched = bucketed.upsert_bucketed(base, schema, df({"f1": [100], "new": [5]}), gone, buckets=16)
    want = {**{p: sorted(ns) for p, ns in rows.items() if p not in ("f3", "f7")}, "f1": [100], "new": [5]}
    assert table() == want
    written = {int(f.split("bucket=")[1].split("/")[0]) for f in files_under(f"{base}/data") - before}
    assert written <= set(touched) and len(touched) <= 4 and before <= files_under(f"{base}/data")
    # a run that dies after some of its files, before its manifest
    monkeypatch.setattr(bucketed, "_filled", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bucketed.upsert_bucketed(base, schema, df({"f1": [7], "f20": [7]}), buckets=16)
    monkeypatch.undo()
    assert table() == want
    bucketed.upsert_bucketed(base, schema, df({"f1": [8]}), buckets=16)
    assert table() == {**want, "f1": [8]}
    # a bucket that becomes empty
    every = spark.createDataFrame([(p,) for p in want], "path string")
    bucketed.upsert_bucketed(base, schema, df({"f1": [9]}), every, buckets=16)
    assert table() == {"f1": [9]}
    assert bucketed.upsert_bucketed(base, schema, df({}), buckets=16) == []


def test_bm25_index_runs_equal_a_fresh_index(spark):
    """Three runs of random changes, then a compaction: statistics and scores
    are those of an index built at once."""
    rng = random.Random(6)
    runs = IndexRuns(spark, tempfile.mkdtemp(prefix="codelens-runs-", dir="/tmp"))
    text = lambda: " ".join(f"w{min(int(rng.expovariate(0.3)), 30)}" for _ in range(rng.randint(0, 15)))
    files, state = {f"f{i}": text() for i in range(30)}, spark.createDataFrame([], FILE_STATE)
    queries = spark.createDataFrame([(0, "w0 w3 w3"), (1, "w9 w1"), (2, "w30 none")], "query_id long, query string")
    for step in range(4):
        if step:
            for p in rng.sample(sorted(files), 8):
                files[p] = text()
            for p in rng.sample(sorted(files), 4):
                del files[p]
            files.update({f"g{step}-{i}": text() for i in range(5)})
        table = spark.createDataFrame(sorted(files.items()), "path string, content string")
        # two chunks of one file
        docs = table.withColumn("id", F.concat(F.col("path"), F.lit("#0"))).unionByName(
            table.filter("path like 'f1%'").withColumn("id", F.concat(F.col("path"), F.lit("#1"))))
        current = with_hash(table).select("path", "content_hash")
        if step == 3:
            runs.compact()
        runs.update(delta_classify(current, state), docs)
        state = spark.createDataFrame(current.collect(), FILE_STATE)
        kept, fresh = runs.index(), search.BM25Index(docs)
        assert (kept.n_docs, kept.avgdl) == (fresh.n_docs, fresh.avgdl)
        df = lambda i: {r.term: r.df for r in i.terms.collect()}
        assert df(kept) == df(fresh)
        scores = lambda i: {(r.query_id, r.id): round(r.score, 9) for r in search.bm25_scores(i, queries).collect()}
        assert scores(kept) == scores(fresh)
        top = lambda i: sorted((r.query_id, r.rank, r.id) for r in search.bm25_topk(i, queries, 5, score_digits=6).collect())
        assert top(kept) == top(fresh)
    assert len(runs._paths()) == 2
    # the same run again changes nothing
    runs.update(delta_classify(current, spark.createDataFrame([], FILE_STATE)), docs)
    assert df(runs.index()) == df(fresh) and runs.index().n_docs == fresh.n_docs


def test_graph_runs_equal_a_full_build(spark):
    """Random changes of files that share names: the stored graph is the one
    that a full build gives, and untouched buckets keep their files."""
    rng = random.Random(8)
    base = tempfile.mkdtemp(prefix="codelens-graph-", dir="/tmp")
    store, names = GraphRuns(spark, base), [f"fn{i}" for i in range(12)]

    def module():
        out = []
        for name in rng.sample(names, rng.randint(0, 4)):
            calls = "".join(f"    {c}()\n" for c in rng.choices(names + ["nobody"], k=rng.randint(1, 3)))
            out.append(f"def {name}():\n{calls}" if rng.random() < 0.7 else
                       f"class C{name}:\n    def {name}(self):\n" + calls.replace("    ", "        "))
        return "\n".join(out) + "\n"
    files = {f"m/f{i}.py": module() for i in range(10)}
    changed, gone = dict(files), []
    for step in range(3):
        if step:
            changed, gone = {p: module() for p in rng.sample(sorted(files), 2)}, rng.sample(sorted(files), 1)
            changed = {p: t for p, t in changed.items() if p not in gone}
            changed[f"m/new{step}.py"] = module()
            files = {p: t for p, t in {**files, **changed}.items() if p not in gone}
        df = lambda d: spark.createDataFrame(sorted(d.items()), "path string, content string")
        before = files_under(base)
        touched = store.update(symbols.extract_symbols(df(changed)),
                               spark.createDataFrame([(p,) for p in [*changed, *gone]], "path string"))
        written = {(f.split("/")[0], int(f.split("bucket=")[1].split("/")[0])) for f in files_under(base) - before if "bucket=" in f}
        assert all(b in touched[t] for t, b in written) and before <= files_under(base)
        nodes, edges = store.graph()
        want_nodes, want_edges = symbols.build_graph(symbols.extract_symbols(df(files)))
        key = lambda r: tuple((x is None, str(x)) for x in r)
        rows = lambda t: sorted(map(tuple, t.collect()), key=key)
        assert rows(nodes.select(want_nodes.columns)) == rows(want_nodes)
        assert rows(edges) == rows(want_edges)
    # an unchanged corpus touches nothing
    assert store.update(symbols.extract_symbols(df(files).limit(0)),
                        spark.createDataFrame([], "path string"))["calls"] == []


def test_embedding_model_gets_batches_of_the_asked_size(spark):
    import numpy as np
    from codelens.operators.embed import EMBED_BATCH, embed_with_model
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "id long, text string").coalesce(1)

    def model(batch):
        # the vector tells how large the batch was; one row is bad
        return [np.array([len(batch), 0.0]) if t != "t7" else np.array([1.0]) for t in batch]
    sizes = {r.id: r.vector and int(r.vector[0]) for r in embed_with_model(texts, "text", model, 2).collect()}
    assert max(s for s in sizes.values() if s) == EMBED_BATCH == 64 and sizes[7] is None and sizes[149] == 150 - 2 * 64
    small = embed_with_model(texts, "text", model, 2, batch_size=10).collect()
    assert {int(r.vector[0]) for r in small if r.vector} == {10}
