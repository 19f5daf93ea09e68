"""Two-run delta behaviour and scalar functions."""

import re

import pytest
from pyspark.sql import functions as F

from codelens.functions import text as tx
from codelens.operators import delta
from codelens.operators.chunking import structural_chunks
from codelens.operators.embed import hash_embed, hash_embed_long


def _files(spark, rows):
    return delta.with_hash(spark.createDataFrame(rows, "path string, content string"))


def test_two_runs(spark):
    run1 = _files(spark, [("a.py", "x\ny"), ("b.py", "one line"), ("c.py", "p\nq")])
    state0 = spark.createDataFrame([], "path string, content_hash string")
    todo = delta.changed_only(run1, state0)
    assert todo.count() == 3
    chunks1 = todo.filter(F.col("content").contains("\n")).select(F.col("path").alias("file_path"))
    state1 = delta.next_state(run1, state0, chunks1)
    assert {r.path for r in state1.collect()} == {"a.py", "c.py"}  # chunkless b.py retried
    # no change -> nothing to process except the chunkless file
    assert {r.path for r in delta.changed_only(run1, state1).collect()} == {"b.py"}
    # change a, add d, delete c
    run2 = _files(spark, [("a.py", "x\nz"), ("b.py", "one line"), ("d.py", "n\new")])
    st = {r.path: r.status for r in delta.delta_classify(run2, state1).collect()}
    assert st == {"a.py": "changed", "b.py": "new", "c.py": "deleted", "d.py": "new"}
    chunks2 = delta.changed_only(run2, state1).filter(F.col("content").contains("\n")) \
        .select(F.col("path").alias("file_path"))
    state2 = {r.path for r in delta.next_state(run2, state1, chunks2).collect()}
    assert state2 == {"a.py", "d.py"}


def test_upsert_modes(spark):
    old = spark.createDataFrame([("a:1", "a"), ("a:2", "a"), ("b:1", "b"), ("c:1", "c")], "id string, file_path string")
    new = spark.createDataFrame([("a:3", "a")], "id string, file_path string")
    gone = spark.createDataFrame([("c",)], "path string")
    assert {r.id for r in delta.upsert_chunks(old, new, gone).collect()} == {"a:3", "b:1"}
    assert delta.upsert_chunks(old, new, mode="append_only").count() == 5


@pytest.mark.parametrize("s", ["sales_invoice", "hello world_x", "they're 3rd-party", "ÉCOLE_n", "a1b2", ""])
def test_title_matches_python(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(tx.py_title("s").alias("t")).first().t
    assert got == s.title()


@pytest.mark.parametrize("s", ["SalesInvoice", "_Already_Snake", "HTTPServer", "lower", "MiddleEast"])
def test_snake_case_matches_python(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(tx.snake_case("s").alias("t")).first().t
    assert got == "".join("_" + c.lower() if c.isupper() else c for c in s).lstrip("_").lower()


def test_repo_url_and_tokenize(spark):
    urls = ["https://github.com/o/r/tree/dev/a/b/c", "https://github.com/o/r", "xhttps://github.com/o/r/tree/d/p"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.loc for r in df.select(tx.parse_repo_url("url").alias("loc")).collect()]
    assert got[0].asDict() == {"owner": "o", "repo": "r", "branch": "dev", "path": "a/b/c"}
    assert got[1] is None and got[2] is None
    text = "A  b\tc d e\x1cf\n\n g.h\u3000i\xa0j k\u200bl"
    toks = spark.createDataFrame([(text,)], "t string").select(tx.tokenize("t").alias("k")).first().k
    assert toks == text.lower().split()


def test_structural_chunks_against_python(spark):
    texts = ["a\n" + "x" * 130 + "\nb\n\n" + "y" * 121, "", "short", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted((r.id, r.seg, r.start_line, r.end_line, r.text) for r in structural_chunks(df, "id", "text").collect())
    exp = []
    for i, t in enumerate(texts):
        lines = t.split("\n")
        starts = [j for j, ln in enumerate(lines) if j == 0 or len(ln) > 120]
        for s_i, s in enumerate(starts):
            e = (starts[s_i + 1] - 1) if s_i + 1 < len(starts) else len(lines) - 1
            exp.append((i, s_i + 1, s + 1, e + 1, "\n".join(lines[s:e + 1])))
    assert got == sorted(exp)


def test_hash_embed_forms_agree(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "zz")], "id long, text string")
    arr = {r.id: r.vector for r in hash_embed(df, "id", "text", 8).collect()}
    long_ = {}
    for r in hash_embed_long(df, "id", "text", 8).collect():
        long_.setdefault(r.id, [0.0] * 8)[r.dim] = r.value
    for k in arr:
        assert arr[k] == pytest.approx(long_[k], abs=1e-6)
    assert sum(v * v for v in arr[1]) == pytest.approx(1.0, abs=1e-6)
    assert arr[2] == [0.0] * 8


def test_embed_with_model_keys_by_row(spark):
    import numpy as np
    from codelens.operators.embed import embed_with_model

    def model(texts):
        # a wrong-length result for one row must not shift the others
        return [np.full(3, len(t), dtype=np.float32) if not t.endswith("bad") else np.zeros(2) for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "abcd")], "id long, text string")
    out = {r.id: r.vector for r in embed_with_model(df, "text", model, dim=3, prefix="p: ").collect()}
    assert out[1] == [5.0, 5.0, 5.0] and out[2] is None and out[3] == [7.0, 7.0, 7.0]


def test_prefix_and_prompts(spark):
    from codelens.operators.render import build_prompts
    df = spark.createDataFrame([("show the flow",), ("",)], "q string")
    r = df.select(tx.embed_prefix("q", is_query=True).alias("a"),
                  tx.embed_prefix("q", is_query=True, legacy_prefix=True).alias("b")).first()
    assert r.a == "search_query: show the flow" and r.b == "search_document: show the flow"
    p = build_prompts(df, "Sales Invoice", query_col="q").collect()
    assert p[0].template == "process_flow" and p[1].active_query == "Overview of Sales Invoice"
    assert p[1].template == "debugging" and "Overview of Sales Invoice" in p[1].prompt
    assert tx.TEMPLATES["debugging"].format(entity_name="Sales Invoice", user_query="Overview of Sales Invoice",
                                            context_data="") == p[1].prompt
