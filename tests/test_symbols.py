"""Extractor quirks (FIXTURES.md §2, source-file cases) and the graph built
from extracted symbols."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from codelens.operators import graph
from codelens.operators import symbols as sy

A = textwrap.dedent('''\
    import toolkit

    def helper(x):
        return x

    class SalesInvoiceController(Base):
        def validate(self):
            helper(1)
            self.x.y()

        @toolkit.expose()
        def decorated(self):
            a().b()

        if True:
            def conditional(self):
                pass

        class Inner:
            def on_submit(self):
                def nested():
                    unknown_call()
                nested()

    class Other:
        def validate(self):
            helper(2)

    async def fetch():
        await helper(3)

    helper(0)
    ''')

B = textwrap.dedent('''\
    def helper():
        pass

    def caller():
        helper()
    ''')


def _files(spark):
    rows = [("pkg/a.py", A), ("pkg/b.py", B), ("pkg/bad.py", "def broken(:\n  pass\n"),
            ("pkg/empty.py", ""), ("pkg/meta.json", '{"doctype": "Sales Invoice"}')]
    return spark.createDataFrame(rows, "path string, content string")


def test_symbol_chunks_kinds_and_lines(spark):
    ex = sy.extract_symbols(_files(spark))
    ch = {(r.symbol_name, r.ordinal): r for r in sy.symbol_chunks(ex).filter("file_path = 'pkg/a.py'").collect()}
    by_name = {}
    for (n, _), r in sorted(ch.items(), key=lambda kv: kv[0][1]):
        by_name.setdefault(n, []).append(r)
    assert [r.symbol_type for r in by_name["helper"]] == ["function"]
    assert by_name["SalesInvoiceController"][0].symbol_type == "class"
    # a direct, undecorated method of a class body
    assert [r.symbol_type for r in by_name["validate"]] == ["method", "method"]
    # decorated and conditional definitions are plain functions
    assert by_name["decorated"][0].symbol_type == "function"
    assert by_name["conditional"][0].symbol_type == "function"
    assert by_name["nested"][0].symbol_type == "function"
    assert by_name["fetch"][0].symbol_type == "function"
    # decorator text is excluded; lines are 1-based inclusive
    dec = by_name["decorated"][0]
    assert dec.content.startswith("def decorated")
    assert A.splitlines()[dec.start_line - 1].strip().startswith("def decorated")
    assert dec.end_line == dec.start_line + 1
    # hooks on functions only (symbol style); same id for same-named symbols
    assert by_name["validate"][0].hook_type == "validate"
    assert by_name["on_submit"][0].hook_type == "on_submit"
    assert by_name["SalesInvoiceController"][0].hook_type is None
    assert {r.id for r in by_name["validate"]} == {"pkg/a.py:validate"}
    # pre-order: class row precedes its methods
    order = [n for (n, _o) in sorted(ch, key=lambda k: k[1])]
    assert order.index("SalesInvoiceController") < order.index("validate")


def test_raw_style_and_errors(spark):
    ex = sy.extract_symbols(_files(spark))
    raw = sy.symbol_chunks(ex, style="raw").filter("file_path = 'pkg/a.py'")
    types = {r.symbol_type for r in raw.collect()}
    assert types == {"class_definition", "function_definition"}
    errs = sy.extraction_errors(ex).collect()
    assert [e.file_path for e in errs] == ["pkg/bad.py"]
    # empty file and JSON metadata produce no chunks and no errors
    assert sy.symbol_chunks(ex).filter(F.col("file_path").isin("pkg/empty.py", "pkg/meta.json")).count() == 0


def test_graph_nodes_contains_and_calls(spark):
    ex = sy.extract_symbols(_files(spark))
    nodes, edges = sy.build_graph(ex)
    n = {r.node_id: r for r in nodes.collect()}
    assert n["pkg/a.py"].type == "file"
    assert n["pkg/a.py:SalesInvoiceController"].doctype == "Sales Invoice"
    assert n["pkg/a.py:Other"].doctype == ""
    # nested class id hangs off the file; its method uses the inner class
    assert "pkg/a.py:Inner" in n and "pkg/a.py:Inner:on_submit" in n
    # function nested in a method takes the enclosing class scope
    assert "pkg/a.py:Inner:nested" in n
    assert n["pkg/a.py:Inner:on_submit"].hook_type == "on_submit"
    assert n["pkg/a.py:helper"].parent_class == ""
    assert "pkg/bad.py" in n and "pkg/meta.json" not in n
    e = [(r.src, r.dst, r.type, r.key) for r in edges.collect()]
    contains = {(s, d) for s, d, t, _ in e if t == "CONTAINS"}
    assert ("pkg/a.py", "pkg/a.py:Inner") in contains
    assert ("pkg/a.py:Inner", "pkg/a.py:Inner:nested") in contains
    calls = [(s, d) for s, d, t, _ in e if t == "CALLS"]
    # helper resolves to the last definition in (path, ordinal) order: b.py
    assert ("pkg/a.py:SalesInvoiceController:validate", "pkg/b.py:helper") in calls
    # same method name in two classes: calls map to the first node of the file
    assert calls.count(("pkg/a.py:SalesInvoiceController:validate", "pkg/b.py:helper")) == 2
    # module-level call and unknown names are dropped; dotted call resolves by last part
    assert not any(s == "pkg/a.py" for s, _ in calls)
    assert ("pkg/a.py:Inner:on_submit", "pkg/a.py:Inner:nested") in calls
    assert ("pkg/b.py:caller", "pkg/b.py:helper") in calls
    # parallel-edge keys 0,1,... per (src, dst)
    keys = sorted(k for s, d, t, k in e if (s, d) == ("pkg/a.py:SalesInvoiceController:validate", "pkg/b.py:helper"))
    assert keys == [0, 1]


def test_byte_order_mark_and_carriage_returns(spark):
    files = spark.createDataFrame([("bom.py", "\ufeffdef a():\n    pass\n"), ("cr.py", "def b():\r    pass\rdef c():\r    b()\r"),
                                   ("crlf.py", "x = 1\r\ndef d():\r\n    pass\r\n")], "path string, content string")
    got = sy.symbol_chunks(sy.extract_symbols(files)).collect()
    assert {(r.symbol_name, r.start_line, r.content) for r in got} == {
        ("a", 1, "def a():\n    pass"), ("b", 1, "def b():\r    pass"), ("c", 3, "def c():\r    b()"),
        ("d", 2, "def d():\r\n    pass")}


def test_khop_of_many_seeds_equals_one_run_per_seed(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(60)]
    edges = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    names = sorted({x for p in pairs for x in p}) + ["alone"] + [f"only{i}" for i in range(70)]
    seeds = spark.createDataFrame([(n,) for n in names + names[:3]] + [(None,)], "node_id string")
    for direction in ("down", "up", "both"):
        near = {}
        for a, b in pairs:
            for x, y in {"down": [(a, b)], "up": [(b, a)], "both": [(a, b), (b, a)]}[direction]:
                near.setdefault(x, set()).add(y)
        want = set()
        for seed in names:
            depth, layer = {seed: 0}, {seed}
            want.add((seed, seed, 0, None))
            for d in (1, 2, 3):
                layer = {y for x in layer for y in near.get(x, ())} - set(depth)
                want |= {(seed, y, d, min(x for x in depth if depth[x] == d - 1 and y in near.get(x, ()))) for y in layer}
                depth.update(dict.fromkeys(layer, d))
        got = graph.khop_by_seed(edges, seeds, 3, direction).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert graph.khop_by_seed(edges, seeds.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        graph.khop_by_seed(edges, seeds, 2, "sideways")


def test_khop_plan_does_not_grow_with_the_seeds(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 400}") for i in range(400)], "src string, dst string")
    plans = [graph.khop_by_seed(edges, edges.select(F.col("src").alias("node_id")).limit(n), 2)
             ._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (2, 300)]
    assert plans[0] == plans[1]


def test_equal_edges_are_found_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Many edges are dealt by their ends to tasks sized by the rows, before
    any task collects distinct names; the results are the same."""
    monkeypatch.setattr(graph, "EDGE_TASK_ROWS", 50)
    rows = [(f"a{i % 7}", f"b{i % 11}" if i % 3 else "b0", "CALLS", i) for i in range(400)] + [(None, "b1", "CALLS", 400)] * 2
    edges = spark.createDataFrame(rows, "src string, dst string, type string, o long")
    dealt = graph.simple_edges(edges, rows=402)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(src") == 1 and "hashpartitioning(src" in plan and ", 9), REPARTITION_BY_NUM" in plan
    plain = graph.simple_edges(edges)
    assert sorted(dealt.collect(), key=str) == sorted(plain.collect(), key=str)
    first = lambda n: sorted(graph.simple_edges(edges, "o", rows=n).collect(), key=str)
    assert first(402) == first(None)
    seeds = spark.createDataFrame([("a1",)], "node_id string")
    for fn in (graph.khop_neighbors, graph.khop_by_seed):
        for way in ("down", "both"):
            assert sorted(fn(edges, seeds, 2, way, 402).collect(), key=str) == sorted(fn(edges, seeds, 2, way).collect(), key=str)
