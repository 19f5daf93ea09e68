"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq

from codelens.llm import hard_negatives as hn

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rows as (vec_id, label, vector) -> result tuples."""
    seen, use = set(), []
    for i, label, v in rows:
        if label is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        r = (i, label, tuple(math.floor(256 * x) for x in v))
        if r not in seen:
            seen.add(r)
            use.append(r)
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a in use:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in use if r is not a and len(r[2]) == len(a[2])]
        for p in sorted((s for s in scored if s[2] == a[1]), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != a[1] and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:3]
            out += [(a[0], p[1], k, s[1], p[0], s[0]) for k, s in enumerate(fit, 1)]
    return out


def result(df):
    key = lambda t: tuple((x is None, x or 0) for x in t)
    return sorted((tuple(r) for r in df.collect()), key=key), key


def test_packing_and_search_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 4)
    monkeypatch.setattr(hn, "FANOUT", 2)
    monkeypatch.setattr(hn, "SHARD_LEAVES", 3)
    monkeypatch.setattr(hn, "VISITORS", 5)
    for seed, dim in ((1, 2), (2, 7)):
        rng = random.Random(seed)
        centre = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(4)]
        rows = []
        for i in range(400):
            label = rng.choice([0, 0, 0, 1, 2, 9])
            c = centre[label % 4]
            rows.append((i, label, [round(x + rng.gauss(0, 0.2), 2) for x in c]))
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS shard", "'x' AS row")
        got, key = result(hn.hard_negatives(df))
        assert got == sorted(brute(rows), key=key) and len(got) > 20
        tree = hn.packed(hn.usable_rows(df))
        sizes = [r[0] for r in tree.groupBy("shard", "leaf").count().select("count").collect()]
        assert max(sizes) <= 4 and sum(sizes) == 400
        assert max(r[0] for r in tree.groupBy("shard").count().select("count").collect()) <= 12


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (50, None, [1.0, 1.0]), (100, 2, None), (150, 2, [1.0, None]), (200, 2, [float("nan"), 1.0]),
            (250, 2, [float("inf"), 1.0]), (300, 3, []), (1, 1, [0.9, 0.5]), (2, 1, [0.9, 0.5]), (2, 1, [0.9, 0.5]),
            (3, 2, [0.6, 0.4]), (4, 2, [0.6, 0.4]), (4, 2, [0.6, 0.4]), (5, 3, [0.5, 0.4]), (6, 3, [0.4, 0.4]), (None, 3, [0.6, 0.4]),
            (8, 1, [1.0]), (350, 0, [0.2, 0.9]), (350, 4, [0.3, 0.9]), (10, 5, [-1.0, -1.0]), (400, 5, [1.0, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got, key = result(hn.hard_negatives(df))
    assert got == sorted(brute(rows), key=key) and got
    assert hn.hard_negatives(df.limit(0)).count() == 0
    assert hn.hard_negatives(df.filter("vec_id = 0")).count() == 0


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    v, a = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (9, 6))
    least, most = hn.box_bounds(a, v.min(0)[None], v.max(0)[None])
    scores = a @ v.T
    assert (scores >= least).all() and (scores <= most).all()


def test_query_on_embeddings(spark):
    from codelens.llm.queries import QUERIES
    rows = [(r["vec_id"], r["label"], [float(np.float32(x)) for x in r["embedding"]])
            for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got, key = result(QUERIES["op12_hard_negatives"](spark, SF))
    assert got == sorted(brute(rows), key=key)
