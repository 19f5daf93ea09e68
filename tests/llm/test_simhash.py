"""Operator 11 against brute force."""

import random

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from codelens.llm import simhash_copies as sc
from codelens.llm.common import byte_words

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = byte_words(text)
    grams = [b" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, most=3):
    """point -> smallest point reachable, by breadth-first search."""
    points, comp = sorted(set(points)), {}
    for p in points:
        if p not in comp:
            comp[p], todo = p, [p]
            while todo:
                x = todo.pop()
                for y in points:
                    if y not in comp and (x ^ y).bit_count() <= most:
                        comp[y] = p
                        todo.append(y)
    return comp


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one two"), (905, "ONE two"), (None, "one two"),
            (906, "é　b c\x0bd"), (907, "é　b c d"), (None, "no id here at all"), (903, "another text of one id")]
    for f in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    rows.append((1, " ".join(f"w{i % 5000}" for i in range(140_000))))  # more than two pieces
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS point", "'x' AS comp", "2 AS weight")
    got = sc.near_copies(docs).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(prints)
    low = {}
    for (i, _), p in zip(rows, prints):
        low[comp[p]] = min((x for x in (low.get(comp[p]), i) if x is not None), default=None)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, f"{p:016x}", low[comp[p]]) for (i, _), p in zip(rows, prints)), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert sc.near_copies(docs.limit(0)).count() == 0


def test_points_by_levels(spark):
    """Dense groups of fingerprints that share many blocks, with small keys
    so that every level of keys is used."""
    for seed, n, spread in ((1, 400, 6), (2, 300, 9), (3, 600, 12)):
        rng = random.Random(seed)
        centre = [rng.getrandbits(64) for _ in range(3)]
        points = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for c in centre for _ in range(n)}
        signed = [p - (1 << 64) if p >> 63 else p for p in points]
        df = spark.createDataFrame([(p, 1) for p in signed], "point long, weight long")
        got = {r.id: r.comp for r in sc.hamming_components(df, 3, small=4).collect()}
        want = brute_components(points)
        classes = {}
        for p, s in zip(points, signed):
            classes.setdefault(want[p], set()).add(got.get(s, s))
        assert all(len(c) == 1 for c in classes.values())
        assert len({min(c) for c in classes.values()}) == len(classes)


def test_all_links_share_a_key(spark):
    rng = random.Random(5)
    for same in (2, 5, 13):
        pairs = []
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << x for x in rng.sample(range(64), 3))
            pairs.append(tuple(p - (1 << 64) if p >> 63 else p for p in (a, b)))
        df = spark.createDataFrame(pairs, "a long, b long")
        keys = F.arrays_overlap(sc.block_keys(F.col("a"), 3, same), sc.block_keys(F.col("b"), 3, same))
        assert df.filter(~keys).count() == 0


def test_query_on_documents(spark):
    from codelens.llm.queries import QUERIES
    docs = [(d["doc_id"], brute_fingerprint(d["text"])) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    comp = brute_components([p for _, p in docs])
    low = {}
    for i, p in docs:
        low[comp[p]] = min(i, low.get(comp[p], i))
    got = QUERIES["op11_simhash_copies"](spark, SF)
    assert {tuple(r) for r in got.collect()} == {(i, f"{p:016x}", low[comp[p]]) for i, p in docs}
