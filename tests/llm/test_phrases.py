"""Operator 13 against brute force, and its automata."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from codelens.llm import phrases as ph

SF = "/root/testdata/sf0.001"


def brute(rows, top=2000, least=10):
    """Rows (lang, text) -> result tuples, with whole numbers throughout."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    candidates = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    found = {}
    for g, a in candidates.items():
        lang, w = g[0], g[1:]
        if any(100 * c >= 50 * a and len(t) > len(g) and t[0] == lang
               and any(t[i:i + len(w)] == w for i in range(1, len(t) - len(w) + 1)) for t, c in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((score, a, " ".join(w), left, right))
    out = []
    for lang, items in found.items():
        items.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, r, p, a, left, right, n[lang], s) for r, (s, a, p, left, right) in enumerate(items[:top], 1)]
    return sorted(out)


def rows_for(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "été", "x" * 40, "a b", "\x01", "q"] + [f"w{i}" for i in range(12)]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!", ";:"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "en", "en", None, "", "und", "d\ne"]), t) for t in texts] + [("en", None), ("en", ""), (None, " .\n")] * 2


def test_phrases_equal_brute_force(spark, monkeypatch):
    rows = rows_for(1)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string") \
        .selectExpr("*", "1 AS f", "'x' AS phrase", "2 AS rank")
    assert sorted(map(tuple, ph.phrases(df).collect())) == brute(rows)
    assert sorted(map(tuple, ph.phrases(df, top=3).collect())) == brute(rows, 3)
    assert ph.phrases(df.limit(0)).count() == 0


def test_texts_longer_than_a_shard_and_tiny_shards():
    """Whatever the shard size, the united automata hold the same counts."""
    rows = rows_for(2, 20)
    # one text without a separator, far longer than a shard
    rng = random.Random(3)
    rows.append(("en", " ".join(rng.choice(["a", "b", "c"]) for _ in range(500))))
    import pyarrow as pa

    def counts(shard_words):
        old, ph.SHARD_WORDS = ph.SHARD_WORDS, shard_words
        try:
            batch = pa.RecordBatch.from_pydict({"lang": ["und" if a is None else a for a, _ in rows], "text": [t for _, t in rows]})
            out = Counter()
            for b in ph._slices([1, 2, 3], 5, None)([batch]):
                for lang, data in zip(b.column("lang").to_pylist(), b.column("automaton").to_pylist()):
                    words, grams, weights = ph.united([ph.CountAutomaton.load(data)])
                    out.update({(lang, *[words[i] for i in g]): w for g, w in zip(grams.tolist(), weights.tolist())})
            return out
        finally:
            ph.SHARD_WORDS = old
    whole = counts(10 ** 6)
    assert whole == counts(7) == counts(64) and sum(whole.values()) > 1000


def test_automata_union_and_shared_states():
    rng = np.random.default_rng(4)
    words = [b"", b"a", b"\xc3\xa9", b"longer word"] + [b"w%d" % i for i in range(20)]
    words = sorted(words)
    parts, want = [], Counter()
    for _ in range(4):
        grams = np.unique(rng.integers(0, len(words), (150, 3)), axis=0)
        weights = rng.integers(1, 3, len(grams))
        parts.append(ph.CountAutomaton.load(ph.CountAutomaton.build(words, grams, weights).dump()))
        want.update({tuple(words[i] for i in g): int(w) for g, w in zip(grams, weights)})
    names, grams, weights = ph.united(parts)
    assert {tuple(names[i] for i in g): int(w) for g, w in zip(grams, weights)} == want
    assert [tuple(g) for g in grams] == sorted(tuple(g) for g in grams)
    # x and y are followed by the same words as often: one state
    grams, weights = np.array([[1, 0], [1, 2], [2, 0], [2, 2], [3, 0]]), np.array([5, 6, 5, 6, 5])
    shared = ph.CountAutomaton.build([b"p", b"x", b"y", b"z"], grams, weights)
    assert shared.state.tolist() == [0, 0, 1] and len(shared.arc_word) == 3
    again, w = shared.paths()
    assert again.tolist() == grams.tolist() and w.tolist() == weights.tolist()


def test_counts_past_64_bits(spark):
    """Scores are exact where products need more than 64 bits."""
    big = [("x", 1, "a", 4_000_000_007), ("x", 1, "b", 5_000_000_029), ("x", 2, "a b", 3_999_999_979), ("x", 0, None, 10 ** 11)]
    old = ph.count_grams
    ph.count_grams = lambda *a: spark.createDataFrame([(*r, 0) for r in big], ph._GRAM)
    try:
        r = ph.phrases(spark.createDataFrame([], "lang string, text string")).first()
    finally:
        ph.count_grams = old
    assert r.score == 1_000_000 * 3_999_999_979 ** 2 // (4_000_000_007 * 5_000_000_029) and r.n == 10 ** 11


def test_query_on_documents(spark):
    from codelens.llm.queries import QUERIES
    rows = [(d["lang"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = QUERIES["op13_phrases"](spark, SF)
    assert sorted(map(tuple, got.collect())) == brute(rows)
