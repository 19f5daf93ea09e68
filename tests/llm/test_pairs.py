"""Operators 3, 4, 5 and 7 against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from codelens.llm import decontaminate, fuzzy_lines, parity_join, sentence_spans
from codelens.llm.common import byte_words, components
from codelens.llm.hashing import WordHasher

SF = "/root/testdata/sf0.001"


def docs_table():
    return [(d["doc_id"], d["text"], d["source"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_families(rng, n_families=12, words=60):
    """Families of texts around the threshold, equal texts, short texts."""
    rows = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one two"), (10_004, "ONE  two"), (10_005, "one two three"),
            (10_006, "a b c d a b c d a b c d"), (10_007, "a b c d a b c d a b c d a")]
    i = 0
    for f in range(n_families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 20, words, 3 * words]))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((i * 7 % 997, " ".join(t)))
            i += 1
    return rows


def brute_components(rows, k=4, percent=85):
    def grams(t):
        w = byte_words(t)
        return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    g = [(i, grams(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(g) for b, t in g[:x]
             if s and t and 100 * len(s & t) >= percent * len(s | t) and a is not None and b is not None]
    return {i: len(s) for i, s in g}, union_find([i for i, _ in g if i is not None], links)


def test_parity_join_equals_brute_force(spark):
    for seed in (1, 2):
        rows = near_families(random.Random(seed), 24)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("comp", F.lit("x"))
        size, comp = brute_components(rows)
        got = parity_join.jaccard_components(df).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.n_shingles for r in got} == size
        assert {r.doc_id: r.component_id for r in got} == comp


def test_parity_join_on_documents(spark):
    rows = [(i, t) for i, t, _ in docs_table()]
    size, comp = brute_components(rows)
    got = {r.doc_id: r for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == comp and {i: r.n_shingles for i, r in got.items()} == size


def test_parity_join_large_family_in_rounds(spark):
    """Many near copies, few of which link to the family's first text."""
    rng = random.Random(5)
    base = [f"w{j}" for j in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for j in range(i // 12):
            t[(7 * j) % 60] = f"y{j}"
        t[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(t)))
    _, comp = brute_components(rows)
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_sketch_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate([a[: max(1, int(n * .95))], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        delta = len(np.setxor1d(a, b))
        for x, y in zip(parity_join.sketches(a, 85), parity_join.sketches(b, 85)):
            if x.band == y.band:
                far = np.bitwise_count(np.frombuffer(x.compact(), np.uint8) ^ np.frombuffer(y.compact(), np.uint8)).sum()
                assert far <= delta
                if delta <= x.bound:
                    assert set(x.keys().tolist()) & set(y.keys().tolist())
        short = [np.array(parity_join.short_sketch(h)).view(np.uint64) for h in (a, b)]
        assert np.bitwise_count(short[0] ^ short[1]).sum() <= delta


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", "s"), (1, "a b c d e f", "t"), (1, "a b c d e f", "t"), (None, "a b c d e f", "u"), (5, None, None), (6, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = parity_join.distinct_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect()) == [-1, 1, 5, 6]
    empty = parity_join.jaccard_components(df.limit(0))
    assert empty.count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = union_find({x for e in links for x in e if e[0] != e[1]}, links)
    assert {r.id: r.comp for r in got.collect()} == {i: c for i, c in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 70))) + (".\nThe answer is " + word() + " " + word()) * (i % 2))
             for i in range(60)] + [(60, None), (61, ""), (62, "short one")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [(900, None), (901, ""), (None, items[3][1])], {(None, 3)}
    for d in range(120):
        if d % 3 == 0:
            i = rng.randrange(60)
            t = items[i][1].split(" ")
            if d % 2:
                t[len(t) // 2] = "changed"
            docs.append((d, f"{filler(rng.randrange(300))}, {' '.join(t).upper()}! {filler(rng.randrange(300))}"))
            if len(t) > 40 or not d % 2:
                want.add((d, i))
        elif d % 3 == 1:
            half = items[rng.randrange(60)][1].split(" ")
            docs.append((d, f"{filler(50)} {' '.join(half[:len(half) // 2])} {filler(50)}"))
        else:
            docs.append((d, filler(200)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert want <= got
    assert all(d is None or d % 3 == 0 for d, _ in got)
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, shard_chars=3000).collect()}
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs if d is not None} - {d for d, _ in got})
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 == decontaminate.leaks(df.limit(0), bench).count()
    assert decontaminate.clean_documents(df, bench.limit(0)).count() == len(docs)


def test_wand_equals_exhaustive_scores():
    rng = random.Random(6)
    vocabulary = [f"t{i}".encode() for i in range(40)]
    items = [(i, " ".join(w.decode() for w in rng.choices(vocabulary, k=rng.randint(3, 12)))) for i in range(50)]
    df = defaultdict(int)
    for _, t in items:
        for w in set(decontaminate.words_of(t)):
            df[w] += 1
    shard = decontaminate.Shard.build(items, 50, 7.5, df)
    for theta in (0.2, 0.5, 0.8):
        for _ in range(30):
            terms = sorted({shard.vocabulary[w] for w in rng.sample(vocabulary, 12) if w in shard.vocabulary})
            full = defaultdict(float)
            for t in terms:
                for i, s in shard.postings[t]:
                    full[i] += s
            want = {i for i, s in full.items() if s >= theta - 1e-9}
            assert {i for i, _ in shard.wand(terms, 0, 50, theta)} == want


def brute_lines(rows, min_words=fuzzy_lines.MIN_WORDS):
    """All pairs by edit distance alone, without fingerprints."""
    occ = defaultdict(list)
    for d, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if w := fuzzy_lines.line_words(line):
                occ[b" ".join(w).decode()].append((d is None, d, no))
    keys = list(occ)

    def within(a, b, room):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) > room:
                return False
        return row[-1] <= room
    links = []
    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            room = max(len(a), len(b)) * (100 - fuzzy_lines.EDIT_PERCENT) // 100
            if min(a.count(" "), b.count(" ")) >= min_words - 1 and within(a, b, room):
                links.append((i, j))
    group = union_find(range(len(keys)), links)
    first = {}
    for i, k in enumerate(keys):
        first[group[i]] = min(([first[group[i]]] if group[i] in first else []) + occ[k])
    return {(d, no) for i, k in enumerate(keys) for _, d, no in occ[k] if (d is None, d, no) != first[group[i]]}, len(links)


def test_fuzzy_lines(spark):
    rng = random.Random(7)
    base = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "short line\nshort line"), (None, base[0])]
    for d in range(10, 60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice(base).split(" ")
            if rng.random() < .6:
                t[rng.randrange(len(t))] += rng.choice("xyz")
            line = " ".join(t)
            lines.append(line.upper() + "!" if rng.random() < .2 else line)
        rows.append((d, "\n".join(lines + ["tail"])))
    want, n_links = brute_lines(rows)
    assert n_links > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("norm", F.lit(1)).withColumn("removed", F.lit("q"))
    got = {(r.doc_id, n) for r in fuzzy_lines.removed_lines(df).collect() for n in r.removed}
    assert got == want
    clean = {r.doc_id: r for r in fuzzy_lines.dedup_lines(df, ("a1", "a2", "a3")).collect()}
    for d, t in rows:
        if t is None:
            assert clean[d].text is None
        else:
            assert clean[d].text == "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want)
    assert fuzzy_lines.dedup_lines(df.limit(0)).count() == 0


def shares_key(a, b):
    found = []
    for words in (set(a), set(b)):
        h = WordHasher()([w.encode() for w in words])
        found.append({k for plan in fuzzy_lines.plans_of(len(h))
                      for k in fuzzy_lines.block_keys(plan, h, np.array([len(h)]))[1].tolist()})
    return bool(found[0] & found[1])


def test_near_lines_share_a_key():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 9)))
    for n in (5, 9, 10, 19, 20, 39, 40, 80, 160, 400, 3000):
        hits = {"changed": 0, "inserted": 0, "twentieth": 0, "other": 0}
        for _ in range(100):
            a = [word() for _ in range(n)]
            i = rng.randrange(n)
            hits["changed"] += shares_key(a, a[:i] + [a[i] + "x"] + a[i + 1:])
            hits["inserted"] += shares_key(a, a[:i] + [word()] + a[i:])
            some = set(rng.sample(range(n), max(1, n // 20)))
            hits["twentieth"] += shares_key(a, [w + "x" if j in some else w for j, w in enumerate(a)])
            hits["other"] += shares_key(a, [word() for _ in range(n)])
        assert min(hits["changed"], hits["inserted"], hits["twentieth"]) >= 90 and not hits["other"], (n, hits)


def brute_spans(rows, k=sentence_spans.RUN, least=sentence_spans.MIN_WORDS):
    seen = defaultdict(list)
    for d, t in rows:
        s = sentence_spans.sentences(t or "")
        for i in range(len(s) - k + 1):
            part = s[i:i + k]
            if sum(x[3] for x in part) >= least:
                seen[tuple(x[2] for x in part)].append(((d is None, d, i), (part[0][0], part[-1][1])))
    gone = defaultdict(list)
    for places in seen.values():
        first = min(p for p, _ in places)
        for p, span in places:
            if p != first:
                gone[p[1]].append(span)
    out = {}
    for d, spans in gone.items():
        merged = []
        for a, b in sorted(set(spans)):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[d] = [tuple(x) for x in merged]
    return out


def test_sentence_spans(spark):
    rng = random.Random(9)
    sentence = lambda: (" ".join("".join(rng.choices("abcdefgé", k=5)) for _ in range(rng.randint(4, 12))) + ".").capitalize()
    passages = [" ".join(sentence() for _ in range(rng.randint(5, 9))) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "One. Two. Three. One. Two. Three."), (None, passages[0])]
    for d in range(10, 50):
        parts = [sentence() for _ in range(rng.randint(2, 6))]
        if d % 2:
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((d, rng.choice([" ", "\n"]).join(parts)))
    rows.append((70, rows[5][1] + "\n" + rows[5][1]))
    want = brute_spans(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("start", F.lit("x"))
    spans = sentence_spans.repeated_spans(df)
    got = defaultdict(list)
    for r in spans.collect():
        got[r.doc_id].append((r.start, r.stop))
    assert {d: sorted(x) for d, x in got.items()} == want
    clean = {r.doc_id: r.text for r in sentence_spans.remove_spans(df, spans).collect()}
    for d, t in rows:
        at, out = 0, ""
        for a, b in want.get(d, []):
            out, at = out + t[at:a], b
        assert clean[d] == (t if t is None else out + t[at:])
    # every passage is left whole in one place
    assert all(sum(p in (x or "") for x in clean.values()) == 1 for p in passages)
    assert sentence_spans.repeated_spans(df.limit(0)).count() == 0


def test_short_runs_of_sentences(spark):
    """Passages of one and two sentences, passages cut at both ends, and whole
    texts of fewer than three sentences."""
    rng = random.Random(10)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(n))
    one, two = words(60) + ".", f"{words(52)}. {words(8)}."
    inner = f"{words(16)}. {words(18)}."
    rows = [(1, f"{words(9)}. {one} {words(7)}."), (2, f"{words(5)}.  {one}  {words(8)}."),
            (3, f"{words(6)}. {two} {words(9)}."), (4, f"{words(9)}.\n{two}\n{words(6)}."),
            (5, f"{words(4)} {(cut := words(9))}. {inner} {(rest := words(9))} {words(5)}."),
            (6, f"{words(3)} {cut}. {inner} {rest} {words(2)}."),
            (7, (bare := words(55))), (8, bare), (9, (whole := f"{words(9)}. {words(8)}.")), (10, whole),
            (11, (few := words(14))), (12, few)]
    got = {r.doc_id: (r.start, r.stop, r.first_doc_id) for r in sentence_spans.repeated_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    want = {d: (text[d].index(x), text[d].index(x) + len(x), d - 1)
            for d, x in ((2, one), (4, two), (6, inner), (8, bare), (10, whole))}
    assert got == want


def test_shortest_runs_stand_for_all_runs():
    rng = random.Random(11)
    for _ in range(300):
        n = [rng.randint(1, 20) for _ in range(rng.randint(0, 7))]
        shortest = sentence_spans.shortest_runs(n, 3, 15)
        for i in range(len(n)):
            for j in range(i, min(i + 3, len(n))):
                if sum(n[i:j + 1]) >= 15:
                    assert {x for a, b in shortest if i <= a and b <= j for x in range(a, b + 1)} == set(range(i, j + 1))


def test_leaks_of_short_and_changed_items(spark):
    """Items of fewer than five words inside longer texts, and items of 5 to
    28 words with one word changed."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=8))
    filler = lambda n: " ".join(word() for _ in range(n))
    items = [(n, filler(n)) for n in [*range(2, 5), *range(9, 29)]]
    docs, want = [], set()
    for n, text in items:
        t = text.split(" ")
        if n >= 9:
            t[n // 3] = "changed"
        docs.append((n, f"{filler(40)} {' '.join(t)} {filler(60)}"))
        want.add((n, n))
        docs.append((100 + n, f"{filler(9)} {' '.join(f'{x} {filler(2)}' for x in t)} {filler(9)}"))
    # the answer some words behind the question
    items.append((90, "\n".join((question := filler(9), answer := filler(2)))))
    docs.append((90, f"{filler(20)} {question} {filler(6)} {answer} {filler(20)}"))
    want.add((90, 90))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_edits_inside_equals_table():
    rng = random.Random(13)
    for _ in range(300):
        part, passage = rng.choices(range(6), k=rng.randint(0, 9)), rng.choices(range(6), k=rng.randint(0, 20))
        row = [0] * (len(passage) + 1)
        for i, x in enumerate(part, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(passage, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert decontaminate.edits_inside(part, passage) == min(row)


def test_lines_are_compared_in_step():
    """Many pairs at a time give what one pair at a time gives: limits above
    one word of the band, other letters than ASCII, ends and empty texts."""
    rng = random.Random(11)
    pairs, limits = [("", ""), ("", "ab"), ("abc", "")], [0, 1, 3]
    for _ in range(1500):
        letters = "abcdé" if rng.random() < .3 else "abc "
        a = "".join(rng.choices(letters, k=rng.choice([1, 20, 70, 330, 330, 700, 1500])))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 6 + 1)):
            i, change = rng.randrange(len(b) + 1), rng.choice("sid")
            b[i:i + (change != "i")] = rng.choice(letters) if change != "d" else ""
        pairs.append((a, "".join(b)) if rng.random() < .5 else ("".join(b), a))
        limits.append(max(len(a), len(b)) // 10)
    want = [fuzzy_lines.within_edits(a, b, n) for (a, b), n in zip(pairs, limits)]
    assert 300 < sum(want) < 1400
    assert fuzzy_lines.all_within_edits(pairs, limits).tolist() == want
    assert fuzzy_lines.all_within_edits([], []).tolist() == []
