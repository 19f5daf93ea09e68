"""Operators 8, 9 and 10: exact parts against plain Python, the learned parts
by held-out figures."""

import html as H
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codelens.llm import context_mixing as cm
from codelens.llm import html_text, language
from codelens.llm.hashing import rows_of
from codelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def article_of(page):
    """The blocks of a test page's article, cut out by its known layout."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<b>", "").replace("</b>", "")
    blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_main_text_of_pages(spark):
    got = {r.page_id: r for r in QUERIES["op8_html_text"](spark, SF).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    assert sum(got[p["page_id"]].text == article_of(p["html"]) for p in pages) >= 0.99 * len(pages)
    assert all(r.n_chars == len(r.text) for r in got.values())


HARD = """<html><body><header class="site-header"><p>Welcome to our site, the best of all.</p></header>
<div class="cookie-notice"><p>We use cookies, please accept them all now.</p></div>
<div id="sidebar"><p>Related stories that you might like, read on.</p></div>
<main><h1>Title &amp; more</h1><div class="content"><p>First paragraph of the <i>story</i>,
  it is long enough.</p><p>Second&nbsp;one<br>with a break &#233; &lt;b&gt;.</p><ul><li>one point<li>two points</ul>
<script>var x = "<p>not text</p>";</script><style>p {}</style><!-- <p>nor this</p> --></div>
<section class="comments"><h3>Comments</h3><p>I really liked this story, thanks for it.</p></section>
<form><label>Name</label><p>Leave a reply with your name.</p></form></main>
<footer><p>Copyright, all rights reserved.</p></footer></body></html>"""


def test_layouts_that_are_not_in_the_training_pages(spark):
    rows = [(p["page_id"], p["url"], p["html"]) for p in table("pages")]
    model = html_text.train(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = ["Title & more", "First paragraph of the story, it is long enough.", "Second one with a break é <b>.",
            "one point", "two points"]
    assert model.text(HARD).split("\n\n") == want
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<div><p>a</p></nav></div><article"), (None, "u", HARD),
           (5, "u", "</p></div>plain & simple"), (5, "u", "<script>x"), (6, "u", "<article><p>" + "long " * 20000 + "</article>")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(df, model).collect()
    assert len(got) == len(odd)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None].split("\n\n") == want and by[6] == ("long " * 20000).strip()
    assert html_text.extract(df.limit(0), model).count() == 0


A = "The storm reached the coast at dawn, and the harbour was closed to all ships for most of the day."
B = "Nobody was hurt, the mayor said, but the old pier has lost its roof, and the market stays shut until Monday."
C = "Fishermen had been warned in time, and they had tied up their boats in the inner harbour the night before."
PS = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer><p>Copyright, all rights reserved.</p></footer>"
SIDE = '<div class="sidebar"><h3>More</h3><ul><li><a href=/c>Another story</a></li><li><a href=/d>One more</a></li></ul></div>'
TALK = f'<div class="comment-list"><div class="comment"><p>I was there. {C}</p></div><div class="comment"><p>So was I. {B}</p></div></div>'
LAYOUTS = {
    "article has sidebar": f'{NAV}<article class="post has-sidebar">{PS}</article>{SIDE}{FOOT}',
    "content no comments": f'{NAV}<div id="content" class="content no-comments">{PS}</div>{SIDE}{FOOT}',
    "share price": f'{NAV}<article><p>{A}</p><p class="share-price">{B}</p><p>{C}</p></article>{FOOT}',
    "neutral names": f'{NAV}<div class="x1"><div class="x2">{PS}</div></div>{SIDE}{FOOT}',
    "no names": f'<div>{NAV}</div><div><div>{PS}</div></div>{FOOT}',
    "body states": f'<body class="nav-open sidebar-visible no-ads">{NAV}<div class="entry">{PS}</div>{FOOT}</body>',
    "article named widget": f'{NAV}<article class="widget">{PS}</article>{FOOT}',
    "main named social": f'{NAV}<main id="social">{PS}</main>{SIDE}{FOOT}',
    "div named widget": f'{NAV}<div class="widget">{PS}</div>{FOOT}',
    "talk in the article": f'{NAV}<article>{PS}{TALK}</article>{FOOT}',
    "talk beside it": f'{NAV}<div class="story-text">{PS}</div>{TALK}{FOOT}',
    "share buttons": f'<article>{PS}<div class="share-buttons"><a href=/e>Tell a friend</a></div></article>{SIDE}',
    "table layout": f'<table><tr><td class="menu"><a href=/a>Home</a> <a href=/b>News</a></td><td>{PS}</td></tr></table>',
    "cookie law": f'<article><h2>x</h2>{PS}</article><div class="cookie-notice"><p>We use cookies.</p></div>'.replace("<h2>x</h2>", ""),
    "reply card": f'{NAV}<article>{PS}<section id="respond"><p>Leave a reply, please.</p></section></article>{FOOT}',
    "header photo": f'{NAV}<article><div class="header-photo"><p>{A}</p></div><p>{B}</p><p>{C}</p></article>{FOOT}',
}


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(p["page_id"], p["url"], p["html"]) for p in table("pages")]
    return html_text.train(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_names_do_not_decide_alone(trained, layout):
    for model in (trained, html_text.UNTRAINED):
        assert model.text(f"<html>{LAYOUTS[layout]}</html>") == f"{A}\n\n{B}\n\n{C}"


def test_pages_without_an_article(trained):
    for rest in (NAV + FOOT, NAV + SIDE + FOOT, NAV + '<div class="cookie-notice"><p>We use cookies.</p></div>' + FOOT,
                 '<div class="comments"><p>I was there.</p><p>So was I.</p></div>', "<form><p>Your name</p></form>"):
        assert [m.text(rest) for m in (trained, html_text.UNTRAINED)] == ["", ""], rest


def test_training_outweighs_the_prior_of_a_name():
    """Pages whose marked articles lie in paragraphs named "widget"."""
    counts = Counter()
    for i in range(200):
        page = html_text.parse(f'{NAV}<article><p>{A}</p><p class="widget">{B} {C * (i % 3)}</p></article><div class="x">y</div>')
        counts.update(html_text.observations(page, html_text.marked_labels(page)))
    assert html_text.Model(counts).odds_of("name:widget") > -1 > html_text.UNTRAINED.odds_of("name:widget")
    assert html_text.marked_labels(html_text.parse(f"<article>{PS}{TALK}</article>"))[-1] == 0


def test_marginals_equal_enumeration():
    """Messages give the same marginals as summing over all label choices."""
    model = html_text.Model({("tag:p", -1, 1): 30, ("tag:p", -1, 0): 20, ("tag:div", -1, 0): 9, ("under:p", 1, 1): 20,
                             ("under:p", 0, 0): 9, ("text:3:0:0", -1, 1): 5, ("text:3:0:0", -1, 0): 2})
    page = html_text.parse("<div><p>one two three four</p><p>five</p></div><div class=content><p>six</p></div>")
    n = len(page.tag)
    own = [sum(map(model.odds_of, html_text.evidence(page, i))) for i in range(n)]
    weight = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        p = 0.01 / 1.01 if y[0] else 1 / 1.01
        for i in range(n):
            p *= math.exp(own[i]) if y[i] else 1.0
            if i:
                q = model._turn(page, i, own[i])[y[page.parent[i]]]
                p *= q if y[i] else 1 - q
        total += p
        weight += p * np.array(y)
    assert np.allclose(model.marginals(page), weight / total, atol=1e-9)


def test_scores_of_documents(spark):
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    docs += [(90_001, None), (90_002, ""), (None, "The the"), (docs[0][0], docs[0][1]), (90_003, "zzz\x0bQQQ " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[w for w in WORD.findall((t or "").encode().lower())] + [None] for _, t in docs]
    count = Counter(w for (i, _), ws in zip(docs, tokens) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, held(i), len(ws), sum(w in count for w in ws),
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(docs, tokens))
    got = cm.score_documents(df, common_words=300).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6))
                  for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert cm.score_documents(df.limit(0)).count() == 0


def model_of(texts):
    counts = Counter()
    for t in texts:
        counts.update(t)
    code = cm.Code({**counts, cm.END: len(texts)})
    tables = [np.zeros((2 << b), np.int64) for b in cm.TABLE_BITS]
    keys = cm.events(texts)[0]
    n, path = code.decisions(keys & cm.SYMBOL)
    for table_, slot in zip(tables, cm.slots(code, keys, n, path)):
        np.add.at(table_, 2 * slot + code.bit[path], 1)
    logits = [np.clip(np.rint(np.log((t[1::2] + .3) / (t[0::2] + .3)) * 256), -4000, 4000).astype(np.int16) for t in tables]
    return code, logits


def test_probabilities_sum_to_one():
    """The model gives a distribution over the next symbol after any text."""
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abc ", k=40)) for _ in range(50)]
    code, tables = model_of(texts)
    mixer = cm.fit_mixer(code, tables, texts[:20])
    for prefix in (b"", b"ab c", b"\xff\x00zz"):
        keys, _ = cm.events([prefix])
        context = int(keys[-1]) & ~cm.SYMBOL
        every = np.array([context | s for s in range(257)], np.int64)
        scores = cm._event_scores(code, tables, mixer, np.sort(every))
        assert np.allclose(np.exp(scores.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_equal_scores_however_texts_are_grouped():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"the quick fox ", k=rng.choice([0, 1, 30, 4000]))) for _ in range(30)]
    code, tables = model_of(texts)
    mixer = cm.fit_mixer(code, tables, texts[:10])
    one = np.array([cm.score_texts(code, tables, mixer, [t])[0] for t in texts])
    assert np.allclose(one, cm.score_texts(code, tables, mixer, texts), rtol=1e-5)


def test_held_out_texts_are_predicted(spark):
    """On a corpus of this size the code alone needs more than 4 bits a byte
    and the counts bring that down; shuffled bytes gain nothing."""
    docs = [(d["doc_id"], d["text"]) for d in table("documents")]
    rng = random.Random(4)
    docs += [(100_000 + i, "".join(rng.sample(t, len(t)))) for i, t in docs[:40]]
    text = dict(docs)
    got = cm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()

    def bits(rows):
        return -sum(r.score for r in rows) / math.log10(2) / sum(len(text[r.doc_id].encode()) + 1 for r in rows)
    held = bits([r for r in got if r.held_out and r.doc_id < 100_000])
    assert held < 3.2 < 3.8 < bits([r for r in got if r.held_out and r.doc_id >= 100_000])


def test_languages(spark):
    got = QUERIES["op10_language"](spark, SF).collect()
    docs = {d["doc_id"]: d for d in table("documents")}
    pages = {p["page_id"]: p for p in table("pages")}
    assert sum(r.doc_id is not None for r in got) == len(docs) and sum(r.page_id is not None for r in got) == len(pages)
    right = [r.lang == re.search(r"/(de|en|es|fr)/", pages[r.page_id]["url"])[1] for r in got if r.page_id is not None]
    assert sum(right) >= 0.95 * len(right)


def test_languages_of_held_out_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    some = language.labelled_documents(df, held_out=5)
    assert 0.6 * df.count() < some.count() < language.labelled_documents(df).count() == df.count()
    held = {r.doc_id: r.lang for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    got = language.identify(language.evidence_rows(df), *language.train(some)).collect()
    right = [r.lang == held[r.id] for r in got if r.id in held]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)


def test_evidence_beyond_the_text(spark):
    rng = random.Random(3)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    labelled = spark.createDataFrame([("xx", say("abcd")) for _ in range(30)] + [("yy", say("wxyz")) for _ in range(30)]
                                     + [(None, "a"), ("xx", None)], "lang string, text string")
    page = lambda i, lang, text, url: (i, url, f'<html lang="{lang}"><p>{text}</p></html>')
    rows = [page(i, "xx", say("abcd"), f"http://a{i % 3}.site.xx/p") for i in range(30)]
    rows += [page(100 + i, "yy", say("wxyz"), f"http://b{i % 3}.other.yy/p") for i in range(30)]
    rows += [page(200, "xx", "", "http://new.site.xx/"), page(201, "yy", "", "http://c.unseen.yy/"), (202, None, None),
             (203, "http://b1.other.yy/x", ""), (203, "http://b1.other.yy/x", ""), (None, "::bad[", say("wxyz"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("prior", F.lit(1))
    got = language.identify(language.evidence_rows(pages=df), *language.train(labelled)).collect()
    assert len(got) == len(rows)
    by = {r.id: r.lang for r in got}
    assert all(by[i] == "xx" for i in range(30)) and all(by[100 + i] == "yy" for i in range(30))
    assert (by[200], by[201], by[203], by[None]) == ("xx", "yy", "yy", "yy")
    assert all(0 < r.confidence <= 1 for r in got)
    none = language.identify(language.evidence_rows(pages=df), *language.train(labelled.limit(0))).collect()
    assert len(none) == len(rows) and {r.lang for r in none} == {None}
    assert language.identify(language.evidence_rows(pages=df.limit(0)), *language.train(labelled)).count() == 0


def test_html_open_head_and_embedded_text():
    """A head without its end tag ends at the body, at the first element of
    the page or at its first text; formulas, drawings and objects have text."""
    model = html_text.Model({})
    story = "The first sentence of the story is here, and it is long. The second one follows at once, as it should."
    for start in ("<html><head><title>T</title><meta charset=utf-8><body><article>", "<head><title>T</title><article>",
                  "<head><style>p {}</style></head><body><article>", "<head><link rel=x><b>Bold</b><article>"):
        text = model.text(f"{start}<p>{story}</p><p>{story}</p></article>")
        assert text.endswith(f"{story}\n\n{story}") and "T" not in text.replace("The", ""), start
    text = model.text(f"<body><article><p>{story}</p><math><mi>energy</mi></math><svg><text>drawing</text></svg>"
                      f"<object>instead</object><p>{story}</p><script>no()</script><select><option>never</select></article>")
    assert [x for x in ("energy", "drawing", "instead") if x not in text] == []
    assert "never" not in text and "no()" not in text


def test_counts_hold_the_documents_that_the_mixer_is_fitted_on(spark, monkeypatch):
    """Every training document is a fit document: the model still knows what
    they say, and a held-out copy costs few bits."""
    monkeypatch.setattr(cm, "FIT_SHARE", 1)
    text = "the quick brown fox jumps over the lazy dog and runs into the dark wood"
    docs = [(i, f"{text} {i % 5}") for i in range(60)]
    got = cm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(-r.score / np.log10(2) < 0.5 * len(text) for r in held)


def test_context_counts_in_one_pass(monkeypatch):
    """The fit documents are counted apart in the same pass over the rows,
    also when repeated ids make them many."""
    rng = random.Random(5)
    rows = [(i % 40, "".join(rng.choices("abcd efg", k=300))) for i in range(200)]
    fit = frozenset(range(0, 40, 7))
    code = cm.Code(Counter(b for _, t in rows for b in t.encode()))
    monkeypatch.setattr(cm, "TABLE_BITS", (12, 13, 13, 13, 13))
    monkeypatch.setattr(cm, "_COUNTED", 5000)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    got = [np.zeros((2, 2 << b), np.int64) for b in cm.TABLE_BITS]
    parts = Counter()
    for out in cm._context_counts(code, fit)([batch.slice(0, 150), batch.slice(150)]):
        for k, block, data, is_fit in rows_of([out], "k", "block", "data", "fit"):
            counts = np.frombuffer(cm.zstandard.ZstdDecompressor().decompress(data), np.int32)
            got[k][is_fit, block * 2 * cm.BLOCK_SLOTS:][:len(counts)] += counts
            parts[k, block, is_fit] += 1
    assert max(parts.values()) > 1
    for is_fit in (0, 1):
        keys = cm.events([t.encode() for i, t in rows if (i in fit) == is_fit])[0]
        n, path = code.decisions(keys & cm.SYMBOL)
        for table_, slot in zip(got, cm.slots(code, keys, n, path)):
            want = np.bincount(2 * slot + code.bit[path], minlength=table_.shape[1])
            assert (table_[is_fit] == want).all()


def test_equal_events_of_a_batch_are_scored_once(monkeypatch):
    text = "the quick brown fox " * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3500)), "held_out": [False] * 3500, "text": [text] * 3500})
    calls = []
    monkeypatch.setattr(cm, "score_texts", lambda code, tables, mixer, texts: calls.append(len(texts)) or np.zeros(len(texts)))

    class Shared:
        value = (None, None, None, {}, 0.0)
    assert sum(b.num_rows for b in cm._score(Shared)([batch])) == 3500 and calls == [3500]
