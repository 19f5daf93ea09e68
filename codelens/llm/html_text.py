"""Main text of web pages by a tree-structured graphical model.

The variables are the block elements and the text blocks of a page's DOM tree,
each content or not.  An element's tag and names (class, id, role) and a text
block's length, links and punctuation are its evidence; parent-child
potentials carry the decision along the tree.  One sum-product pass up and one
down gives every text block's exact marginal.

Evidence and transitions are counts over pages whose author has marked the
article (``article``, ``main`` or ``articleBody``), added to a small prior for
common tags and names, so that layouts absent from the labelled pages are
judged too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .hashing import rows_of

# Bound on the labelled pages that the model is trained on.
MAX_LABELLED = 3_000
# Bound on the names (class, id, role) that it keeps.
MAX_NAMES = 5_000

# Fixed lists of the markup language: elements inside a line, elements without
# content, and elements whose content is never text of the page.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rb rp rt
ruby s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
HIDDEN = frozenset("head template select button option datalist canvas audio video map".split()) | RAW
# Start tags that leave an open head open; any other one, and text, ends it.
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
# Start tags that end an open element of the given kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
          "th": ("td", "th"), "thead": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead"),
          "tfoot": ("td", "th", "tr", "tbody")}
SCOPES = frozenset("ul ol dl table body div section article main aside nav".split())

# Elements that hold one paragraph of several.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd".split())
# Tags that the markup language itself sets apart from the main text.
APART = frozenset("nav footer header aside form menu dialog fieldset".split())
# First words of a name that says what its element has or lacks ("has-sidebar").
STATE = frozenset("has have no not non without with is hide hides show shows".split())
# Last words that only say that something is held ("comment-list").
HOLDER = frozenset("""area bar block body box button buttons card cell col column container field group holder icon icons
inner item items label left link links list module outer panel placeholder region right root row section slot text title
top unit wrap wrapper""".split())
# Prior evidence for tags and names, as log odds of content: a name weighs
# less than an article's tag, or than a name and all that children can say.
PRIOR = {
    **dict.fromkeys(("tag:article", "tag:main"), 8.0),
    **dict.fromkeys(("tag:p", "tag:h1", "tag:h2", "tag:h3", "tag:blockquote", "tag:pre"), 0.5),
    **dict.fromkeys((f"tag:{x}" for x in APART), -12.0),
    **dict.fromkeys(("name:articlebody", "name:article", "name:story", "name:post", "name:entry"), 1.5),
    **dict.fromkeys(("name:content", "name:main", "name:text", "name:body"), 1.0),
    **dict.fromkeys((f"name:{x}" for x in """ad ads advert advertisement adverts banner breadcrumb breadcrumbs captcha
comment comments consent cookie cookies disclaimer discussion donate footer form gdpr header login masthead menu modal
nav navbar navigation newsletter notice notices notification pagination paywall popup promo promotion recommended
related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags
toolbar widget widgets""".split()), -7.0),
}
PART = 0.3           # share of a word's prior where another word follows it ("share-price")
# What training can add at most: a text's looks must not outweigh its place.
LIMIT = {"tag:": 1.0, "name:": 7.0, "part:": 2.0, "text:": 1.5}
MOST_PUSH = 400.0    # bound on what all children together tell their parent
LEAST = 0.02         # odds below which an element whose names speak against it is no article
STAY = 0.97          # prior share of children that share their parent's label
STAY_COUNT = 40.0    # its weight in observations
OPEN = {"article": 0.8, "main": 0.8, "section": 0.1, "div": 0.1, "td": 0.1, "body": 0.1}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^><]*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.!?,;:…。，]")


@dataclass
class Page:
    """DOM tree in document order: a parent comes before its children.  A
    text block has ``text``, an element has ``tag`` and ``names``."""
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    text: list = field(default_factory=list)
    evidence: list[str] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: tuple = (), text=None, evidence: str = "") -> int:
        self.parent.append(parent), self.tag.append(tag), self.names.append(names)
        self.text.append(text), self.evidence.append(evidence)
        return len(self.tag) - 1


def names_of(attributes: str) -> tuple[str, ...]:
    """Evidence in the names of an element: ``name:`` with the word that a
    name is about (the last one that is no holder), ``part:`` with the words
    before it, ``name:`` with the whole of a name of a state."""
    found = set()
    for value in _NAMES.findall(attributes):
        for name in "".join(value).split():
            words = [x.lower() for x in _SPLIT.split(name) if x]
            if len(words) > 1 and words[0] in STATE:
                found.add("name:" + "-".join(words))
                continue
            while len(words) > 1 and words[-1] in HOLDER:
                words.pop()
            found.update(f"part:{x}" for x in words[:-1])
            found.update(f"name:{x}" for x in words[-1:])
    return tuple(sorted(found))


def prior_of(e: str) -> float:
    """Log odds of content before training; of a text by its length, its
    share of links and whether it has stops."""
    if e.startswith("text:"):
        n, links, stops = map(int, e.split(":")[1:])
        return -1.0 if links >= 2 else 1.0 if n >= 5 and stops else 0.0
    return PART * PRIOR.get("name:" + e[5:], 0.0) if e.startswith("part:") else PRIOR.get(e, 0.0)


def parse(html: str) -> Page:
    """Block tree of a page; any string is accepted."""
    page = Page()
    stack = [page.add(-1, "html")]
    hidden = 0
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = False

    def flush():
        nonlocal parts, link_parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not hidden:
                n = text.count(" ") + 1
                links = len(unescape(" ".join(link_parts)).split())
                share = min(3, 4 * links // n)
                stops = len(_STOPS.findall(text))
                page.add(stack[-1], "#text", (), text,
                         f"text:{min(n, 255).bit_length()}:{share}:{min(stops, 7).bit_length()}")
            parts, link_parts = [], []

    def close(depth):
        nonlocal hidden
        while len(stack) > depth:
            hidden -= page.tag[stack.pop()] in HIDDEN

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at:m.start() if m else end]
        if page.tag[stack[-1]] == "head" and text.strip("\ufeff \t\r\n\f"):
            close(len(stack) - 1)
        if text and not hidden:
            parts.append(text)
            if in_link:
                link_parts.append(text)
        if not m:
            break
        at = m.end()
        if not (name := m[2] or m[5]):
            continue
        closing, tag, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if page.tag[stack[-1]] == "head" and not closing and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in INLINE:
            in_link = (not closing) if tag == "a" else in_link
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    close(depth)
                    break
            continue
        if tag in VOID:
            continue
        if page.tag[stack[-1]] == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] in CLOSES[tag]:
                    close(depth)
                elif page.tag[stack[depth]] in SCOPES:
                    break
        if tag in RAW:
            closer = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = html.find(">", closer.start()) + 1 or end if closer else end
            continue
        if tag == "html":
            continue
        # the names of a body are about the page as a whole
        stack.append(page.add(stack[-1], tag, names_of(attributes) if tag != "body" else ()))
        hidden += tag in HIDDEN
    flush()
    return page


def marked_labels(page: Page) -> list[int] | None:
    """1 for the nodes inside the marked article, 0 for all others; None if
    the page marks none.  Inside it, elements set apart by their tag and all
    below them are 0; elements whose names speak against it take the label
    that the untrained model finds likelier, given the article."""
    label: list[int] = []
    p = None
    for i, tag in enumerate(page.tag):
        up = page.parent[i]
        if up >= 0 and label[up] < 0 or tag in APART:
            label.append(-1)
        elif up >= 0 and label[up] > 0:
            if sum(map(prior_of, page.names[i])) <= -1:
                p = p or UNTRAINED.marginals(page, label.index(1))
                label.append(1 if p[i] >= 0.5 else -1)
            else:
                label.append(1)
        else:
            label.append(int(tag in ("article", "main") or "name:articlebody" in page.names[i]))
    return [max(x, 0) for x in label] if 1 in label else None


def observations(page: Page, labels: list[int]) -> Counter:
    """Counts that the model is made of: (what, label of parent or -1, label)."""
    c: Counter = Counter()
    for i, y in enumerate(labels):
        for e in evidence(page, i):
            c[e, -1, y] += 1
        if page.parent[i] >= 0:
            c[f"under:{page.tag[i]}", labels[page.parent[i]], y] += 1
    return c


def evidence(page: Page, i: int) -> list[str]:
    if page.tag[i] == "#text":
        return [page.evidence[i]]
    return [f"tag:{page.tag[i]}", *page.names[i]]


class Model:
    """Log odds of the evidence and transition probabilities."""

    def __init__(self, counts: dict[tuple, int]) -> None:
        total = {kind: [sum(n for (w, p, y), n in counts.items() if p < 0 and y == label and w.startswith(kind))
                        for label in (0, 1)] for kind in LIMIT}
        self.odds: dict[str, float] = {}
        for w in {w for w, p, _ in counts if p < 0}:
            n0, n1 = total[w[:w.index(":") + 1]]
            c0, c1 = counts.get((w, -1, 0), 0), counts.get((w, -1, 1), 0)
            seen, most = log((c1 + 0.5) / (n1 + 1.0)) - log((c0 + 0.5) / (n0 + 1.0)), LIMIT[w[:w.index(":") + 1]]
            seen = max(-most, min(most, seen))
            # the prior counts like ten observations, unless these only confirm it
            prior = prior_of(w)
            self.odds[w] = prior if prior * seen > 0 and abs(prior) > abs(seen) else (
                (prior * 10 + seen * (c0 + c1)) / (10 + c0 + c1))
        self.turn: dict[str, tuple[float, float]] = {}
        for w in {w for w, p, _ in counts if p >= 0}:
            self.turn[w] = tuple(self._share(w[6:], p, counts.get((w, p, 1), 0),
                                             counts.get((w, p, 0), 0)) for p in (0, 1))

    @staticmethod
    def _share(tag: str, parent: int, ones: int = 0, zeros: int = 0) -> float:
        """P(content | parent's label) for a child with this tag."""
        prior = STAY if parent else OPEN.get(tag, 1 - STAY)
        return (ones + STAY_COUNT * prior) / (ones + zeros + STAY_COUNT)

    def odds_of(self, e: str) -> float:
        return self.odds[e] if e in self.odds else prior_of(e)

    def _turn(self, page: Page, i: int, own: float) -> tuple[float, float]:
        if own < -4:
            # an advert or a menu says little about what it stands in
            return 0.01, 0.1
        return self.turn.get(f"under:{page.tag[i]}") or (self._share(page.tag[i], 0), self._share(page.tag[i], 1))

    def upward(self, page: Page, content: int | None = None) -> tuple[list, list, list]:
        """Per node: odds content : not by its own evidence and all below it,
        message to its parent, transition probabilities."""
        n = len(page.tag)
        own = [sum(map(self.odds_of, evidence(page, i))) for i in range(n)]
        below = [exp(max(-60.0, min(60.0, x))) for x in own]
        if content is not None:
            below[content] = 1e30
        turns = [self._turn(page, i, x) for i, x in enumerate(own)]
        message, push = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            below[i] *= push[i]
            q0, q1 = turns[i]
            message[i] = (1 - q1 + q1 * below[i]) / (1 - q0 + q0 * below[i])
            up = page.parent[i]
            push[up] = max(1 / MOST_PUSH, min(MOST_PUSH, push[up] * message[i]))
        below[0] *= push[0]
        return below, message, turns

    def marginals(self, page: Page, content: int | None = None) -> list[float]:
        """P(content) of every node, given that node ``content`` is: messages
        from the leaves to the root, then from the root to the leaves."""
        n = len(page.tag)
        below, message, turns = self.upward(page, content)
        out = [0.0] * n
        out[0] = below[0] * 0.01 / (1 + below[0] * 0.01)
        for i in range(1, n):
            up = page.parent[i]
            # the parent without this child's own message
            odds = out[up] / max(1e-300, 1 - out[up]) / message[i]
            p1 = odds / (1 + odds)
            q0, q1 = turns[i]
            prior = p1 * q1 + (1 - p1) * q0
            odds = prior / max(1e-300, 1 - prior) * below[i]
            out[i] = odds / (1 + odds)
        return out

    def text(self, html) -> str:
        if not html:
            return ""
        page = parse(html)
        p = self.marginals(page)
        if not any(x >= 0.5 for x, t in zip(p, page.text) if t is None):
            # an unknown layout: the element that its own evidence and all
            # below it speak for most is taken as the article; if no text is
            # in it but in elements with other names, the likeliest of those
            odds, set_apart = self.upward(page)[0], [False] * len(p)
            for i, tag in enumerate(page.tag):
                set_apart[i] = tag in APART or i > 0 and set_apart[page.parent[i]]
            holders = [i for i, tag in enumerate(page.tag)
                       if not set_apart[i] and tag != "#text" and tag not in PARAGRAPH]
            for among, least in ((holders, 0.0), (holders[1:], LEAST)):
                best = max(among, key=odds.__getitem__, default=0)
                if odds[best] >= least and among:
                    p = self.marginals(page, best)
                    if any(x >= 0.5 for x, t in zip(p, page.text) if t is not None):
                        break
        return "\n\n".join(t for t, x in zip(page.text, p) if t is not None and x >= 0.5)


UNTRAINED = Model({})


def _observe(batches) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for (html,) in rows_of(batches, "html"):
        page = parse(html)
        if labels := marked_labels(page):
            total.update(observations(page, labels))
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
        names=["what", "parent", "label", "n"])


def train(pages: DataFrame, max_labelled: int = MAX_LABELLED, max_names: int = MAX_NAMES) -> Model:
    """Model from at most ``max_labelled`` pages (lowest hash of the page
    first); only counts per tag, per text class and of the ``max_names`` most
    frequent names reach the driver."""
    sample = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "html").alias("h")) \
        .filter(F.col("html").isNotNull())
    lowest = sample.select("h").orderBy("h").limit(max_labelled)
    some = sample.join(F.broadcast(lowest.distinct()), "h").select("html")
    counts = in_arrow(some, _observe, "what string, parent int, label int, n long") \
        .groupBy("what", "parent", "label").agg(F.sum("n").alias("n"))
    kept = counts.orderBy(F.col("what").rlike("^(name|part):"), F.desc("n"), "what", "parent", "label") \
        .limit(4 * max_names)
    return Model({(r["what"], r["parent"], r["label"]): r["n"] for r in kept.collect()})


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    ``text`` joins the content blocks in page order by two line feeds; null
    or empty html gives the empty text; broken markup is read as far as it
    goes; rows that repeat are extracted each; an empty table gives no rows."""
    model = train(pages) if model is None else model
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(held.value.text, batch.column(2).to_pylist()), pa.string())],
                names=["page_id", "url", "text"])
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return in_arrow(read, run, "page_id long, url string, text string") \
        .withColumn("n_chars", F.length("text").cast("long"))
