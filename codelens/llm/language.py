"""Language identification by Bayesian evidence fusion.

P(language | evidence) is proportional to the product of the text's
likelihood under byte-trigram models, the chance of the declared markup
language and of the address suffix given the language, and the prior of the
host.  Host priors are counts smoothed level by level: host, domain, suffix,
whole corpus.  All tables are grouped aggregates over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import in_arrow
from .hashing import rows_of

SLOTS = 1 << 16
# The model has one table per language: more languages than this are an error.
MAX_LANGUAGES = 256
# Trigrams of one text are not independent: as a whole they count as at most
# so many observations.
TEXT_WEIGHT = 40.0
# Pseudo-counts: of a level's parent in the host priors, of a uniform choice
# in the tables of declared languages and suffixes.
HOST_WEIGHT, TABLE_WEIGHT = 5.0, 2.0

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&[#\w]+;?", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def trigrams(text: str) -> np.ndarray:
    """Slot of every byte trigram of the lower-cased text."""
    raw = b" " + text.encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    h = (b[:-2] * 0x1F3D5B + b[1:-1]) * 0x2C9277B5 + b[2:]
    h = ((h ^ (h >> 21)) & (SLOTS - 1))
    return h[(b[1:-1] != 32)]


def _count(languages: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), SLOTS), np.int64)
        where = {x: i for i, x in enumerate(languages)}
        pending: dict = {}
        sizes: dict = {}

        def add(i):
            table[i] += np.bincount(np.concatenate(pending.pop(i)), minlength=SLOTS)
            sizes[i] = 0
        for lang, text in rows_of(batches, "lang", "text"):
            i, t = where[lang], trigrams(text)
            pending.setdefault(i, []).append(t)
            sizes[i] = sizes.get(i, 0) + len(t)
            if sizes[i] > 1 << 20:
                add(i)
        for i in list(pending):
            add(i)
        for i, name in enumerate(languages):
            at = np.flatnonzero(table[i])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[i][at])],
                    names=["lang", "slot", "n"])
    return run


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from ``(lang, text)``;
    rows with a null in either column teach nothing."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), SLOTS))
    if languages:
        counts = in_arrow(rows, _count(languages), "lang string, slot int, n long") \
            .groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        where = {x: i for i, x in enumerate(languages)}
        # languages x slots cells at most
        for r in counts.toLocalIterator():
            table[where[r["lang"]], r["slot"]] = r["n"]
    smooth = table + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def address(url) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix) of an address, None where it has none."""
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.rstrip(".").split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _evidence(held):
    """Per row the mean trigram log likelihood under every language, the
    number of trigrams, and what address and markup say."""
    names = ["source", "id", "likelihood", "n_trigrams", "declared", "host", "domain", "suffix"]
    types = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.int64()] + [pa.string()] * 4

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            rows = []
            for source, key, text, html, url, host in rows_of([batch], "source", "id", "text", "html", "url", "host"):
                declared = None
                if html is not None:
                    m = _DECLARED.search(html)
                    declared = m[1].lower() if m else None
                    text = _MARKUP.sub(" ", html)
                t = trigrams(text or "")
                scores = table[:, t].mean(axis=1).astype(float).tolist() if len(t) else [0.0] * len(table)
                where = (host, None, None) if url is None and host is not None else address(url)
                rows.append((source, key, scores, len(t), declared, *where))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names=names)
    return run


def _log_table(rows: DataFrame, column: str, n_lang: int, guess: Column) -> DataFrame:
    """(value, log P(value | language) per language) by grouped counts."""
    seen = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(
        *[F.sum((guess == i).cast("double")).alias(f"c{i}") for i in range(n_lang)])
    totals = seen.agg(F.count(F.lit(1)), *[F.sum(f"c{i}") for i in range(n_lang)]).first()
    share = [F.log((F.col(f"c{i}") + TABLE_WEIGHT) / F.lit((totals[i + 1] or 0.0) + TABLE_WEIGHT * (totals[0] + 1)))
             for i in range(n_lang)]
    return seen.select("_v", F.array(*share).alias(f"_{column}"))


def identify(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``rows``: ``source, id, text, html, url, host`` (text or html, address
    or host may be null).  Returns ``source, id, lang, confidence, text_lang,
    declared, host``, one row per input row.

    A row without any text is judged by the other evidence; a missing piece
    of evidence says nothing; equal posteriors give the first language in
    alphabetical order; without languages ``lang`` is null; rows may repeat
    and ids may be null; an empty table gives no rows."""
    out = ["source", "id", "lang", "confidence", "text_lang", "declared", "host"]
    n = len(languages)
    if not n:
        empty = F.lit(None).cast("string")
        return rows.select("source", "id", empty.alias("lang"), F.lit(None).cast("double").alias("confidence"),
                           empty.alias("text_lang"), empty.alias("declared"), empty.alias("host"))
    held = rows.sparkSession.sparkContext.broadcast(table)
    read = rows.select(*[F.col(c).cast("long" if c == "id" else "string").alias(c)
                         for c in ("source", "id", "text", "html", "url", "host")])
    seen = materialize(in_arrow(read, _evidence(held), (
        "source string, id long, likelihood array<double>, n_trigrams long, declared string, host string, "
        "domain string, suffix string")), "lang-evidence")
    best = (F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int")
    guess = F.when(F.col("n_trigrams") > 0, best)
    seen = seen.withColumn("guess", guess)
    counted = [F.sum((F.col("guess") == i).cast("double")).alias(f"c{i}") for i in range(n)]
    whole = seen.agg(*counted).first()
    total = sum(x or 0.0 for x in whole)
    root = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + n)) for x in whole])
    # host priors, level by level: (counts + weight * parent's prior) / (n + weight)
    levels = seen.filter(F.col("host").isNotNull()).groupBy("host", "domain", "suffix").agg(*counted)
    levels = materialize(levels.select("host", "domain", "suffix", F.array(*[
        F.coalesce(f"c{i}", F.lit(0.0)) for i in range(n)]).alias("c_host")), "lang-hosts")

    def level(column):
        return levels.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_{column}")).agg(
            F.array(*[F.sum(F.col("c_host")[i]) for i in range(n)]).alias(f"c_{column}"))

    def smooth(counts, parent):
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + HOST_WEIGHT * p) / (size + HOST_WEIGHT))
    none = F.array(*[F.lit(0.0)] * n)
    hosts = levels.join(level("domain"), F.col("domain") == F.col("_domain"), "left") \
        .join(level("suffix"), F.col("suffix") == F.col("_suffix"), "left")
    hosts = hosts.select(F.col("host").alias("_host"), F.col("domain").alias("_hd"), F.col("c_host"), smooth(
        F.coalesce("c_domain", none), smooth(F.coalesce("c_suffix", none), root)).alias("p_domain"))
    d = seen.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & F.col("domain").eqNullSafe(F.col("_hd")), "left")
    for column in ("declared", "suffix"):
        t = _log_table(seen, column, n, F.col("guess"))
        d = d.join(t, F.col(column) == F.col("_v"), "left").drop("_v")
    # a row's own guess does not vouch for it
    others = F.transform(F.coalesce("c_host", none), lambda c, i: F.greatest(
        F.lit(0.0), c - F.when(F.col("guess") == i, 1.0).otherwise(0.0)))
    d = d.withColumn("prior", smooth(others, F.coalesce("p_domain", root)))
    weight = F.least(F.col("n_trigrams").cast("double"), F.lit(TEXT_WEIGHT))
    score = F.transform("prior", lambda p, i: F.log(p) + F.get("likelihood", i) * weight
                        + F.coalesce(F.get("_declared", i), F.lit(0.0)) + F.coalesce(F.get("_suffix", i), F.lit(0.0)))
    d = d.withColumn("score", score).withColumn("top", F.array_max("score"))
    names = F.array(*map(F.lit, languages))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return d.withColumn("lang", F.element_at(names, F.array_position("score", F.col("top")).cast("int"))) \
        .withColumn("confidence", 1 / mass) \
        .withColumn("text_lang", F.element_at(names, F.col("guess") + 1)).select(*out)


def labelled_documents(docs: DataFrame, held_out: int | None = None) -> DataFrame:
    """The rows to train on: all labelled documents, or without one of
    ``held_out`` by hash of the id (for held-out accuracy)."""
    if held_out:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) != 0)
    return docs.select("lang", "text")


def evidence_rows(docs: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Documents (their source is the host) and pages in one table."""
    null = F.lit(None).cast("string")
    parts = []
    if docs is not None:
        parts.append(docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text"),
                                 null.alias("html"), null.alias("url"), F.col("source").cast("string").alias("host")))
    if pages is not None:
        parts.append(pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), null.alias("text"),
                                  F.col("html"), F.coalesce("url", F.lit("")).alias("url"), null.alias("host")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
