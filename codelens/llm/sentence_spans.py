"""Substring deduplication by sliding sentence spans.

Every run of one to three consecutive sentences with enough words is looked
for; a run found at more than one place stays at its first place, and at every
other place the sentences that it covers go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, in_arrow
from .hashing import rows_of

RUN = 3
MIN_WORDS = 15

# A sentence ends behind its closing marks or with its line.
_END = re.compile(r"[.!?…。！？]+(?=\s|$)|\n")


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, lower-case words joined by one blank, number of words) of
    every sentence with a word; offsets in code points."""
    out, at = [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        raw = text[at:end]
        words = raw.lower().split()
        if words:
            lead = len(raw) - len(raw.lstrip())
            out.append((at + lead, at + len(raw.rstrip()), " ".join(words).encode("utf-8", "surrogatepass"), len(words)))
        at = end
    return out


def shortest_runs(words: list[int], run: int, min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest run with ``min_words`` words from every
    sentence on and up to every sentence, of at most ``run`` sentences.

    They stand for all runs of 1 to ``run`` sentences with that many words:
    each sentence of such a run lies in one of the shortest runs inside it,
    and these are repeated wherever the longer run is."""
    found = set()
    for step in (1, -1):
        for i in range(len(words)):
            n, j = 0, i
            while 0 <= j < len(words) and abs(j - i) < run:
                n += words[j]
                if n >= min_words:
                    found.add((min(i, j), max(i, j)))
                    break
                j += step
    return sorted(found)


def _runs(run: int, min_words: int, flush: int = 1 << 15):
    """One row per run: 128-bit hash, document, numbers of the first and the
    last sentence, offsets."""
    names = ["h1", "h2", "doc_id", "th", "run", "last", "start", "stop"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def go(batches) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, th, text in rows_of(batches, "doc_id", "th", "text"):
            s = sentences(text) if text else []
            for i, j in shortest_runs([x[3] for x in s], run, min_words):
                part = s[i:j + 1]
                h = xxhash.xxh3_128_intdigest(b"\n".join([x[2] for x in part]))
                rows.append((signed(h >> 64), signed(h & (1 << 64) - 1), doc_id, th, i, j, part[0][0], part[-1][1]))
            if len(rows) >= flush:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return go


def repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal spans to remove: ``doc_id, th, start, stop, first_doc_id``.

    A run of 1 to ``run`` sentences with at least ``min_words`` words is
    repeated when it occurs at several places; the place with the smallest
    (doc_id, number of its first sentence) is the first one, rows without an
    id come last.  Overlapping and touching spans are one; ``first_doc_id`` is the smallest
    document that holds the first copy of one of its runs.  ``th`` tells
    texts that share an id apart.  Null, empty and short texts have no runs,
    equal rows have equal spans, an empty table gives no rows.

    First places are a partial aggregate (combined in the map tasks, so one
    run in a third of all documents is no hot group) joined back on the
    repeated hashes only."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text"))
    runs = in_arrow(docs, _runs(run, min_words),
                           "h1 long, h2 long, doc_id long, th long, run int, last int, start int, stop int")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "run")
    firsts = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")) \
        .filter(F.col("first") != F.col("last")).select("h1", "h2", "first")
    firsts = materialize(firsts, "span-firsts")
    hits = runs.join(firsts, ["h1", "h2"]).filter(place != F.col("first")) \
        .select("doc_id", "th", "run", "last", "start", "stop", F.col("first.doc_id").alias("first_doc_id")).distinct()
    w = Window.partitionBy("doc_id", "th").orderBy("run", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # between a sentence and the next one there is only white space
    islands = hits.withColumn("new", (reach.isNull() | (F.col("run") > reach + 1)).cast("int")) \
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "th", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id")) \
        .select("doc_id", "th", "start", "stop", "first_doc_id")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with all columns; ``text`` without the given spans."""
    i, h, r = (fresh(docs, x) for x in ("span_id", "span_hash", "spans"))
    per_doc = spans.groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)) \
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(r))
    joined = docs.join(per_doc, docs["doc_id"].cast("long").eqNullSafe(F.col(i))
                       & (F.xxhash64(docs["text"].cast("string")) == F.col(h)), "left")
    text = docs["text"]
    rest = F.aggregate(
        F.col(r), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["stop"].alias("at"), F.concat(
            a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.select(*[F.when(F.col(r).isNull(), text).otherwise(rest).alias(c) if c == "text" else docs[c]
                           for c in docs.columns])


def dedup_substrings(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated sentence spans."""
    return remove_spans(docs, materialize(repeated_spans(docs, run, min_words), "spans"))
