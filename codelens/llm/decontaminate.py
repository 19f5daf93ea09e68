"""Benchmark decontamination: BM25 index of the test items, block-max WAND.

The benchmark is the small side: its items are read in shards of bounded size,
each shard is an inverted index that is broadcast, and every passage of every
training text is a query against it.  Items above the score threshold are
verified by question and answer overlap and by their words' order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_arrow

K1, B = 1.2, 0.75
# Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP_PERCENT = 80
# Bound on one broadcast index, in characters of item text.
SHARD_CHARS = 2_000_000
_SUPERBLOCKS = 64
_BLOCK = 8
_CHUNK_WORDS = 1 << 16

# ASCII letters in lower case, digits, all bytes beyond ASCII; the rest is blank
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last line is the answer; of a single line its last sentence; of a
    single sentence its last third."""
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    if len(lines) > 1:
        return words_of("\n".join(lines[:-1])), words_of(lines[-1])
    parts = [x for x in (lines[0] if lines else "").replace("? ", "?\n").replace(". ", ".\n").split("\n") if words_of(x)]
    if len(parts) > 1:
        return words_of(" ".join(parts[:-1])), words_of(parts[-1])
    w = words_of(text)
    cut = len(w) - max(1, len(w) // 3)
    return w[:cut], w[cut:]


def shingles(words: list[bytes], k: int = SHINGLE) -> set:
    return set(zip(*[words[j:] for j in range(k)])) if len(words) >= k else {tuple(words)} if words else set()


def edits_inside(part: list[bytes], passage: list[bytes]) -> int:
    """Fewest words to insert, delete or change that turn ``part`` into some
    stretch of ``passage`` (Myers, one bit per word)."""
    if not part:
        return 0
    at: dict = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    every, top = (1 << len(part)) - 1, 1 << (len(part) - 1)
    more, less, distance, best = every, 0, len(part), len(part)
    for w in passage:
        here = at.get(w, 0)
        level = (((here & more) + more) ^ more) | here
        up, down = less | (every & ~(level | more)), more & level
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
            best = min(best, distance)
        kept = here | less
        up, down = (up << 1) & every, (down << 1) & every
        more, less = down | (every & ~(kept | up)), up & kept
    return best


def document_frequencies(benchmark: DataFrame) -> DataFrame:
    """(word, df) over all items, by the same word rule as :func:`words_of`."""
    clean = F.regexp_replace(F.translate(F.col("text"), ascii_uppercase, ascii_lowercase),
                             r"[\x00-\x7F&&[^a-z0-9]]+", " ")
    return benchmark.filter(F.col("text").isNotNull()) \
        .select(F.explode_outer(F.array_distinct(F.split(clean, " "))).alias("word")) \
        .filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class Shard:
    """BM25 index of a block of items, scores as shares of the item's own."""
    ids: list
    parts: list          # (question words, answer words, shingles)
    vocabulary: dict     # word -> term number
    postings: list       # term -> [(item, share)], item order
    block_max: list      # term -> {item // _BLOCK: largest share}
    bounds: np.ndarray   # term x superblock: largest share
    per_super: int
    window: int

    @staticmethod
    def build(items: list[tuple[int, str]], n_items: int, mean_length: float, df: dict) -> "Shard":
        prepared = sorted(((len(w), i, t, w) for i, t in items if (w := words_of(t))), key=lambda x: (x[0], x[1]))
        vocabulary: dict = {}
        ids, parts, contributions = [], [], []
        for length, item_id, text, words in prepared:
            own = {}
            for w in set(words):
                tf, n = words.count(w), df.get(w, 1)
                idf = np.log(1 + (n_items - n + 0.5) / (n + 0.5))
                own[vocabulary.setdefault(w, len(vocabulary))] = idf * tf * (K1 + 1) / (
                    tf + K1 * (1 - B + B * length / mean_length))
            total = sum(own.values())
            q, a = question_and_answer(text)
            ids.append(item_id), parts.append((q, a, shingles(words)))
            contributions.append({t: s / total for t, s in own.items()})
        per_super = max(1, -(-len(ids) // _SUPERBLOCKS))
        bounds = np.zeros((len(vocabulary) + 1, -(-max(1, len(ids)) // per_super)), np.float32)
        postings: list = [[] for _ in vocabulary]
        block_max: list = [{} for _ in vocabulary]
        for i, own in enumerate(contributions):
            for t, s in own.items():
                postings[t].append((i, s))
                block_max[t][i // _BLOCK] = max(block_max[t].get(i // _BLOCK, 0.0), s)
                bounds[t, i // per_super] = max(bounds[t, i // per_super], s)
        longest = max((x[0] for x in prepared), default=1)
        return Shard(ids, parts, vocabulary, postings, block_max, bounds, per_super, max(32, longest))

    def wand(self, terms: list[int], low: int, high: int, theta: float) -> list[tuple[int, float]]:
        """Items in ``[low, high)`` whose share is at least ``theta``:
        document-at-a-time with a pivot, skipping by block maxima."""
        lists = []
        for t in terms:
            p = [x for x in self.postings[t] if low <= x[0] < high]
            if p:
                lists.append([0, p, max(s for _, s in p), self.block_max[t]])
        found = []
        while lists:
            lists.sort(key=lambda c: c[1][c[0]][0])
            reach, pivot = 0.0, None
            for c in lists:
                reach += c[2]
                if reach >= theta - 1e-9:
                    pivot = c[1][c[0]][0]
                    break
            if pivot is None:
                break
            block = pivot // _BLOCK
            here = sum(c[3].get(block, 0.0) for c in lists if c[1][c[0]][0] <= pivot or c[1][c[0]][0] // _BLOCK == block)
            if here < theta - 1e-9:
                target = (block + 1) * _BLOCK
            else:
                score = 0.0
                for c in lists:
                    while c[0] < len(c[1]) and c[1][c[0]][0] < pivot:
                        c[0] += 1
                    if c[0] < len(c[1]) and c[1][c[0]][0] == pivot:
                        score += c[1][c[0]][1]
                if score >= theta - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            for c in lists:
                while c[0] < len(c[1]) and c[1][c[0]][0] < target:
                    c[0] += 1
            lists = [c for c in lists if c[0] < len(c[1])]
        return found

    def matches(self, documents: list[list[bytes]], theta: float, overlap: int) -> Iterator[tuple]:
        """(document number, item number, share, passage start, question
        overlap, answer overlap) of every verified passage.

        Passages are windows of two item lengths, half overlapping, so every
        occurrence of an item lies within one of them."""
        step, get = self.window, self.vocabulary.get
        pairs_w, pairs_t, first, doc_of = [], [], 0, []
        starts = []
        for d, words in enumerate(documents):
            if not words:
                continue
            t = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(t >= 0)
            n_windows = max(1, -(-len(words) // step))
            win = first + at // step
            earlier = at >= step
            pairs_w += [win, win[earlier] - 1]
            pairs_t += [t[at], t[at][earlier]]
            doc_of += [d] * n_windows
            starts += [i * step for i in range(n_windows)]
            first += n_windows
        if not pairs_w:
            return
        v = len(self.vocabulary) + 1
        key = np.unique(np.concatenate(pairs_w) * v + np.concatenate(pairs_t))
        if not len(key):
            return
        win, term = key // v, key % v
        heads = np.flatnonzero(np.diff(win, prepend=-1))
        upper = np.add.reduceat(self.bounds[term], heads, axis=0)
        ends = np.append(heads[1:], len(key))
        for row, sup in np.argwhere(upper >= theta - 1e-3):
            w = int(win[heads[row]])
            d, start = doc_of[w], starts[w]
            passage = documents[d][start:start + 2 * step]
            low = int(sup) * self.per_super
            for item, share in self.wand(term[heads[row]:ends[row]].tolist(), low, low + self.per_super, theta):
                question, answer, grams = self.parts[item]
                have = set(passage)
                q = len(have.intersection(question)) / len(set(question)) if question else 1.0
                a = len(have.intersection(answer)) / len(set(answer)) if answer else 1.0
                if min(q, a) * 100 >= overlap and self.in_order(item, passage, overlap):
                    yield d, item, share, start, q, a

    def in_order(self, item: int, passage: list[bytes], overlap: int) -> bool:
        """Whether the passage has the item's words in its order: enough of
        its shingles, which are as long as an item of fewer than ``SHINGLE``
        words, or, of a longer one, question and answer with few enough words
        changed."""
        question, answer, grams = self.parts[item]
        n = len(question) + len(answer)
        if 100 * len(grams & shingles(passage, min(SHINGLE, n))) >= overlap * len(grams):
            return True
        if n < SHINGLE:
            return False
        room = n * (100 - overlap) // 100
        used = edits_inside(question, passage)
        return used <= room and used + edits_inside(answer, passage) <= room


def shards(benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> Iterator[Shard]:
    """Indexes of consecutive blocks of items, each of at most ``shard_chars``
    characters (or one item); statistics are those of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates()
    df = document_frequencies(items)
    n, mean = items.agg(F.count(F.lit(1)), F.avg(F.size(F.split(F.col("text"), r"\s+")))).first()

    def build(block):
        wanted = sorted({w for _, t in block for w in words_of(t)})
        spark = benchmark.sparkSession
        known = df.join(spark.createDataFrame([(w.decode("utf-8", "replace"),) for w in wanted], "word string"), "word")
        return Shard.build(block, n, max(mean or 1.0, 1.0),
                           {r["word"].encode("utf-8"): r["df"] for r in known.collect()}) if wanted else None
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > shard_chars:
            if made := build(block):
                yield made
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block and (made := build(block)):
        yield made


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple[list, list]]:
    ids, docs, n = [], [], 0
    for doc_id, text in rows:
        w = words_of(text)
        ids.append(doc_id), docs.append(w)
        n += len(w)
        if n >= _CHUNK_WORDS:
            yield ids, docs
            ids, docs, n = [], [], 0
    if ids:
        yield ids, docs


def leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THRESHOLD, overlap: int = OVERLAP_PERCENT,
          shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, score,
    passage, question_overlap, answer_overlap`` (best passage; ``score`` is
    the BM25 score as a share of the item's own, ``passage`` its first word).

    Null or empty texts and items match nothing, repeated items count once,
    rows without an id are reported with a null id, an empty table on either
    side gives no rows."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, passage long, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shard in shards(benchmark, shard_chars):
        held = spark.sparkContext.broadcast(shard)

        def find(batches, held=held):
            index = held.value
            for batch in batches:
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                got = []
                for ids, texts in _chunks(rows):
                    for d, i, s, p, q, a in index.matches(texts, theta, overlap):
                        got.append((ids[d], index.ids[i], s, p, q, a))
                cols = list(zip(*got)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        part = in_arrow(source, find, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", (-F.col("passage")).alias("p"), "question_overlap", "answer_overlap")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.p")).alias("passage"),
        F.col("m.question_overlap").alias("question_overlap"), F.col("m.answer_overlap").alias("answer_overlap"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, theta: float = THRESHOLD,
                    overlap: int = OVERLAP_PERCENT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns unchanged.
    Each row is judged where it is read: no shuffle, no key needed."""
    spark, flag, text = docs.sparkSession, fresh(docs, "leaks"), fresh(docs, "leak_text")
    out = docs
    for shard in shards(benchmark, shard_chars):
        held = spark.sparkContext.broadcast(shard)

        def keep(batches, held=held):
            index = held.value
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                hit = np.zeros(batch.num_rows, bool)
                for rows, words in _chunks(enumerate(texts)):
                    for d, *_ in index.matches(words, theta, overlap):
                        hit[rows[d]] = True
                yield batch.filter(pa.array(~hit)).select(range(batch.num_columns - 1))
        schema = out.schema
        out = in_arrow(out.withColumn(text, F.col("text").cast("string")), keep, schema)
    return out
