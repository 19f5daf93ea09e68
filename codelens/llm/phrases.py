"""Collocations by weighted acyclic automata.

Every task reads its texts in shards of bounded size and counts the shard's
n-grams.  The sorted n-grams of one language and length become an automaton
that accepts exactly them: a path for the words before the last one leads to a
state whose arcs carry the last word and the count.  Built from sorted input,
a state is complete when the next prefix begins, and states with the same arcs
and weights are one state.  The automata are cut by prefix range (prefixes in
the order of their hash; a prefix's arcs are spread over a few neighbouring
ranges, as a common word may be followed by any other), each range is united
in one task and the weights of equal paths are summed.

Longer n-grams are counted only where both shorter ones inside them are
frequent: a bitmap of fixed size holds the hashes of those, and a hash that is
in it by chance only adds an n-gram that the exact counts drop.  Candidates
are composed with the automata of their parts: one join on the path of the
first part and one on the path of the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import materialize
from .common import in_arrow
from .hashing import U64, mix64, rows_of

MIN_COUNT = 10
MAX_WORDS = 3
# Drop a candidate if a longer one reaches this share of its count.
INSIDE_PERCENT = 50
TOP = 2000
NO_LANG = "und"
# Words of one shard, and so the largest automaton of a task; ids take 21 bits.
SHARD_WORDS = 1_000_000
# Characters of the corpus per prefix range, and neighbouring ranges that one
# prefix's arcs are spread over.
RANGE_CHARS = 8 << 20
SPREAD = 8
# Largest bitmap of frequent n-grams, in bits.
BITMAP_BITS = 1 << 27

# All separators become one: it can't be part of a word.
_MARK = b"."
_PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", _MARK * 9)
_ID_BITS = 21


def tokens(text) -> list[bytes]:
    """Words, A-Z lower-cased, with marks between the pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_PIECES).replace(_MARK, b" . ").split()


class _Numbers(dict):
    """Words in order of appearance; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class CountAutomaton:
    """Count transducer of n-grams of one length.

    ``words`` are the symbols in byte order; ``prefixes`` (one row of symbols
    per path) lead to ``state``; the arcs of state ``s`` are ``arc_word`` and
    ``arc_weight`` from ``starts[s]`` to ``starts[s + 1]``."""

    def __init__(self, words: list[bytes], prefixes: np.ndarray, state: np.ndarray, starts: np.ndarray,
                 arc_word: np.ndarray, arc_weight: np.ndarray) -> None:
        self.words, self.prefixes, self.state, self.starts = words, prefixes, state, starts
        self.arc_word, self.arc_weight = arc_word, arc_weight

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> "CountAutomaton":
        """From distinct ``grams`` (rows of word numbers) in sorted order."""
        prefix = grams[:, :-1]
        heads = np.append(0, np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1)) + 1) if len(grams) else np.empty(0, int)
        n = np.diff(np.append(heads, len(grams))).astype(np.int64)
        arcs = np.column_stack([grams[:, -1], weights]).astype(np.int64)
        raw, register, state = arcs.tobytes(), {}, []
        for a, b in zip((16 * heads).tolist(), (16 * (heads + n)).tolist()):
            state.append(register.setdefault(raw[a:b], len(register)))
        # a state's arcs are those of the first prefix that leads to it
        first = np.unique(state, return_index=True)[1] if state else np.empty(0, int)
        chosen = np.zeros(len(heads), bool)
        chosen[first] = True
        arcs = arcs[np.repeat(chosen, n)]
        return cls(words, prefix[heads], np.array(state, np.int64), np.append(0, np.cumsum(n[chosen])), arcs[:, 0], arcs[:, 1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams as rows of word numbers, and their weights."""
        n = (self.starts[1:] - self.starts[:-1])[self.state]
        first = np.cumsum(n) - n
        arc = np.arange(n.sum()) - np.repeat(first - self.starts[self.state], n)
        grams = np.column_stack([np.repeat(self.prefixes, n, axis=0), self.arc_word[arc]])
        return grams.astype(np.int64), self.arc_weight[arc]

    def dump(self) -> bytes:
        lens = np.array([len(w) for w in self.words])
        parts = [lens, self.prefixes.ravel(), self.state, self.starts, self.arc_word, self.arc_weight]
        parts = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in parts]
        head = struct.pack(f"<I{2 * len(parts)}I", self.prefixes.shape[1],
                           *[v for x in parts for v in (len(x), x.itemsize)])
        return b"".join([head, *[x.tobytes() for x in parts], *self.words])

    @classmethod
    def load(cls, data: bytes) -> "CountAutomaton":
        depth, *sizes = struct.unpack_from("<I12I", data)
        at, parts = 52, []
        for n, size in zip(sizes[::2], sizes[1::2]):
            parts.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.int64))
            at += n * size
        lens, prefixes, state, starts, arc_word, arc_weight = parts
        ends = at + np.cumsum(lens)
        words = [data[b - n:b] for b, n in zip(ends.tolist(), lens.tolist())]
        return cls(words, prefixes.reshape(len(state), depth), state, starts, arc_word, arc_weight)


def _hash_words(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    return np.fromiter(map(xxh3_64_intdigest, words), U64, len(words))


def gram_hash(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams from the hashes of their words, one array per place."""
    out = np.full(len(columns[0]) if columns else 1, xxh3_64_intdigest(lang.encode()), U64)
    for c in columns:
        out = mix64(out * U64(0x9E3779B97F4A7C15) + c)
    return out


def range_of(lang: str, columns: list[np.ndarray], n_ranges: int) -> np.ndarray:
    """Prefix range of n-grams: the prefix's place among all hashes, moved by
    the last word within ``SPREAD`` neighbours."""
    at = (gram_hash(lang, columns[:-1]) >> U64(32)) * U64(n_ranges) >> U64(32)
    spread = columns[-1] if len(columns) == 1 else columns[-1] & U64(SPREAD - 1)
    return ((at + spread) % U64(n_ranges)).astype(np.int64)


def united(parts: Iterable[CountAutomaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words in byte order, distinct n-grams in sorted order, and the summed
    weights of several automata."""
    parts = list(parts)
    words = sorted(set().union(*[p.words for p in parts]))
    number = {w: i for i, w in enumerate(words)}
    grams, weights = [], []
    for p in parts:
        g, w = p.paths()
        grams.append(np.array([number[x] for x in p.words], np.int64)[g])
        weights.append(w)
    return words, *_summed(np.concatenate(grams), np.concatenate(weights))


def _summed(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(grams.T[::-1])
    grams, weights = grams[order], weights[order]
    heads = np.append(0, np.flatnonzero((grams[1:] != grams[:-1]).any(axis=1)) + 1) if len(grams) else np.empty(0, int)
    return grams[heads], np.add.reduceat(weights, heads) if len(heads) else weights


class _Shard:
    """Tokens of one language until the shard is full."""

    def __init__(self) -> None:
        self.number = _Numbers({_MARK: 0})
        self.ids: list[np.ndarray] = []
        self.new: list[np.ndarray] = []

    def add(self, words: list[bytes], n_old: int = 0) -> None:
        """``n_old``: leading words that an earlier shard has counted."""
        self.ids += [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.new.append(np.arange(len(words) + 1) >= n_old)

    def slices(self, lang: str, sizes: list[int], n_ranges: int, frequent) -> Iterator[tuple]:
        """``(range, size, automaton)`` of everything added."""
        names = list(self.number)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int64)
        rank[order] = np.arange(1, len(names))
        words = [names[i] for i in order]
        ids, hashes = rank[np.concatenate(self.ids)], np.append(U64(0), _hash_words(words))
        new = np.concatenate(self.new)
        for m in sizes:
            if len(ids) < m:
                continue
            places = [ids[j:len(ids) - m + 1 + j] for j in range(m)]
            whole = np.logical_and.reduce([p > 0 for p in places]) & new[m - 1:]
            if frequent is not None:
                for j in (0, 1):
                    whole &= frequent(gram_hash(lang, [hashes[p] for p in places[j:j + m - 1]]))
            code = np.zeros(int(whole.sum()), U64)
            for p in places:
                code = code << U64(_ID_BITS) | p[whole].astype(U64)
            code, counts = np.unique(code, return_counts=True)
            grams = np.column_stack([(code >> U64(_ID_BITS * (m - 1 - j)) & U64((1 << _ID_BITS) - 1)).astype(np.int64)
                                     for j in range(m)])
            if not len(grams):
                continue
            at = range_of(lang, [hashes[g] for g in grams.T], n_ranges)
            by_range = np.argsort(at, kind="stable")
            cuts = np.append(0, np.flatnonzero(np.diff(at[by_range])) + 1)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                rows = by_range[a:b]
                used, local = np.unique(grams[rows], return_inverse=True)
                yield int(at[rows[0]]), m, CountAutomaton.build(
                    [words[i - 1] for i in used.tolist()], local.reshape(-1, m), counts[rows])


_SLICE = "range long, lang string, size int, automaton binary"


def _slices(sizes: list[int], n_ranges: int, bitmap):
    """Automata of the shards of one task, cut by prefix range."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        frequent = None
        if bitmap is not None:
            bits = np.frombuffer(bitmap.value, np.uint8)
            mask = U64(8 * len(bits) - 1)

            def frequent(h):
                h = h & mask
                return (bits[(h >> U64(3)).astype(np.int64)] >> (h & U64(7)).astype(np.uint8) & 1).astype(bool)
        open_shards: dict[str, _Shard] = {}

        def flush():
            rows, held = [], 0
            for lang, shard in open_shards.items():
                for at, m, automaton in shard.slices(lang, sizes, n_ranges, frequent):
                    rows.append((at, lang, m, automaton.dump()))
                    held += len(rows[-1][3])
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            open_shards.clear()
            if rows:
                yield _batch(rows)

        held = 0
        for lang, text in rows_of(batches, "lang", "text"):
            words = tokens(text) if text else []
            for at in range(0, len(words), SHARD_WORDS):
                # a longer text goes on in the next shard, which repeats the
                # words that an n-gram across the cut begins with
                start = max(0, at - max(sizes) + 1)
                open_shards.setdefault(lang, _Shard()).add(words[start:at + SHARD_WORDS], at - start)
                held += min(len(words) - start, SHARD_WORDS)
                if held >= SHARD_WORDS:
                    yield from flush()
                    held = 0
        yield from flush()
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    at, lang, m, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lang, pa.string()), pa.array(m, pa.int32()),
                                       pa.array(data, pa.binary())], names=["range", "lang", "size", "automaton"])


_GRAM = "lang string, size int, phrase string, f long, hash long"


def _unite(min_count: int, flush: int = 1 << 16, merge_at: int = 1 << 22):
    """Frequent n-grams of whole prefix ranges, rows sorted by range, language
    and length; for single words also one row with the sum of all counts."""
    names = [x.split()[0] for x in _GRAM.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def grams(lang, size, parts):
        words, rows, weights = united(parts)
        if size == 1:
            yield lang, 0, None, int(weights.sum()), None
        often = np.flatnonzero(weights >= min_count)
        rows, weights = rows[often], weights[often]
        hashes = _hash_words(words)
        hashed = gram_hash(lang, [hashes[c] for c in rows.T]).astype(np.int64).tolist() if len(rows) else []
        for row, f, h in zip(rows.tolist(), weights.tolist(), hashed):
            yield lang, size, b" ".join([words[i] for i in row]).decode("utf-8", "surrogatepass"), f, h

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, parts, arcs, rows = None, [], 0, []
        for at, lang, size, data in rows_of(batches, "range", "lang", "size", "automaton"):
            if key is not None and key != (at, lang, size):
                rows += grams(*key[1:], parts)
                parts, arcs = [], 0
                if len(rows) >= flush:
                    yield batch(rows)
                    rows = []
            key = at, lang, size
            parts.append(CountAutomaton.load(data))
            arcs += len(parts[-1].arc_word)
            if arcs > merge_at and len(parts) > 1:
                words, all_rows, weights = united(parts)
                parts = [CountAutomaton.build(words, all_rows, weights)]
                arcs = 0
        if key is not None:
            rows += grams(*key[1:], parts)
        if rows:
            yield batch(rows)
    return run


def _bitmap(grams: DataFrame) -> bytes:
    """Bits of the n-grams' hashes: 64 per n-gram, ``BITMAP_BITS`` at most."""
    n = grams.count()
    bits = 1 << 15
    while bits < min(64 * n, BITMAP_BITS):
        bits <<= 1
    at = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    pieces = grams.groupBy(F.bitmap_bucket_number(at).alias("b")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = bytearray(bits // 8)
    for r in pieces.toLocalIterator():  # at most BITMAP_BITS / 2^15 rows of 4 KB
        out[(r["b"] - 1) * 4096:(r["b"] - 1) * 4096 + len(r["m"])] = r["m"]
    return bytes(out)


def count_grams(texts: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``_GRAM`` rows of all n-grams of 1 to ``max_words`` words that occur
    ``min_count`` times in their language; size 0 holds the number of words."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    found = None
    for sizes in [[1, 2], *[[m] for m in range(3, max_words + 1)]]:
        bitmap = None
        if sizes != [1, 2]:
            shorter = found.filter(F.col("size") == sizes[0] - 1)
            if shorter.isEmpty():
                break
            bitmap = spark.sparkContext.broadcast(_bitmap(shorter))
        slices = in_arrow(texts, _slices(sizes, n_ranges, bitmap), _SLICE)
        ranged = slices.repartition("range").sortWithinPartitions("range", "lang", "size")
        more = materialize(in_arrow(ranged, _unite(min_count), _GRAM), "phrase-counts")
        found = more if found is None else found.union(more)
    return found


def phrases(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
            inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, each language's ``top``
    phrases.

    A null text is empty and a null language is ``und``; repeated rows count
    as often as they occur; ids play no part; an empty table gives no rows."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col("text").cast("string").alias("text"))
    grams = count_grams(texts, max_words, min_count)
    candidates = materialize(grams.filter("size >= 2"), "phrase-candidates")
    # every cut of a candidate into a first part and the rest
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("w", words).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"),
            F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("right")))).alias("c")) \
        .select("lang", "phrase", "a", "c.*")
    part = grams.filter((F.col("size") >= 1) & (F.col("size") < max_words))
    side = lambda p, n: part.select("lang", F.col("phrase").alias(p), F.col("f").alias(n))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]) \
        .withColumn("x", F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a"))) \
        .withColumn("y", whole("l") * whole("r")).withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate around each run of words in it
    inner = candidates.filter("size >= 3").select("lang", F.col("f").alias("around"), F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = best.join(inner, ["lang", "phrase"], "left") \
        .filter(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = grams.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
