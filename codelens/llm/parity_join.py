"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its word shingles.  Every shingle hash toggles one
bit of a sketch, so shared shingles cancel in the XOR of two sketches and the
Hamming distance is at most the size of the symmetric difference.  For two
sets of sizes a and b that reach the threshold that difference is at most
``D = (a + b) (1 - J) / (1 + J)``.  The sketch is cut into ``m > D`` blocks of
64 bits: at least ``m - D`` blocks of a linked pair are untouched by the
difference (pigeonhole).  Documents are grouped into size bands, a linked pair
lies in one band or in two neighbouring ones, and every document is sketched
for its own band and for the one below.  Equal blocks are candidates; those
within the Hamming bound are verified on the words.

A block's key is the XOR of the full hashes behind its bits.  Blocks of few
shingles say little: with all blocks in one fixed order, full ones first, two
documents that share ``m - D`` blocks share one among the first ``D + 1`` of
each, so only these give keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import byte_words, fresh, in_arrow
from .hashing import U64, WordHasher, mix64, rows_of, shingle_hashes
from .pigeonhole import linked_components

SHINGLE = 4
PERCENT = 85
# Blocks beyond the bound, in per cent of it: so many of the emptiest blocks
# give no key.
SPARE = 29


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands: each band reaches as far as a linked
    partner of its smallest size, so links join equal or neighbouring bands."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 100 // percent)))
    return ends


def bound_of(band: int, percent: int) -> int:
    """Largest symmetric difference of a linked pair whose smaller set lies
    in ``band``."""
    a = bands(percent)[band + 1] - 1
    b = a * 100 // percent
    return (a + b) * (100 - percent) // (100 + percent)


@dataclass
class Sketch:
    """Parity sketch of a set for one band: of the blocks that hold a shingle
    their numbers, sizes, 64 parity bits and the XOR of the full hashes."""
    band: int
    bound: int
    n_blocks: int
    block: np.ndarray
    size: np.ndarray
    parity: np.ndarray
    folded: np.ndarray

    def keys(self) -> np.ndarray:
        """One key per block that may be the first equal one: blocks in order
        of their size (largest first) and content, ``bound + 1`` of them."""
        block, size, parity, folded = self.block, self.size, self.parity, self.folded
        if len(block) <= self.bound:
            every = np.arange(self.n_blocks)
            spread = lambda x: _put(x, block, self.n_blocks)
            block, size, parity, folded = every, spread(size.astype(U64)).astype(np.int64), spread(parity), spread(folded)
        first = np.lexsort((block, folded, -size))[:self.bound + 1]
        block, parity, folded = block[first], parity[first], folded[first]
        place = mix64(block.astype(U64) + (U64(self.band) << U64(44)))
        return mix64(folded * U64(0x9E3779B97F4A7C15) ^ place ^ parity)

    def compact(self) -> bytes:
        """4 bits per block, each the XOR of 16 parity bits: its Hamming
        distance is at most that of the sketch.  A block holds about four
        shingles, so unrelated sets still differ in twice the bound."""
        p = _put(self.parity, self.block, self.n_blocks + self.n_blocks % 2)
        for shift in (32, 16, 8, 4):
            p = p ^ (p >> U64(shift))
        p &= U64(15)
        return (p[::2] << U64(4) | p[1::2]).astype(np.uint8).tobytes()


def _put(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, U64)
    out[at] = values
    return out


def sketches(hashes: np.ndarray, percent: int) -> list[Sketch]:
    """Of sorted distinct shingle hashes, for the set's own band and the one
    below.  The blocks are ranges of the hash, so each is a run."""
    if not len(hashes):
        return []
    own = int(np.searchsorted(bands(percent), len(hashes), side="right")) - 1
    out, bits, mixed = [], U64(1) << (hashes & U64(63)), mix64(hashes)
    for band in ((own, own - 1) if own else (own,)):
        bound = bound_of(band, percent)
        m = bound + 1 + -(-SPARE * bound // 100)
        block = (((hashes >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        heads = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
        out.append(Sketch(band, bound, m, block[heads], np.append(heads[1:], len(block)) - heads,
                          np.bitwise_xor.reduceat(bits, heads), np.bitwise_xor.reduceat(mixed, heads)))
    return out


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    if not len(hashes):
        return 0, 0
    return (int(np.sum(mix64(hashes), dtype=U64).astype(np.int64)),
            int(np.bitwise_xor.reduce(mix64(hashes ^ U64(0xD6E8FEB86659FD93))).astype(np.int64)))


_SHORT = [f"s{i}" for i in range(8)]
_SETS = ("doc_id long, n_shingles long, sig1 long, sig2 long, band int, own binary, below binary, "
         + ", ".join(f"{c} long" for c in _SHORT))


def short_sketch(hashes: np.ndarray) -> list[int]:
    """The parity sketch in 512 bits, as eight signed numbers."""
    odd = np.bincount((hashes >> U64(7)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sets(k: int, percent: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        names = [x.split()[0] for x in _SETS.split(", ")]
        types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 8
        for batch in batches:
            rows = []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                h = shingle_hashes(hasher(byte_words(text)), k)
                made = sketches(h, percent)
                rows.append((doc_id, len(h), *_signature(h), made[0].band if made else None,
                             *[s.compact() for s in made], *[None] * (2 - len(made)), *short_sketch(h)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)],
                                             names=names)
    return run


def _within_bound(percent: int):
    """Pairs whose sketches for a common band are within the Hamming bound."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ba, oa, la, bb, ob, lb in rows_of([batch], "ba", "oa", "la", "bb", "ob", "lb"):
                x, y = (oa, ob) if ba == bb else (la, ob) if ba > bb else (oa, lb)
                distance = np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()
                keep.append(bool(distance <= bound_of(min(ba, bb), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _keys(k: int, percent: int, flush: int = 1 << 18, remember: int = 1 << 16):
    """(key, id) rows; a set that the task has just sent is not sent
    again (its documents share a signature and are joined by that)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        hasher, sent = WordHasher(), set()
        keys, ids, held = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ids))],
                names=["key", "id"])
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            h = shingle_hashes(hasher(byte_words(text)), k)
            sig = _signature(h)
            if doc_id is None or not len(h) or sig in sent:
                continue
            if len(sent) >= remember:
                sent.clear()
            sent.add(sig)
            mine = np.concatenate([x.keys() for x in sketches(h, percent)])
            keys.append(mine), ids.append(np.full(len(mine), doc_id, np.int64))
            held += len(mine)
            if held >= flush:
                yield out()
                keys, ids, held = [], [], 0
        if keys:
            yield out()
    return run


def _verify(k: int, percent: int):
    """Pairs whose shingle sets, compared word by word, reach the threshold."""
    def grams(text):
        w = byte_words(text)
        return set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else {tuple(w)} if w else set()

    def run(batches) -> Iterator[pa.RecordBatch]:
        last_text, last = None, set()
        for batch in batches:
            a, b = [], []
            for x, y, tx, ty in rows_of([batch], "a", "b", "ta", "tb"):
                if tx != last_text:
                    last_text, last = tx, grams(tx)
                other = grams(ty)
                both = len(last & other)
                if both and 100 * both >= percent * (len(last) + len(other) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, traits: DataFrame, close, k: int,
              percent: int) -> DataFrame:
    """The candidate pairs ``(a, b)`` that are links, written once: first the
    short traits decide, then the sketches, last the words."""
    for x in "ab":
        pairs = pairs.join(traits.select(F.col("id").alias(x), *[
            F.col(c).alias(f"{x}_{c}") for c in traits.columns if c != "id"]), x)
    pairs = pairs.filter(close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b").distinct()
    side = lambda x: sets.select(
        F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("band").alias(f"b{x}"),
        F.col("own").alias(f"o{x}"), F.col("below").alias(f"l{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
                & (F.abs(F.col("ba") - F.col("bb")) <= 1)) \
        .select("a", "b", "ba", "oa", "la", "bb", "ob", "lb")
    near = in_arrow(near, _within_bound(percent), "a long, b long").distinct()
    near = materialize(near, "parity-pairs")
    if near.isEmpty():
        return near
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    texts = materialize(docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "parity-texts")
    with_b = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    links = in_arrow(both.select("a", "b", "ta", "tb"), _verify(k, percent), "a long, b long").distinct()
    return materialize(links, "parity-links")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` (size of its set) and
    ``component_id`` (smallest id reachable by links, itself included).

    Two documents link when ``100 * |A and B| >= percent * |A or B|``.  A null
    or blank text has an empty set and no link; rows that share an id are one
    vertex; a row without an id has no component (null); an empty table gives
    no rows.  Equal sets are one vertex before any pair is formed.

    Candidates come from :func:`pigeonhole.linked_components`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(_joined(docs, k, percent), "parity-joined")


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sets = materialize(in_arrow(docs, _sets(k, percent), _SETS), "parity-sets")
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    firsts = known.groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("rep"))
    same = materialize(known.join(firsts, ["n_shingles", "sig1", "sig2"]).select("doc_id", "rep").distinct(),
                       "parity-same")
    copies = same.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    traits = known.select(F.col("doc_id").alias("id"), "n_shingles", *_SHORT).dropDuplicates(["id", *_SHORT])

    def close(a, b):
        """Sizes and short sketches allow the threshold."""
        apart = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in _SHORT), F.lit(0))
        na, nb = a("n_shingles"), b("n_shingles")
        return (100 * na >= percent * nb) & (100 * nb >= percent * na) \
            & (apart * (100 + percent) <= (na + nb) * (100 - percent))

    def links(pairs: DataFrame) -> DataFrame:
        """Candidates on representatives of equal sets, verified."""
        one = pairs.join(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a") \
            .join(same.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
        one = one.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a != b").distinct()
        return _verified(one, docs, sets, traits, close, k, percent)

    keys = in_arrow(docs, _keys(k, percent), "key long, id long")
    comp = materialize(linked_components(keys, links, traits, close, copies), "parity-components")
    return sets.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id, all columns unchanged.  A document is an id with a text: of rows that
    share both one stays, rows that share an id alone are linked only if
    their texts are.  Rows without an id have no component and all stay."""
    v, low = fresh(docs, "vertex"), fresh(docs, "kept")
    named = docs.withColumn(v, F.when(F.col("doc_id").isNotNull(), F.xxhash64(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))))
    comp = jaccard_components(named.select(F.col(v).alias("doc_id"), "text"), k, percent) \
        .filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("vertex"), "component_id").distinct()
    ids = named.filter(F.col(v).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(v).alias("vertex")).distinct()
    kept = ids.join(comp, "vertex").groupBy("component_id") \
        .agg(F.min(F.struct("id", "vertex"))["vertex"].alias(low)).select(low)
    left = named.join(kept, F.col(v) == F.col(low), "left_semi").dropDuplicates([v])
    return left.unionByName(named.filter(F.col(v).isNull())).drop(v)
