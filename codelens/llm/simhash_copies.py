"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint is the 64-bit majority vote over the XXH64 hashes of
its word shingles.  Fingerprints within ``MAX_HAMMING`` bits link.  Cut into
``MAX_HAMMING + e`` blocks, two linked fingerprints agree in at least ``e``
whole blocks, so they share one of the keys made of ``e`` blocks each.

The graph is built on distinct fingerprints: equal ones are one point, however
many documents have them.  The points of a small key are all compared.  Those
of a large one are compared with a few heads (one pair per point and head);
where they still lie in several components, they go on to finer keys with more
equal blocks.  The finest key fixes 52 of the 64 bits, which at most 4,096
distinct fingerprints can share.  A linked pair thus meets in a small key, in
a finer one, or inside one component: no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import materialize
from .common import byte_words, components, in_arrow
from .hashing import U64, rows_of

SHINGLE = 3
MAX_HAMMING = 3
SEED = 42
# Points of one key that are compared with each other directly.
SMALL_KEY = 32
# Equal blocks of the keys that follow the first one.
FINER = (5, 13)
# Shingles whose hashes are held at a time.
_PIECE = 255 << 8
# byte -> eight counters of one byte each, holding the byte's bits
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=U64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest bit first."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    # a counter has one byte: sum runs of 255, then the runs
    whole = len(lanes) // 255 * 255
    runs = [lanes[:whole].reshape(-1, 255, 8).sum(axis=1, dtype=U64), lanes[whole:].sum(axis=0, dtype=U64)[None]]
    return np.concatenate(runs).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a word sequence; no words give zero."""
    if not words:
        return 0
    width = min(shingle, len(words))
    n, counts = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        piece = words[at:at + _PIECE + width - 1]
        joined = b" ".join(piece)
        stops = np.cumsum(np.fromiter(map(len, piece), np.int64, len(piece)) + 1) - 1
        starts = np.append(0, stops[:-1] + 1)
        grams = [joined[a:b] for a, b in zip(starts[:len(piece) - width + 1].tolist(), stops[width - 1:].tolist())]
        counts += bit_counts(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), U64, len(grams)))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                ids.append(doc_id)
                found.append(fingerprint(byte_words(text), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())],
                                             names=["doc_id", "point"])
    return run


def first_equal(n: int, max_hamming: int) -> int:
    """Equal blocks of the first key: as many as give 8 times more keys than
    there are points, two at least."""
    same = 2
    while same < FINER[-1] and 64 * same / (max_hamming + same) < np.log2(max(n, 1)) + 3:
        same += 1
    return same


def block_keys(point: Column, max_hamming: int, same: int) -> Column:
    """One key per choice of ``same`` of the ``max_hamming + same`` blocks:
    the number of the choice and the bits in it, hashed.  (A collision of two
    keys only adds a comparison.)"""
    blocks = max_hamming + same
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.xxhash64(F.lit(j), point.bitwiseAND(F.lit(signed(sum(chosen))).cast("long")))
                     for j, chosen in enumerate(combinations(masks, same))])


def hamming_components(points: DataFrame, max_hamming: int = MAX_HAMMING, small: int = SMALL_KEY) -> DataFrame:
    """``(id, comp)`` for every point that has a link; ``comp`` is the
    smallest point of its component.

    ``points`` has distinct non-null longs ``point`` and a ``weight`` (the
    heaviest point of a key is one of its heads: the middle of a group of near
    copies tends to be the most frequent)."""
    def close(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_hamming

    left = points.select("point", "weight")
    first = first_equal(left.count(), max_hamming)
    comp = None
    for same in [first, *[e for e in FINER if e > first]]:
        keyed = left.select("point", "weight", F.explode(block_keys(F.col("point"), max_hamming, same)).alias("key"))
        heads = (keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("point").alias("h0"),
            F.max(F.struct("weight", F.col("point").alias("p")))["p"].alias("h1"),
            F.min(F.struct(F.xxhash64("point", F.lit(same)).alias("r"), F.col("point").alias("p")))["p"].alias("h2"))
            .filter("n > 1"))
        shared = materialize(keyed.join(heads, "key"), "simhash-shared")
        last = same == FINER[-1]
        few = F.lit(True) if last else F.col("n") <= small
        side = lambda x: shared.filter(few).select("key", F.col("point").alias(x))  # noqa: E731,B023
        links = side("a").join(side("b"), "key").filter((F.col("a") < F.col("b")) & close("a", "b")).select("a", "b")
        many = shared.filter(~few)
        links = links.union(
            many.select("point", F.explode(F.array_distinct(F.array("h0", "h1", "h2"))).alias("head"))
            .filter((F.col("point") != F.col("head")) & close("point", "head")).select("point", "head"))
        if comp is not None:
            # what is known already, as one edge per point
            links = links.union(comp.filter("id != comp").select("id", "comp"))
        comp = materialize(components(links), "simhash-components")
        if last:
            break
        placed = many.join(comp, F.col("point") == F.col("id"), "left") \
            .select("key", "point", "weight", F.coalesce("comp", "point").alias("comp"))
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
        left = materialize(placed.join(split, "key", "left_semi").select("point", "weight").distinct(), "simhash-left")
        if left.isEmpty():
            break
    return comp


def near_copies(docs: DataFrame, shingle: int = SHINGLE, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable by links.

    A null or blank text has fingerprint zero and links like any other; rows
    that share an id are separate documents with one number; a row without an
    id takes part, and a component in which no row has an id has a null
    ``component_id``; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = materialize(in_arrow(docs, _fingerprints(shingle), "doc_id long, point long"), "simhash-points")
    points = materialize(marked.groupBy("point").agg(
        F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first")), "simhash-distinct")
    comp = points.join(hamming_components(points, max_hamming), F.col("point") == F.col("id"), "left") \
        .select("point", "first", F.coalesce("comp", "point").alias("comp"))
    lowest = comp.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = materialize(comp.join(lowest, "comp").select("point", "component_id"), "simhash-named")
    return marked.join(named, "point").select(
        "doc_id", F.lpad(F.lower(F.hex("point")), 16, "0").alias("fingerprint"), "component_id")
