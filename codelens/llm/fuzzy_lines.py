"""Fuzzy line deduplication by SimHash.

Lines are normalised (ASCII letters lower-cased, digits 0, punctuation and
blanks one space).  Equal normalised lines are one group from the start.  A
line's fingerprint is cut into blocks by its features: the hash of a word
names the block that it takes part in, and each block is the 64-bit SimHash of
its own words.  A changed word so touches at most two blocks, wherever it
stands, and the others stay equal; lines that share enough equal blocks are
candidates.  Those whose edit similarity is high enough are links, and one
occurrence of each connected group stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import fresh, in_arrow
from .hashing import U64, WordHasher, mix64, rows_of
from .pigeonhole import linked_components

# Lines of fewer words are repeats only if they are equal.
MIN_WORDS = 5
EDIT_PERCENT = 90
# Words that the blocks of a key must hold.
KEY_WORDS = 3

_KEEP = bytes(range(256)).translate(bytes(
    10 if c == 10 else ord("0") if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c
    for c in range(256)))
# byte -> eight counters of one byte each, holding the byte's bits
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=U64)


def line_words(line: str) -> list[bytes]:
    """Words of the normalised line."""
    return line.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def simhashes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit SimHash of consecutive runs of word hashes (every run > 0)."""
    lanes = _LANES[words.view(np.uint8).reshape(-1, 8)]
    if lengths.max() < 256:
        starts = np.cumsum(lengths) - lengths
        counts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
        return np.packbits(counts > (lengths >> 1)[:, None], axis=1, bitorder="little").view(U64).ravel()
    # runs longer than 255 words are summed in pieces: a counter has one byte
    pieces = np.concatenate([[255] * (n // 255) + ([n % 255] if n % 255 else []) for n in lengths.tolist()]) \
        .astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int32)
    per_run = np.array([-(-n // 255) for n in lengths.tolist()], dtype=np.int64)
    counts = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(per_run)[:-1]]), axis=0)
    bits = 2 * counts > lengths[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()


def block_plan(n: int) -> tuple[int, int]:
    """(blocks, equal blocks of a key) for a line of ``n`` distinct words:
    blocks of 4 to 20 words, so that a changed word in twenty leaves some
    equal, while few unrelated lines share one.  In lines of fewer than 10
    words every word is a block, and all but one must be equal: (0, 0)."""
    for least, blocks, same in ((10, 0, 0), (20, 5, 2), (40, 5, 1), (80, 7, 1), (160, 12, 1), (320, 20, 1)):
        if n < least:
            return blocks, same
    return 32 << (n // 320).bit_length() - 1, 1


def plans_of(n: int) -> set[tuple[int, int]]:
    """Plans of a line of ``n`` distinct words: its own, and that of a line
    which is a tenth longer (the longer one has only its own)."""
    return {block_plan(n), block_plan(-(-n * 10 // 9))}


def block_keys(plan: tuple[int, int], words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, key)`` of consecutive lines of ``sizes`` distinct word hashes."""
    blocks, same = plan
    line = np.repeat(np.arange(len(sizes)), sizes)
    if not blocks:
        # all words, and all but each one
        own = mix64(words)
        total = np.add.reduceat(own, np.cumsum(sizes) - sizes)
        return (np.concatenate([np.arange(len(sizes)), line]),
                mix64(np.concatenate([total, np.repeat(total, sizes) - own])))
    cell = line * blocks + ((words >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cells, counts = np.unique(cell[order], return_counts=True)
    sims = simhashes(words[order], counts)
    if same == 1:
        some = counts >= KEY_WORDS
        at = cells[some]
        return at // blocks, mix64(sims[some] ^ mix64((at % blocks + (blocks << 32)).astype(U64)))
    sim, held = np.zeros(len(sizes) * blocks, dtype=U64), np.zeros(len(sizes) * blocks, dtype=np.int64)
    sim[cells], held[cells] = sims, counts
    sim, held = sim.reshape(-1, blocks), held.reshape(-1, blocks)
    lines, keys = [], []
    for j, chosen in enumerate(combinations(range(blocks), same)):
        some = np.flatnonzero(held[:, chosen].sum(axis=1) >= KEY_WORDS)
        key = np.full(len(some), j + (blocks << 32) + (same << 16), dtype=U64)
        for c in chosen:
            key = mix64(key) ^ sim[some, c]
        lines.append(some), keys.append(mix64(key))
    return np.concatenate(lines), np.concatenate(keys)


def _lines(min_words: int, chunk: int = 1 << 18):
    """(doc_id, th, line, norm, size, keys) of every line with a word; keys
    are null where a line of the same chunk gives them."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        rows, groups, number, n_words = [], defaultdict(lambda: ([], [], [])), {}, 0

        def out():
            at, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
            for plan, (ids, sizes, words) in groups.items():
                line, key = block_keys(plan, hasher(words), np.array(sizes))
                at.append(np.array(ids)[line]), keys.append(key)
            at, keys = np.concatenate(at), np.concatenate(keys)
            ends = np.cumsum(np.bincount(at, minlength=len(rows)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                pa.array(keys[np.argsort(at, kind="stable")].view(np.int64)),
                mask=pa.array([r[5] for r in rows], pa.bool_()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))] + [lists],
                names=["doc_id", "th", "line", "norm", "size", "keys"])
        for doc_id, th, text in rows_of(batches, "doc_id", "th", "text"):
            for no, line in enumerate(text.encode("utf-8", "surrogatepass").translate(_KEEP).split(b"\n") if text else ()):
                w = line.split()
                if not w:
                    continue
                norm = b" ".join(w)
                digest = xxhash.xxh3_128_digest(norm)
                again = digest in number
                if not again:
                    number[digest] = len(norm.decode("utf-8", "replace"))
                    if len(w) >= min_words:
                        features = set(w)
                        for plan in plans_of(len(features)):
                            ids, sizes, words = groups[plan]
                            ids.append(len(rows)), sizes.append(len(features))
                            words += features
                        n_words += len(features)
                rows.append((doc_id, th, no, digest, number[digest], again))
                if n_words >= chunk or len(rows) >= chunk:
                    yield out()
                    rows, number, n_words = [], {}, 0
                    groups.clear()
        if rows:
            yield out()
    return run


def _wanted(batches) -> Iterator[pa.RecordBatch]:
    """(lid, norm) of the lines that a document is asked for."""
    for batch in batches:
        lids, texts = [], []
        for text, wanted in rows_of([batch], "text", "wanted"):
            lines = text.split("\n")
            for w in wanted:
                lids.append(w["lid"])
                texts.append(b" ".join(line_words(lines[w["line"]])).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), pa.array(texts, pa.string())],
                                         names=["lid", "norm"])


def within_edits(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions and substitutions turn
    ``a`` into ``b``: common ends are cut off, the rest is computed with one
    bit per character (Myers)."""
    if abs(len(a) - len(b)) > limit:
        return False
    head, short = 0, min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return len(a) + len(b) <= limit
    m, at = len(a), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    more, less, distance = every, 0, m
    for j, c in enumerate(b):
        here = at.get(c, 0)
        level = (((here & more) + more) ^ more) | here | less
        up, down = less | (every & ~(level | more)), more & level
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - (len(b) - 1 - j) > limit:
            return False
        up = (up << 1 | 1) & every
        less, more = level & up, ((down << 1) & every) | (every & ~(level | up))
    return distance <= limit


def _band_within(longer: list[np.ndarray], shorter: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """``within_edits`` for many pairs at a time, in step: one bit per cell of
    a diagonal band (Hyyro), which lies in as many 64-bit words as the largest
    limit needs.  No pair may differ in length by more than its limit."""
    n, words = len(longer), int(2 * limits.max() + 1 + 63) // 64
    wide = 64 * words
    long, short = (np.array([len(x) for x in side]) for side in (longer, shorter))
    steps, top = int(short.max()), U64(63)
    # row i of the band begins ``limit`` characters after place i of the longer text
    a = np.zeros((n, int(long.max()) + steps + wide), longer[0].dtype)
    b = np.zeros((max(steps, 1), n), longer[0].dtype)
    for i, (x, y) in enumerate(zip(longer, shorter)):
        a[i, wide - 1 - limits[i]:][:len(x)] = x + 1
        b[:len(y), i] = y + 1
    # vertical differences +1 (up) and -1 (down) per word, lowest first
    bit = np.arange(wide).reshape(words, 64)
    first = (bit[:, None, :] >= (wide - 1 - limits)[None, :, None])
    up = [np.packbits(x, axis=1, bitorder="little").view(U64).ravel() for x in first]
    down = [np.zeros(n, U64) for _ in range(words)]
    distance, bend = limits.copy(), long - limits
    for j in range(steps):
        same = np.packbits((a[:, j:j + wide] == b[j][:, None]).ravel(), bitorder="little").view(U64).reshape(n, words)
        carry = np.zeros(n, U64)
        diagonal, plus, minus = [], [], []
        for w in range(words):
            x = same[:, w]
            masked = x & up[w]
            total = masked + up[w]
            over = total < masked
            total += carry
            carry = (over | (total < carry)).astype(U64)
            d = (total ^ up[w]) | x | down[w]
            diagonal.append(d)
            plus.append(down[w] | ~(d | up[w]))
            minus.append(d & up[w])
        for w in range(words):
            lower = diagonal[w] >> U64(1)
            if w + 1 < words:
                lower |= diagonal[w + 1] << top
            up[w], down[w] = minus[w] | ~(lower | plus[w]), lower & plus[w]
        # the cell followed runs down the band's last diagonal, then along the longer text's end
        running = j < short
        level = wide - 2 - (j - bend)
        along = running & (j >= bend)
        distance += running & (j < bend) & (diagonal[-1] >> top == 0)
        if along.any():
            at, place = level >> 6, (level & 63).astype(U64)
            rows = np.flatnonzero(along)
            for sign, side in ((1, plus), (-1, minus)):
                cells = np.stack(side)[at[rows], rows] >> place[rows] & U64(1)
                distance[rows] += sign * cells.astype(np.int64)
    return distance <= limits


# Pairs compared in step at least and at most, and the limit above which texts
# are compared one by one.
_STEP_LEAST, _STEP_MOST, _STEP_LIMIT = 64, 2048, 127


def all_within_edits(pairs: list[tuple[str, str]], limits: list[int]) -> np.ndarray:
    """:func:`within_edits` of every pair: those of like length together."""
    keep, rest = np.zeros(len(pairs), bool), []
    for i, ((x, y), limit) in enumerate(zip(pairs, limits)):
        if x == y:
            keep[i] = True
        elif abs(len(x) - len(y)) > limit:
            continue
        elif limit > _STEP_LIMIT or min(len(x), len(y)) <= limit:
            keep[i] = within_edits(x, y, limit)
        else:
            rest.append((not (x.isascii() and y.isascii()), limit // 32, max(len(x), len(y)), i))
    rest.sort()
    at = 0
    while at < len(rest):
        kind = rest[at][:2]
        end = at + 1
        while end < len(rest) and end - at < _STEP_MOST and rest[end][:2] == kind:
            end += 1
        some, at = [r[3] for r in rest[at:end]], end
        if len(some) < _STEP_LEAST:
            for i in some:
                keep[i] = within_edits(*pairs[i], limits[i])
            continue
        code = ("utf-32-le", np.uint32) if kind[0] else ("ascii", np.uint8)
        sides = [[np.frombuffer(x.encode(code[0]), code[1]) for x in sorted(pairs[i], key=len, reverse=True)] for i in some]
        keep[some] = _band_within([x for x, _ in sides], [y for _, y in sides], np.array([limits[i] for i in some]))
    return keep


def _similar(edit_percent: int):
    """Pairs of lines whose edit similarity is high enough."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(rows_of([batch], "ta", "tb"))
            keep = all_within_edits(pairs, [max(len(x), len(y)) * (100 - edit_percent) // 100 for x, y in pairs])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("th", F.xxhash64("text"))


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS, edit_percent: int = EDIT_PERCENT) \
        -> tuple[DataFrame, DataFrame]:
    """``(lines, keep)``: every line ``(doc_id, th, line, norm, size, keys)``
    and, for lines that belong to a group of two or more occurrences, ``(norm,
    first)`` with the occurrence that stays: the smallest
    ``(id is null, doc_id, th, line)`` of the connected group."""
    docs = _identified(docs)
    lines = materialize(in_arrow(
        docs, _lines(min_words), "doc_id long, th long, line int, norm binary, size int, keys array<long>"), "lines")
    occurrence = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "line")
    distinct = materialize(
        lines.groupBy("norm").agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("n"),
                                  F.first("size").alias("size"), F.first("keys", ignorenulls=True).alias("keys"))
        .withColumn("lid", F.monotonically_increasing_id()), "line-groups")
    keys = distinct.select(F.col("lid").alias("id"), F.explode_outer("keys").alias("key")).filter(F.col("key").isNotNull())

    def fits(a, b):
        return F.abs(a - b) <= F.floor(F.greatest(a, b) * (100 - edit_percent) / 100)

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct()
        per_doc = distinct.select("lid", "first").join(ids, "lid", "left_semi") \
            .groupBy(F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t")) \
            .agg(F.collect_list(F.struct("lid", F.col("first.line").alias("line"))).alias("wanted"))
        asked = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
        return materialize(in_arrow(asked.select("text", "wanted"), _wanted, "lid long, norm string")
                           .dropDuplicates(["lid"]), "line-texts")

    texts = []

    def links(pairs: DataFrame) -> DataFrame:
        # the first pairs name every line that shares a key: texts are read once
        if not texts:
            texts.append(texts_of(pairs))
        side = lambda x: texts[0].select(F.col("lid").alias(x), F.col("norm").alias(f"t{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits(F.length("ta"), F.length("tb")))
        return materialize(in_arrow(near.select("a", "b", "ta", "tb"), _similar(edit_percent), "a long, b long"),
                           "line-links")

    comp = materialize(linked_components(
        keys, links, distinct.select(F.col("lid").alias("id"), "size"),
        lambda a, b: fits(a("size"), b("size")), chain_rounds=4), "line-components")
    grouped = distinct.join(comp, F.col("lid") == F.col("id"), "left").filter(F.col("id").isNotNull() | (F.col("n") > 1)) \
        .select("norm", "first", F.coalesce("comp", "lid").alias("group"))
    stays = grouped.groupBy("group").agg(F.min("first").alias("stays"))
    keep = materialize(grouped.join(stays, "group").select("norm", F.col("stays").alias("first")), "line-keep")
    return lines, keep


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, th, removed)``: sorted numbers of the lines that go."""
    with scratch(docs.sparkSession) as written:
        lines, keep = line_groups(docs, **options)
        me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "line")
        removed = lines.join(keep, "norm").filter(me != F.col("first")) \
            .groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("removed"))
        return written(removed, "lines-removed")


def dedup_lines(docs: DataFrame, counts: tuple[str, str, str] | None = None, **options) -> DataFrame:
    """``docs`` with all columns, ``text`` without the repeated fuzzy lines.

    Lines of fewer than ``min_words`` words go only if an equal one stays,
    lines without words stay; null text stays null; rows
    with equal id and text are one document; rows without an id come after
    all others; an empty table gives no rows.  ``counts`` names three more
    columns: number of lines, of removed lines, and the array of these."""
    removed = removed_lines(docs, **options)
    i, h, r = (fresh(docs, x) for x in ("line_id", "line_hash", "line_removed"))
    right = removed.select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("removed").alias(r))
    joined = docs.join(right, docs["doc_id"].cast("long").eqNullSafe(F.col(i))
                       & (F.xxhash64(docs["text"].cast("string")) == F.col(h)), "left")
    text = docs["text"]
    cleaned = F.when(F.col(r).isNull(), text).otherwise(F.array_join(F.filter(
        F.split(text, "\n"), lambda x, n: ~F.array_contains(F.col(r), n)), "\n"))
    extra = []
    if counts:
        n = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
        gone = F.coalesce(F.col(r), F.array().cast("array<int>"))
        extra = [n.alias(counts[0]), F.size(gone).cast("long").alias(counts[1]), gone.alias(counts[2])]
    return joined.select(*[cleaned.alias(c) if c == "text" else docs[c] for c in docs.columns], *extra)
