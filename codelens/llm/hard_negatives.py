"""Hard negatives by inner-product search in an STR-packed R-tree.

Rows of one label are packed sort-tile-recursive: sorted by the coordinate of
largest variance and cut into slabs, each slab sorted by the next coordinate
and cut again, and so on; ``LEAF`` rows make a leaf, ``SHARD_LEAVES``
consecutive leaves a shard.  A minimum bounding box gives, coordinate by
coordinate, the interval of a vector's inner products with everything in it.

Searches run shard by shard.  A pair (anchors of one shard, other shard) is
dropped while it is still two boxes if no anchor can want a row of it.  Inside
a task every anchor keeps a queue of boxes, best bound first; boxes outside
its score windows or strictly below its kth score are pruned, the others are
opened into leaves and rows.  All arithmetic is in integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import position_within
from ..session import materialize
from .common import attach

POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)
ANCHOR_EVERY = 50
FLIP_EVERY = 7
N_LABELS = 10
SCALE = 256
LEAF = 128
FANOUT = 8
SHARD_LEAVES = 64
LEVELS = 3
# Anchors that visit a shard in one task.
VISITORS = 4096
# A quantised component must be smaller: products of two then stay exact.
LARGEST = 1 << 24


def usable_rows(embeddings: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(row, vec_id, label, v)`` of the rows that take part: label flipped
    where the contract says so, components in whole numbers, exact repeats of
    a row once.  ``row`` numbers the rows, also those that share an id."""
    x = F.col("_vec")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.col(vec).cast("array<double>").alias("_vec"))
    whole = F.transform(x, lambda c: F.floor(c * SCALE))
    fits = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST / SCALE))
    flipped = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % N_LABELS).otherwise(F.col("label"))
    rows = rows.filter(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fits) \
        .select("vec_id", flipped.cast("int").alias("label"), whole.cast("array<int>").alias("v")).distinct()
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rtree-rows")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``leaf``: sort-tile-recursive within every
    (label, length).  Full slabs, leaves and shards hold a fixed number of
    rows, so no group grows with the table."""
    rows = rows.withColumn("dim", F.size("v"))
    # one row per length and coordinate
    spread = rows.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at") \
        .agg(F.var_pop("x").alias("s"))
    w = Window.partitionBy("dim").orderBy(F.col("s").desc(), "at")
    axes = spread.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LEVELS) \
        .groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("r", "at")))["at"].alias("axes"))
    count = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    # slabs per level: the least that LEVELS levels of them hold all leaves
    slabs = F.ceil(F.pow(F.ceil(F.col("n") / LEAF).cast("double"), F.lit(1 / LEVELS)) - 1e-9).cast("long")
    out = rows.join(count.withColumn("slabs", slabs), ["label", "dim"]).join(axes, "dim")
    groups = ["label", "dim"]
    for level in range(LEVELS):
        axis = F.get(F.col("v"), F.get(F.col("axes"), F.lit(level)))
        out = position_within(out.withColumn("_x", F.coalesce(axis, F.lit(0))), groups, ["_x", "vec_id", "row"], "_pos")
        size = F.lit(LEAF) * F.pow(F.col("slabs").cast("double"), F.lit(LEVELS - 1 - level)).cast("long")
        out = out.withColumn(f"_s{level}", F.floor(F.col("_pos") / size).cast("long")).drop("_x", "_pos")
        groups.append(f"_s{level}")
    leaf = F.lit(0).cast("long")
    for level in range(LEVELS):
        leaf = leaf * F.col("slabs") + F.col(f"_s{level}")
    out = out.withColumn("_leaf", leaf)
    shard = F.concat_ws("/", F.col("label"), F.col("dim"), F.floor(F.col("_leaf") / SHARD_LEAVES))
    return materialize(out.select("row", "vec_id", "label", "v", "dim", shard.alias("shard"),
                                  (F.col("_leaf") % SHARD_LEAVES).cast("int").alias("leaf")), "rtree-packed")


def _boxes(rows: DataFrame, *extra: Column) -> DataFrame:
    """Bounding box ``lo``, ``hi`` per shard, and the aggregates ``extra``."""
    per = rows.select("shard", "label", "dim", F.posexplode("v").alias("at", "x")) \
        .groupBy("shard", "label", "dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    box = per.groupBy("shard", "label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("box"))
    box = box.select("shard", "label", "dim", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi"))
    return box if not extra else box.join(rows.groupBy("shard").agg(*extra), "shard")


def _interval(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Struct ``(least, most)`` of the inner products of two boxes."""
    corners = F.transform(F.arrays_zip(a_lo.alias("p"), a_hi.alias("q"), b_lo.alias("r"), b_hi.alias("s")), lambda z: F.array(
        *[z[i].cast("long") * z[j] for i in ("p", "q") for j in ("r", "s")]))
    total = lambda pick: F.aggregate(corners, F.lit(0).cast("long"), lambda acc, c: acc + pick(c))
    return F.struct(total(F.array_min).alias("least"), total(F.array_max).alias("most"))


def box_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every anchor with every box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Tree:
    """Leaves of one shard and the boxes above them, ``FANOUT`` each."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["leaf", "row"], kind="stable")
        self.v = np.stack(rows["v"].to_numpy()).astype(np.int64)
        self.ids = rows["vec_id"].to_numpy(dtype=object)
        self.row, self.label = rows["row"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        leaf = rows["leaf"].to_numpy()
        heads = np.append(0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1)
        self.spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(leaf)]))
        lo, hi = np.minimum.reduceat(self.v, heads), np.maximum.reduceat(self.v, heads)
        top = np.arange(0, len(heads), FANOUT)
        self.leaf_box, self.top_box = (lo, hi), (np.minimum.reduceat(lo, top), np.maximum.reduceat(hi, top))

    def search(self, anchors: np.ndarray, wanted: Callable, take: Callable) -> None:
        """Per anchor, boxes by largest upper bound first.  ``wanted(i, least,
        most)`` says whether a box may still hold a result of anchor ``i``;
        ``take(i, start, stop, scores)`` gets the rows of an opened leaf."""
        top_least, top_most = box_bounds(anchors, *self.top_box)
        least, most = box_bounds(anchors, *self.leaf_box)
        n_leaves = least.shape[1]
        for i in range(len(anchors)):
            queue = [(-m, 0, j) for j, m in enumerate(top_most[i].tolist())]
            heapq.heapify(queue)
            while queue:
                bound, is_leaf, j = heapq.heappop(queue)
                low = least[i, j] if is_leaf else top_least[i, j]
                if not wanted(i, low, -bound):
                    continue
                if is_leaf:
                    a, b = self.spans[j]
                    take(i, a, b, self.v[a:b] @ anchors[i])
                else:
                    for k in range(j * FANOUT, min((j + 1) * FANOUT, n_leaves)):
                        heapq.heappush(queue, (-int(most[i, k]), 1, k))


def _order(vec_id) -> tuple:
    """Ids in order, null after all others."""
    return (vec_id is None or vec_id != vec_id, vec_id)


def _best(kept: list, scores: np.ndarray, allowed: np.ndarray, tree: Tree, start: int, k: int) -> list:
    """The k best of ``kept`` and the allowed rows: score down, id up."""
    at = np.flatnonzero(allowed)
    if len(kept) == k:
        at = at[scores[at] >= kept[-1][0]]
    more = [(int(scores[x]), tree.ids[start + x], int(tree.row[start + x])) for x in at.tolist()]
    return sorted(kept + more, key=lambda t: (-t[0], _order(t[1]), t[2]))[:k] if more else kept


_POSITIVES = "anchor_row long, positive_id long, positive_row long, score long"


def _nearest(k: int):
    """Best rows of a shard for its visitors, other rows of the same label."""
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            tree = Tree(rows)
            v = np.stack(anchors["v"].to_numpy()).astype(np.int64)
            own, kth = anchors["row"].to_numpy(np.int64), anchors["kth"].to_numpy(np.float64)
            best: list[list] = [[] for _ in own]

            def wanted(i, least, most):
                return not most < kth[i] and (len(best[i]) < k or most >= best[i][-1][0])

            def take(i, a, b, scores):
                allowed = (tree.row[a:b] != own[i]) & ~(scores < kth[i])
                best[i] = _best(best[i], scores, allowed, tree, a, k)
            tree.search(v, wanted, take)
            out = [(o, t[1], t[2], t[0]) for o, found in zip(own.tolist(), best) for t in found]
        return pd.DataFrame(out, columns=["anchor_row", "positive_id", "positive_row", "score"]).astype(
            {"positive_id": "Int64"})
    return run


_NEGATIVES = "anchor_row long, positive_score long, negative_id long, negative_row long, negative_score long"


def _windowed(k: int, window: tuple[int, int]):
    """Best rows of a shard for every score window of its visitors."""
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            tree = Tree(rows)
            v = np.stack(anchors["v"].to_numpy()).astype(np.int64)
            goals = [sorted({int(p) for p in ps}) for ps in anchors["scores"]]
            # whole scores s with window[0] * p <= 100 * s <= window[1] * p
            spans = [[(-(-window[0] * p // 100), window[1] * p // 100) for p in ps] for ps in goals]
            best = [[[] for _ in ps] for ps in goals]

            def wanted(i, least, most):
                return any(least <= high and most >= low and low <= high
                           and (len(b) < k or min(most, high) >= b[-1][0])
                           for (low, high), b in zip(spans[i], best[i]))

            def take(i, a, b, scores):
                for j, (low, high) in enumerate(spans[i]):
                    best[i][j] = _best(best[i][j], scores, (scores >= low) & (scores <= high), tree, a, k)
            tree.search(v, wanted, take)
            out = [(o, p, *t[1:], t[0]) for o, ps, found in zip(anchors["row"].tolist(), goals, best)
                   for p, b in zip(ps, found) for t in b]
        return pd.DataFrame(out, columns=["anchor_row", "positive_score", "negative_id", "negative_row",
                                          "negative_score"]).astype({"negative_id": "Int64"})
    return run


def _visit(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, function, schema: str) -> DataFrame:
    """``function`` on every (home shard of anchors, shard) of ``pairs``: the
    anchors go to the shards, at most about ``VISITORS`` to one task."""
    per_home = anchors.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    rounds = pairs.join(per_home, "home").groupBy("shard") \
        .agg(F.ceil(F.sum("n") / VISITORS).cast("int").alias("rounds"))
    visits = pairs.join(rounds, "shard").join(anchors, "home") \
        .withColumn("round", F.pmod(F.xxhash64("row", "shard"), F.col("rounds")).cast("int")).drop("rounds")
    at = rows.select("row", "vec_id", "label", "v", "shard", "leaf").join(rounds, "shard") \
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).drop("rounds")
    return visits.groupBy("shard", "round").cogroup(at.groupBy("shard", "round")).applyInPandas(function, schema)


def _top(found: DataFrame, by: list[str], score: str, ident: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ident).asc_nulls_last(), tie)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def positives(tree: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``(anchor_row, positive_id, positive_row, score)``: the best other
    rows of each anchor's label, first in its own shard, then in the shards
    whose box can still reach the kth score."""
    home = anchors.select("home").distinct().withColumn("shard", F.col("home"))
    first = materialize(_visit(anchors.withColumn("kth", F.lit(float("-inf"))), tree, home, _nearest(k), _POSITIVES), "rtree-home")
    kth = first.groupBy(F.col("anchor_row").alias("row")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
    knowing = materialize(attach(anchors, "row", kth).withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))), "rtree-anchors")
    other, mine = _boxes(tree), _boxes(
        knowing.select(F.col("home").alias("shard"), "label", "dim", "v", "kth"), F.min("kth").alias("kth"))
    mine = mine.select(F.col("shard").alias("home"), "label", "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), "kth")
    pairs = other.join(mine, ["label", "dim"]).filter(
        (F.col("home") != F.col("shard"))
        & (_interval(F.col("alo"), F.col("ahi"), F.col("lo"), F.col("hi"))["most"] >= F.col("kth")))
    pairs = materialize(pairs.select("home", "shard"), "rtree-pairs")
    found = first
    if not pairs.isEmpty():
        found = first.unionByName(_visit(knowing, tree, pairs, _nearest(k), _POSITIVES))
    return materialize(_top(found, ["anchor_row"], "score", "positive_id", "positive_row", k)
                       .select("anchor_row", "positive_id", "positive_row", "score"), "rtree-positives")


def hard_negatives(embeddings: DataFrame, vec: str = "embedding", n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
                   anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` for every anchor and positive.

    Rows with a null label or vector, an empty vector, or a null, non-finite
    or huge (2^16 or more) component take no part; vectors of different
    lengths have no score with each other; exact repeats of a row count once;
    rows that share an id are separate rows; a row without an id is never an
    anchor and comes last among equal scores.  An empty table gives no rows."""
    rows = usable_rows(embeddings, vec)
    tree = packed(rows)
    anchors = materialize(tree.filter(F.col("vec_id") % anchor_every == 0)
                          .select("row", "vec_id", "label", "dim", "v", F.col("shard").alias("home")), "rtree-queries")
    near = positives(tree, anchors, n_positives)
    # a window asks nothing if no score fits in: negative positives have none
    goals = near.filter(F.col("score") >= 0).groupBy(F.col("anchor_row").alias("row")) \
        .agg(F.collect_set("score").alias("scores"))
    asking = materialize(anchors.join(goals, "row"), "rtree-asking")
    edge = asking.select("row", F.col("home").alias("shard"), "label", "dim", "v",
                         F.array_min("scores").alias("low"), F.array_max("scores").alias("high"))
    mine = _boxes(edge, F.min("low").alias("low"), F.max("high").alias("high")).select(
        F.col("shard").alias("home"), F.col("label").alias("mine"), "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"),
        "low", "high")
    reach = _interval(F.col("alo"), F.col("ahi"), F.col("lo"), F.col("hi"))
    pairs = _boxes(tree).join(mine, "dim").filter(F.col("label") != F.col("mine")).withColumn("reach", reach).filter(
        (100 * F.col("reach.most") >= window[0] * F.col("low"))
        & (100 * F.col("reach.least") <= window[1] * F.col("high")))
    pairs = materialize(pairs.select("home", "shard"), "rtree-pairs")
    found = _visit(asking, tree, pairs, _windowed(n_negatives, window), _NEGATIVES)
    best = _top(found, ["anchor_row", "positive_score"], "negative_score", "negative_id", "negative_row", n_negatives)
    return near.withColumnRenamed("score", "positive_score").join(best, ["anchor_row", "positive_score"]) \
        .join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                "positive_score", "negative_score")
