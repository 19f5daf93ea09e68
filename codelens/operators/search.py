"""Retrieval: exact vector top-k, BM25 index / score / top-n,
reciprocal-rank fusion and hybrid search, for a whole table of queries.

Exact kNN never forms a query x corpus cross join.  Corpus rows belong to the
cell of their nearest centre; a query first searches the nearest cells that
hold k rows, which bounds its kth distance, and then only the cells that the
triangle inequality leaves in reach.  Queries meet the rows of a cell in
``cogroup`` tasks of bounded size that compute the distances tile by tile with
numpy and emit only the k best rows per query.  A final ``row_number() <= k``
merges them.

BM25 top-n scores only documents that can reach the list: a first pass over
each query's strongest term sets a score to beat, and a second one scores the
blocks of documents whose largest term impacts add up to it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import materialize
from .ranking import global_position, top_k

# BM25-Okapi parameters (fixed values of the public algorithm's defaults).
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# Reciprocal-rank fusion constant and hybrid defaults.
RRF_K = 60
HYBRID_LIMIT = 8

# kNN memory: one side of a block pair as float64, and one tile of
# differences.  A task holds two blocks and a tile, whatever the dimension.
KNN_BLOCK_BYTES = 8 << 20
KNN_MIN_CORPUS_BLOCK = 512
_TILE_BYTES = 8 << 20
# Queries of one tile, at least: a row of the corpus is read once per tile.
_KNN_TILE_QUERIES = 64
# Up to so many (query, row) pairs cells are not worth their jobs.
KNN_DIRECT_PAIRS = 1 << 17
# Bound on the centres that tasks hold (count, and bytes as float64).
KNN_MAX_CELLS = 1024
KNN_CENTRE_BYTES = 16 << 20

# BM25: documents of one block, and the postings from which blocks are used.
BM25_BLOCK_DOCS = 64
BM25_BOUND_POSTINGS = 1 << 16
# Postings of the index per task that scores.
BM25_TASK_POSTINGS = 1 << 19
# Slack of bounds against rounding of sums in another order.
_SLACK = 1e-9


# ---------------------------------------------------------------------------
# R2: vector validity
# ---------------------------------------------------------------------------
def valid_vector(vec, dim: int):
    v = F.col(vec) if isinstance(vec, str) else vec
    return v.isNotNull() & (F.size(v) == dim) & \
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


# ---------------------------------------------------------------------------
# Exact kNN
# ---------------------------------------------------------------------------
def _knn_block_fn(k: int, exclude_self: bool, reach=None):
    """k best corpus rows of a block for every query of a block.

    A product of matrices gives |c|^2 - 2qc for a tile of pairs; with the
    bound of its rounding error it rules out the pairs that cannot be among
    the k best, and only the others' distances are computed, by differences.
    A query's ``bound`` column, where there is one, is a distance that its k
    best do not pass.  ``reach(queries, cells)`` says which cells of the block
    each query must see; queries come sorted by ``home``, so a tile of them
    skips the cells that none of it needs."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series([], dtype=object), "id": pd.Series([], dtype=object),
                             "dist": pd.Series([], dtype="float64")})
        if len(q) == 0 or len(c) == 0:
            return none
        # corpus rows by id: among equal distances the first ones win
        c = c.sort_values("_cid", kind="stable")
        if reach is not None:
            q = q.sort_values("home", kind="stable")
            cells, cell_of = np.unique(c["cell"].to_numpy(), return_inverse=True)
        qids, cids = q["_qid"].to_numpy(), c["_cid"].to_numpy()
        qv = np.stack(q["_qv"].to_numpy()).astype(np.float64)
        cv = np.stack(c["_cv"].to_numpy()).astype(np.float64)
        bound = q["bound"].to_numpy(np.float64) if "bound" in q else np.full(len(q), np.inf)
        dim = qv.shape[1]
        with np.errstate(all="ignore"):
            limit = (bound * (1 + _SLACK) + _SLACK) ** 2
            qn, cn = np.einsum("ij,ij->i", qv, qv), np.einsum("ij,ij->i", cv, cv)
            right = np.column_stack([cv, cn])
            # not a number is never above a limit: such pairs are computed
            right[~np.isfinite(cn)] = np.nan
            error = 8 * (dim + 4) * np.finfo(np.float64).eps * (qn + cn[np.isfinite(cn)].max(initial=0.0))
        pairs = max(1, _TILE_BYTES // 8)
        q_step = max(1, min(len(q), max(_KNN_TILE_QUERIES, pairs // len(c))))
        c_step, few = max(1, pairs // q_step), max(1, _TILE_BYTES // (8 * dim))
        out = [none]
        for s in range(0, len(q), q_step):
            tile = slice(s, min(s + q_step, len(q)))
            own, left, thr = qv[tile], np.column_stack([-2 * qv[tile], np.ones(len(qv[tile]))]), limit[tile].copy()
            columns = None
            if reach is not None:
                wanted = reach(q.iloc[tile], own, cells).any(axis=0)
                if not wanted.all():
                    columns = np.flatnonzero(wanted[cell_of])
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            for t in range(0, len(c) if columns is None else len(columns), c_step):
                at = None if columns is None else columns[t:t + c_step]
                with np.errstate(all="ignore"):
                    g = left @ (right[t:t + c_step] if at is None else right[at]).T
                    if np.isinf(thr).any() and g.shape[1] > 2 * k:
                        # the k best of the first columns bound the rest
                        part = g[:, :max(16 * k, 1024)].copy()
                        if exclude_self:
                            part[qids[tile][:, None] == cids[t + np.arange(part.shape[1]) if at is None else at[:part.shape[1]]]] = np.inf
                        thr = np.fmin(thr, np.partition(part, k - 1, axis=1)[:, k - 1] + qn[tile] + 2 * error[tile])
                    top = thr - qn[tile] + error[tile]
                    top[np.isnan(top) | ~np.isfinite(qn[tile])] = np.inf
                    rows, cols = np.nonzero(~(g > top[:, None]))
                    del g
                    cols = cols + t if at is None else at[cols]
                    d = np.empty(len(rows))
                    for a in range(0, len(rows), few):
                        diff = own[rows[a:a + few]] - cv[cols[a:a + few]]
                        d[a:a + few] = np.einsum("ij,ij->i", diff, diff)
                    keep = np.isfinite(d)
                if exclude_self:
                    keep &= qids[tile][rows] != cids[cols]
                rows, d, cols = (np.concatenate([x, y[keep]]) for x, y in zip(best, (rows, d, cols)))
                order = np.lexsort((cols, d, rows))
                rows, d, cols = rows[order], d[order], cols[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                thr[rows[nth == k - 1]] = np.fmin(thr[rows[nth == k - 1]], d[nth == k - 1])
                best = tuple(x[nth < k] for x in (rows, d, cols))
            out.append(pd.DataFrame({"query_id": qids[tile][best[0]], "id": cids[best[2]], "dist": best[1]}))
        return pd.concat(out[1:] or out, ignore_index=True)
    return fn


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int, *,
             query_id: str = "query_id", query_vec: str = "vector",
             id_col: str = "id", vec_col: str = "vector", dim: int | None = None,
             exclude_self: bool = False, rank_col: str = "rank") -> DataFrame:
    """Exact squared-L2 top-k per query.  Ties break by corpus id.

    Returns ``query_id, id, dist (double), rank (int, 1-based)``; ``dist`` is
    the squared Euclidean distance, which orders like the distance itself.
    Null vectors and vectors with another length than ``dim`` (by default the
    corpus's most frequent length) or with null / NaN elements take no part on
    either side.  ``exclude_self`` drops corpus rows whose id equals the query
    id.

    Few pairs are compared block by block; beyond ``KNN_DIRECT_PAIRS`` the
    corpus is cut into cells (:class:`Cells`) and only (query, cell) pairs
    that the triangle inequality cannot rule out are compared.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv")).filter(F.col("_qv").isNotNull())
    c = corpus.select(F.col(id_col).alias("_cid"), F.col(vec_col).alias("_cv")).filter(F.col("_cv").isNotNull())
    out_schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                               T.StructField("id", corpus.schema[id_col].dataType),
                               T.StructField("dist", T.DoubleType())])
    # one row per side: the size of the block grid depends on it
    sizes = {r["_side"]: r for r in
             q.select(F.lit(0).alias("_side"), F.size("_qv").alias("_d"))
             .unionByName(c.select(F.lit(1).alias("_side"), F.size("_cv").alias("_d")))
             .groupBy("_side").agg(F.count(F.lit(1)).alias("_n"), F.mode("_d").alias("_dim")).collect()}
    if len(sizes) < 2:
        return spark.createDataFrame([], out_schema).withColumn(rank_col, F.lit(1))
    dim = dim or sizes[1]["_dim"]
    q, c = q.filter(valid_vector("_qv", dim)), c.filter(valid_vector("_cv", dim))
    nq, nc = sizes[0]["_n"], sizes[1]["_n"]
    if nq * nc <= KNN_DIRECT_PAIRS:
        partial = _all_blocks(q, c, nq, nc, dim, _knn_block_fn(k, exclude_self), out_schema)
    else:
        partial = Cells(c, nc, dim).nearest(q, nq, k, exclude_self, out_schema)
    ranked = top_k(partial, ["query_id"], [F.col("dist"), F.col("id")], k, rank_col)
    return ranked.withColumnRenamed("query_id", query_id) if query_id != "query_id" else ranked


def _all_blocks(q: DataFrame, c: DataFrame, nq: int, nc: int, dim: int, fn, schema) -> DataFrame:
    """Every pair of a query block and a corpus block, each of at most about
    ``KNN_BLOCK_BYTES``, in one task."""
    block = max(1, KNN_BLOCK_BYTES // (8 * max(dim, 1)))
    qb = max(1, math.ceil(nq / block))
    # at least one corpus block per core, of no fewer rows than worth a task
    cb = max(math.ceil(nc / block), min(max(1, q.sparkSession.sparkContext.defaultParallelism // qb),
                                        math.ceil(nc / KNN_MIN_CORPUS_BLOCK)), 1)

    def place(df, own, n_own, other, n_other, key):
        """Own block by hash, one copy per block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("long")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))
    return place(q, "_qb", qb, "_cb", cb, "_qid").groupBy("_qb", "_cb") \
        .cogroup(place(c, "_cb", cb, "_qb", qb, "_cid").groupBy("_qb", "_cb")).applyInPandas(fn, schema)


class Cells:
    """Corpus vectors by nearest centre.

    The centres are a bounded sample of the rows (lowest hash of the id), so
    tasks can hold them.  ``rows`` is written once with ``cell`` and ``r``,
    the distance to the centre; a cell knows how many rows it holds and
    between which distances (at most ``KNN_MAX_CELLS`` summary rows).  A row
    at distance r from the centre and a query at distance d are at least
    ``|d - r|`` apart."""

    def __init__(self, corpus: DataFrame, n: int, dim: int) -> None:
        most = max(1, min(KNN_MAX_CELLS, KNN_CENTRE_BYTES // (8 * max(dim, 1)), math.isqrt(max(n, 1))))
        finite = ~F.exists("_cv", lambda x: F.abs(x) == float("inf"))
        drawn = corpus.filter(finite).orderBy(F.xxhash64("_cid"), "_cid").limit(most).select("_cv").collect()
        self.dim = dim
        self.centres = np.array([r["_cv"] for r in drawn], np.float64).reshape(len(drawn), dim) \
            if drawn else np.zeros((1, dim))
        centres, schema = self.centres, T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType()),
                                                      T.StructField("r", T.DoubleType())])

        def assign(batches):
            for part in batches:
                d = _distances(np.stack(part["_cv"].to_numpy()).astype(np.float64), centres) if len(part) else np.empty((0, 1))
                # a vector without a distance to any centre is in reach of every query
                d = np.where(np.isnan(d), np.inf, d)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), r=d[np.arange(len(part)), cell])
        self.rows = materialize(corpus.mapInPandas(assign, schema), "cells")
        self.summary = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"),
                                                     F.max("r").alias("r_max")).orderBy("cell").collect()

    def pairs(self, queries: DataFrame, k: int, exclude_self: bool, bounds: DataFrame | None = None,
              shards: list[list[int]] | None = None) -> DataFrame:
        """``(_qid, _qv, cell)``: without ``bounds`` the nearest cells of every
        query until they hold k rows (one more where a query may find
        itself); with ``bounds(_qid, bound)`` the other cells within the bound.
        With ``shards`` (lists of places in the summary) one row ``(_qid, _qv,
        bound, home, shard)`` per query and shard that holds any cell within
        the bound."""
        cell, n, r_min, r_max = (np.array([r[c] for r in self.summary]) for c in ("cell", "n", "r_min", "r_max"))
        centres, need, first = self.centres[cell], k + bool(exclude_self), bounds is None
        qid, qv = queries.schema["_qid"], queries.schema["_qv"]
        integer = T.IntegerType()
        schema = T.StructType([qid, qv, T.StructField("cell", integer)] if shards is None else [
            qid, qv, T.StructField("bound", T.DoubleType()), T.StructField("home", integer), T.StructField("shard", integer)])

        def choose(batches):
            for whole in batches:
                # distances to all cells and the rows that come of them fit a tile
                step = max(1, _TILE_BYTES // (8 * (len(cell) + len(shards or "1") * centres.shape[1])))
                for part in (whole.iloc[a:a + step] for a in range(0, len(whole), step)):
                    d = _distances(np.stack(part["_qv"].to_numpy()).astype(np.float64), centres)
                    bound = None if first else part["bound"].to_numpy(np.float64)
                    if first:
                        chosen = _nearest_cells(d, n, need)
                    elif shards is None:
                        chosen = _within(d, r_min, r_max, bound) & ~_nearest_cells(d, n, need)
                    else:
                        within = _within(d, r_min, r_max, bound)
                        chosen = np.stack([within[:, s].any(axis=1) for s in shards], axis=1)
                    at, j = np.nonzero(chosen)
                    found = {"_qid": part["_qid"].to_numpy()[at], "_qv": part["_qv"].to_numpy()[at]}
                    if shards is None:
                        yield pd.DataFrame({**found, "cell": cell[j].astype(np.int32)})
                    else:
                        home = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
                        yield pd.DataFrame({**found, "bound": bound[at], "home": home[at].astype(np.int32),
                                            "shard": j.astype(np.int32)})
        asked = queries
        if not first:
            asked = queries.join(bounds.withColumnRenamed("_qid", "_b"), F.col("_qid").eqNullSafe(F.col("_b"))) \
                .select("_qid", "_qv", "bound")
        return asked.mapInPandas(choose, schema)

    def _shards(self, rows: int) -> list[list[int]]:
        """Cells (their places in the summary) in groups of at most ``rows``
        rows, neighbours together.  A cell of more rows is listed in several
        groups of its own, each of which gets a part of its rows."""
        centres, n = self.centres[[r["cell"] for r in self.summary]], [r["n"] for r in self.summary]
        left, at, shards, size = np.ones(len(n), bool), 0, [], rows
        for _ in n:
            left[at] = False
            if n[at] > rows:
                shards += [[at]] * math.ceil(n[at] / rows)
                size = rows
            elif size + n[at] > rows:
                shards.append([at])
                size = n[at]
            else:
                shards[-1].append(at)
                size += n[at]
            if left.any():
                d = _distances(centres[at:at + 1], centres)[0]
                at = int(np.where(left, np.where(np.isnan(d), np.finfo(float).max, np.minimum(d, np.finfo(float).max)), np.inf).argmin())
        return shards

    def _compare_shards(self, queries: DataFrame, nq: int, k: int, exclude_self: bool, bounds: DataFrame, schema) -> DataFrame:
        """Every query meets the shards that hold a cell in its reach.  A
        query is sent once per shard, not once per cell, and both sides of a
        task have at most ``KNN_BLOCK_BYTES``."""
        spark = queries.sparkSession
        block = max(1, KNN_BLOCK_BYTES // (8 * max(self.dim, 1)))
        qb = max(1, math.ceil(nq / block))
        n = sum(r["n"] for r in self.summary)
        # several tasks a core, of no fewer rows than worth a task
        many = min(math.ceil(4 * spark.sparkContext.defaultParallelism / qb), math.ceil(n / KNN_MIN_CORPUS_BLOCK))
        shards = self._shards(min(block, math.ceil(n / max(many, 1))))
        places: dict[int, list[int]] = {}
        for j, members in enumerate(shards):
            for at in members:
                places.setdefault(self.summary[at]["cell"], []).append(j)
        # one row per cell: at most KNN_MAX_CELLS
        place = spark.createDataFrame(list(places.items()), "cell int, shards array<int>")
        part = F.pmod(F.xxhash64("_cid"), F.size("shards")).cast("int")
        right = self.rows.join(F.broadcast(place), "cell") \
            .select("_cid", "_cv", "cell", F.element_at("shards", part + 1).alias("shard"),
                    F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_qb"))
        left = self.pairs(queries, k, exclude_self, bounds, shards) \
            .withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(qb)).cast("int"))
        centres, (cell, r_min, r_max) = self.centres, (np.array([r[c] for r in self.summary]) for c in ("cell", "r_min", "r_max"))

        def reach(q, qv, cells):
            at = np.searchsorted(cell, cells)
            return _within(_distances(qv, centres[cells]), r_min[at], r_max[at], q["bound"].to_numpy(np.float64))
        return left.groupBy("shard", "_qb").cogroup(right.groupBy("shard", "_qb")) \
            .applyInPandas(_knn_block_fn(k, exclude_self, reach), schema)

    def _compare(self, pairs: DataFrame, function, schema) -> DataFrame:
        """Queries meet the rows of their cells.  Both sides of a cell are cut
        into blocks of bounded bytes, so a hot cell is many tasks."""
        block = max(1, KNN_BLOCK_BYTES // (8 * max(self.dim, 1)))
        per_cell = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nq"))
        grid = self.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nc")).join(per_cell, "cell")

        def cut(df, key, own, n_own, other, n_other):
            every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
            return df.join(grid, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int")) \
                .withColumn(other, every).drop("_nq", "_nc")
        left, right = cut(pairs, "_qid", "_qb", "_nq", "_cb", "_nc"), cut(self.rows, "_cid", "_cb", "_nc", "_qb", "_nq")
        return left.groupBy("cell", "_qb", "_cb").cogroup(right.groupBy("cell", "_qb", "_cb")).applyInPandas(function, schema)

    def nearest(self, queries: DataFrame, nq: int, k: int, exclude_self: bool, schema) -> DataFrame:
        """``(query_id, id, dist)``, among them the k nearest of each query."""
        if not self.summary:
            return queries.sparkSession.createDataFrame([], schema)
        fn = _knn_block_fn(k, exclude_self)
        near = self._compare(materialize(self.pairs(queries, k, exclude_self), "knn-pairs"), fn, schema)
        near = top_k(near, ["query_id"], [F.col("dist"), F.col("id")], k, "_r")
        # k distances bound the kth; with fewer every cell stays in reach
        near = near.groupBy(F.col("query_id").alias("_near")).agg(
            F.sqrt(F.max("dist")).alias("bound"), F.count(F.lit(1)).alias("n"))
        bounds = queries.select("_qid").distinct().join(near, F.col("_qid").eqNullSafe(F.col("_near")), "left").select(
            "_qid", F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound"))
        return self._compare_shards(queries, nq, k, exclude_self, materialize(bounds, "knn-bounds"), schema)


def _nearest_cells(d: np.ndarray, n: np.ndarray, need: int) -> np.ndarray:
    """Per query the nearest cells (at distances ``d``, of ``n`` rows each)
    that hold ``need`` rows."""
    order = np.argsort(np.where(np.isnan(d), np.inf, d), axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    home = np.zeros(d.shape, bool)
    np.put_along_axis(home, order, before < need, axis=1)
    return home


def _within(d: np.ndarray, r_min: np.ndarray, r_max: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Per query the cells that its bound does not rule out."""
    with np.errstate(invalid="ignore"):
        least = np.maximum(np.maximum(d - r_max, r_min - d), 0)
    # not "least <= bound": an unknown distance is in reach
    return ~(least > bound[:, None] * (1 + _SLACK) + _SLACK)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, computed in tiles of differences: the shorter
    form by inner products would lose digits that bounds rely on."""
    out = np.empty((len(rows), len(centres)))
    step = max(1, _TILE_BYTES // (8 * max(centres.size, 1)))
    with np.errstate(invalid="ignore"):
        for s in range(0, len(rows), step):
            diff = rows[s:s + step, None, :] - centres[None]
            out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


# ---------------------------------------------------------------------------
# BM25 index
# ---------------------------------------------------------------------------
class BM25Index:
    """BM25 tables over a corpus of (id, text), built once and kept.

    ``postings(id, term, tf, dl)``, ``docs(id, dl)``, ``terms(term, df,
    idf_raw, idf)`` and the scalars ``n_docs`` / ``avgdl`` / ``mean_idf``.
    Texts meet by id before they are cut into tokens, so what is shuffled for
    ``tf`` is the text once and not one row per posting; ``df`` is an
    aggregation with map-side combine, so a term present in every document
    costs one partial row per map task.  Texts are tokenized exactly once:
    postings and terms are written as Parquet under the shared checkpoint
    folder (:func:`codelens.session.materialize`), so scoring any number of
    query tables never re-reads the corpus.  ``n_docs`` is the corpus row
    count (ids are unique, see :func:`dedupe_by_id`), ``avgdl`` is
    ``sum(tf) / n_docs``; the scalars are single-row aggregates fetched once.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "content"):
        # as many parts as shuffles have: adaptive execution would unite texts
        # by their bytes, not by the postings that a task has to hold
        corpus = docs.select(F.col(id_col).alias("id"), F.col(text_col)).repartition(
            int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        # Per-document values are computed before the explode, so the
        # generator never carries (or recomputes over) the token array.
        base = corpus.select("id", tx.tokenize(text_col).alias("_toks")) \
            .select("id", F.coalesce(F.size("_toks"), F.lit(0)).alias("dl"), "_toks")
        # explode_outer (not explode): a plain explode makes Catalyst infer
        # size(tokens) > 0 and push it into the scan, re-tokenizing every
        # text there before the spread.  An empty document keeps one
        # null-term row, so the written table also yields the document count.
        # the rows of an id are in one task, so this shuffles nothing
        rows = (base.select("id", "dl", F.explode_outer("_toks").alias("term"))
                .groupBy("id", "term", "dl").agg(F.count("term").alias("tf")))
        # An empty document keeps one null-term row, so it counts too.
        written = materialize(rows, "postings")
        docs = materialize(written.groupBy("id").agg(F.max("dl").cast("long").alias("dl")), "documents")
        self._init_from(written, docs)

    def _init_from(self, written: DataFrame, docs: DataFrame, terms: DataFrame | None = None,
                   totals: tuple[int, int] | None = None) -> None:
        self._written = written
        self.postings = written.filter(F.col("term").isNotNull())
        self.docs = docs
        self.doc_ids = docs.select("id")
        self.n_docs, length = totals or docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self.avgdl = float(length) / self.n_docs if self.n_docs else 0.0
        if terms is None:
            terms = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if "idf_raw" not in terms.columns:
            terms = materialize(terms.withColumn(
                "idf_raw", F.ln(F.lit(float(self.n_docs)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)),
                "terms")
        self._raw_terms = terms
        mean, total = terms.agg(F.avg("idf_raw"), F.sum("df")).first()
        self.mean_idf = float(mean) if mean is not None else 0.0
        self.n_postings = int(total or 0)
        self._blocks = None
        self.terms = terms.withColumn(
            "idf", F.when(F.col("idf_raw") < 0, F.lit(BM25_EPSILON * self.mean_idf)).otherwise(F.col("idf_raw")))

    def impact(self, k1: float = BM25_K1, b: float = BM25_B):
        """What a posting adds to a score, per unit of query weight."""
        tf = F.col("tf").cast("double")
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(self.avgdl)))

    def tasks(self) -> int:
        """Partitions in which a task scores about ``BM25_TASK_POSTINGS``."""
        return max(1, math.ceil(self.n_postings / BM25_TASK_POSTINGS))

    def block(self):
        """Number of a document's block of about ``BM25_BLOCK_DOCS`` documents."""
        return F.pmod(F.xxhash64("id"), F.lit(max(1, self.n_docs // BM25_BLOCK_DOCS)))

    def blocks(self, k1: float = BM25_K1, b: float = BM25_B) -> tuple[DataFrame, DataFrame]:
        """Postings ``(term, block, id, impact)`` and ``(term, block, top)``,
        the largest impact of a term in a block of about ``BM25_BLOCK_DOCS``
        documents; written once per index and parameters."""
        if self._blocks is None or self._blocks[0] != (k1, b):
            rows = materialize(self.postings.select(
                "term", self.block().alias("block"), "id", self.impact(k1, b).alias("impact")), "blocked")
            tops = materialize(rows.groupBy("term", "block").agg(F.max("impact").alias("top")), "block-tops")
            self._blocks = (k1, b), rows, tops
        return self._blocks[1:]

    def save(self, path: str) -> None:
        """Persist the index tables (``postings/``, ``terms/``) under ``path``."""
        self._written.write.mode("errorifexists").parquet(f"{path}/postings")
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")
        self._raw_terms.write.mode("errorifexists").parquet(f"{path}/terms")

    @classmethod
    def of_tables(cls, postings: DataFrame, docs: DataFrame, terms: DataFrame, n_docs: int, length: int) -> "BM25Index":
        """From tables kept elsewhere: ``postings(id, term, tf, dl)``,
        ``docs(id, dl)``, ``terms(term, df)`` and the corpus totals."""
        idx = cls.__new__(cls)
        idx._init_from(postings, docs, terms, (n_docs, length))
        return idx

    @classmethod
    def load(cls, spark, path: str) -> "BM25Index":
        """Open an index written by :meth:`save` without touching the corpus."""
        idx = cls.__new__(cls)
        idx._init_from(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"),
                       spark.read.parquet(f"{path}/terms"))
        return idx


def query_terms(queries: DataFrame, query_id: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term, qtf): repeated query terms count each time."""
    return (queries.select(F.col(query_id).alias("query_id"),
                           F.explode_outer(tx.tokenize(text_col)).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


# ---------------------------------------------------------------------------
# BM25 scores
# ---------------------------------------------------------------------------
def bm25_scores(index: BM25Index, queries: DataFrame, query_id: str = "query_id",
                text_col: str = "query", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Score of every (query, document) pair sharing at least one term.

    ``query_id, id, score``.  The postings of the query terms are shuffled
    once, by document; where the weights are small enough to be broadcast (the
    planner's choice, their table's size is known) a document is scored
    against all queries in that task, and no (query, document) row is
    shuffled.
    """
    weights = query_weights(index, queries, query_id, text_col)
    rows = index.postings.join(weights.select("term").distinct(), "term", "left_semi") \
        .select("term", "id", index.impact(k1, b).alias("impact")).repartition(index.tasks(), "id")
    return rows.join(weights, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def query_weights(index: BM25Index, queries: DataFrame, query_id: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(query_id, term, weight)`` of the query terms that the index knows,
    written once."""
    known = query_terms(queries, query_id, text_col).join(index.terms.select("term", "idf"), "term")
    return materialize(known.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "query-weights")


# ---------------------------------------------------------------------------
# BM25 top-n with zero-score fill
# ---------------------------------------------------------------------------
def bounded_scores(index: BM25Index, queries: DataFrame, n: int, query_id: str = "query_id",
                   text_col: str = "query", k1: float = BM25_K1, b: float = BM25_B,
                   slack: float = _SLACK) -> tuple[DataFrame, DataFrame]:
    """``(scores, blocks)``: exact scores ``(query_id, id, score)`` of every
    document that can be among a query's n best with a score above 0, and
    the ``(query_id, block)`` pairs that can hold one.

    Pass 1 takes the n documents in which the query's strongest term has most
    impact and scores them in full; their nth score is the one to beat.  A
    block's bound is the sum of its terms' largest impacts; a block below the
    score to beat holds none of the n best, and blocks that are so for every
    query are not read again.  Only postings of query terms are read, and what
    is joined or summed by block lies in one task, so that neither (query,
    block) nor (query, document) rows are shuffled before they are few.
    ``slack`` is how far scores may be rounded."""
    weights = query_weights(index, queries, query_id, text_col)
    rows = materialize(
        index.postings.join(weights.select("term").distinct(), "term", "left_semi")
        .select("term", index.block().alias("block"), "id", index.impact(k1, b).alias("impact"))
        .repartition(index.tasks(), "block"), "blocked")
    tops = materialize(rows.groupBy("term", "block").agg(F.max("impact").alias("top")), "block-tops")
    highest = tops.groupBy("term").agg(F.max("top").alias("most"))
    strongest = materialize(
        weights.filter("weight > 0").join(highest, "term").groupBy("query_id")
        .agg(F.max(F.struct((F.col("weight") * F.col("most")).alias("reach"), "term"))["term"].alias("term")), "strongest")
    first = top_k(strongest.join(rows, "term"), ["query_id"], [F.col("impact").desc(), F.col("id")], n, "_r") \
        .select("query_id", "id", "block")
    score = F.sum(F.col("weight") * F.col("impact")).alias("score")
    first = materialize(materialize(first, "first").join(weights, "query_id"), "first-terms")
    seen = first.join(rows, ["term", "block", "id"]).groupBy("query_id", "id").agg(score)
    beat = materialize(seen.groupBy("query_id").agg(F.min("score").alias("beat"), F.count(F.lit(1)).alias("k"))
                       .filter(F.col("k") >= n).select("query_id", "beat"), "beat")

    def able(df: DataFrame, value: str) -> DataFrame:
        return df.join(beat, "query_id", "left").filter(
            F.col("beat").isNull() | (F.col(value) >= F.col("beat") - slack - _SLACK * F.abs("beat")))
    reach = tops.repartition(index.tasks(), "block").join(weights.filter("weight > 0"), "term").groupBy("query_id", "block") \
        .agg(F.sum(F.col("weight") * F.col("top")).alias("reach"))
    open_blocks = materialize(able(reach, "reach").select("query_id", "block"), "open-blocks")
    scored = rows.repartition(index.tasks(), "block").join(open_blocks.select("block").distinct(), "block", "left_semi") \
        .join(weights, "term").groupBy("query_id", "block", "id").agg(score)
    return able(scored, "score").select("query_id", "id", "score"), open_blocks


def bm25_topk(index: BM25Index, queries: DataFrame, n: int, query_id: str = "query_id",
              text_col: str = "query", score_digits: int | None = None,
              rank_col: str = "rank") -> DataFrame:
    """The n best documents per query over the whole corpus, as
    ``argsort(scores)[::-1][:n]`` would give them: documents sharing no term
    score 0 and fill the list when fewer than n score above 0.

    Order: score descending, then id ascending.  The fill is exact without
    touching query x corpus: when a query needs m zero-score rows, they lie
    among the first ``m + nonzero_count`` documents by id, so only that many
    candidates are generated, joined on a global document position.
    """
    def rounded(out: DataFrame) -> DataFrame:
        return out if score_digits is None else out.withColumn("score", F.round("score", score_digits))

    def scores(some: DataFrame) -> DataFrame:
        return rounded(bm25_scores(index, some, query_id, text_col))
    if index.n_postings < BM25_BOUND_POSTINGS:
        able = scores(queries)
    else:
        slack = _SLACK if score_digits is None else 10.0 ** -score_digits
        able = rounded(bounded_scores(index, queries, n, query_id, text_col, slack=slack)[0])
    # at most n rows per query leave the scoring and are written
    best = top_k(able.filter(F.col("score") > 0), ["query_id"],
                 [F.col("score").desc(), F.col("id")], n, "_r").drop("_r")
    best = materialize(best, "scores")
    qids = queries.select(F.col(query_id).alias("query_id")).distinct()
    counts = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_pos"))
    need = qids.join(counts, "query_id", "left").select("query_id", F.coalesce("_pos", F.lit(0)).alias("_pos")) \
        .filter(F.col("_pos") < n).withColumn("_m", F.lit(n) - F.col("_pos"))
    pool = best.select("query_id", "id", "score")
    if not need.isEmpty():
        # queries with fewer than n positive documents: their other scores
        # (few, as they share no more than n documents' worth of terms above
        # zero) and the zeros
        short = queries.join(need.select(F.col("query_id").alias(query_id)), query_id, "left_semi")
        other = materialize(scores(short).filter(F.col("score") != 0), "short-scores")
        seen = other.groupBy("query_id").agg(F.count(F.lit(1)).alias("_nz"))
        cand = need.join(seen, "query_id", "left").select("query_id", F.explode(F.sequence(
            F.lit(0).cast("long"),
            F.least(F.col("_m") + F.coalesce("_nz", F.lit(0)), F.lit(index.n_docs)).cast("long") - 1)).alias("_g"))
        by_pos = global_position(index.doc_ids, [F.col("id")], out="_g")
        zeros = (cand.join(by_pos, "_g")
                 .join(other.select("query_id", "id"), ["query_id", "id"], "left_anti")
                 .select("query_id", "id", F.lit(0.0).alias("score")))
        pool = pool.unionByName(zeros).unionByName(other.filter(F.col("score") < 0).select("query_id", "id", "score"))
    ranked = top_k(pool, ["query_id"], [F.col("score").desc(), F.col("id")], n, rank_col)
    return ranked.withColumnRenamed("query_id", query_id) if query_id != "query_id" else ranked


# ---------------------------------------------------------------------------
# Reciprocal-rank fusion
# ---------------------------------------------------------------------------
def rrf_fuse(ranked_lists: list[DataFrame], limit: int = HYBRID_LIMIT, k: int = RRF_K,
             rank_col: str = "rank") -> DataFrame:
    """Fuse lists of ``(query_id, id, rank)`` (rank 1-based).

    Score = sum of 1/(k + rank).  Ties keep the reference's insertion order:
    rows of the first list by its rank, then rows first seen in later lists.
    Returns ``query_id, id, score, rank`` plus ``rank_<i>`` per list.
    """
    parts = []
    for i, df in enumerate(ranked_lists):
        parts.append(df.select("query_id", "id", F.col(rank_col).cast("int").alias("_r"),
                               F.lit(i).alias("_list")))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    aggs = [F.sum(F.lit(1.0) / (F.lit(k) + F.col("_r"))).alias("score")]
    aggs += [F.min(F.when(F.col("_list") == i, F.col("_r"))).alias(f"rank_{i}")
             for i in range(len(ranked_lists))]
    fused = allr.groupBy("query_id", "id").agg(*aggs)
    order = [F.col("score").desc()] + [F.col(f"rank_{i}").asc_nulls_last()
                                       for i in range(len(ranked_lists))]
    return top_k(fused, ["query_id"], order, limit, rank_col)


def dedupe_by_id(corpus: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Keep one row per id (the first by ``order_col`` when given)."""
    if order_col is None:
        return corpus.dropDuplicates([id_col])
    w_first = corpus.groupBy(id_col).agg(F.min(order_col).alias("_first"))
    return corpus.join(w_first, id_col).filter(F.col(order_col) == F.col("_first")).drop("_first") \
        .dropDuplicates([id_col])


# ---------------------------------------------------------------------------
# Hybrid search
# ---------------------------------------------------------------------------
def row_key(corpus: DataFrame) -> list[str]:
    """Columns that identify a chunk: its id, and its ordinal where it has
    one (two symbols of one file may share an id)."""
    return ["id", "ordinal"] if "ordinal" in corpus.columns else ["id"]


def hybrid_search(corpus: DataFrame, queries: DataFrame, limit: int = HYBRID_LIMIT,
                  k: int = RRF_K, index: BM25Index | None = None,
                  score_digits: int | None = None) -> DataFrame:
    """Dense top-2·limit + BM25 top-2·limit, fused to ``limit`` per query,
    joined back to the corpus rows.

    ``corpus``: ``id, vector, content`` (+ any columns to return); with an
    ``ordinal`` column ids may repeat, and every chunk is searched, ranked and
    returned for itself (both lists).  A chunk without a valid vector takes
    part in the BM25 list only.  ``queries``: ``query_id, query, vector``.
    An ``index`` given from outside must be keyed by :func:`row_key` (one
    string column ``id``, see below, where ids repeat).
    """
    if len(row_key(corpus)) > 1:
        # orders like (id, ordinal) for ordinals from 0
        row = F.concat_ws("\x01", F.col("id"), F.lpad(F.col("ordinal").cast("string"), 10, "0"))
        corpus = corpus.withColumn("_row", row)
    else:
        corpus = corpus.withColumn("_row", F.col("id"))
    index = index or BM25Index(corpus, "_row", "content")
    dense = knn_topk(queries, corpus, 2 * limit, id_col="_row")
    sparse = bm25_topk(index, queries, 2 * limit, score_digits=score_digits)
    # a known small table: the chunks are not shuffled to meet it
    fused = materialize(rrf_fuse([dense, sparse], limit, k), "fused")
    return fused.withColumnRenamed("id", "_row").join(corpus.drop("vector"), "_row").drop("_row")
