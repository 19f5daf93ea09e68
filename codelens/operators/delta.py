"""Incremental processing by content hash.

State is a table ``(path, content_hash)``.  Every step is a join keyed by
path; the anti-join that skips unchanged files is placed *before* any Python
stage (the symbol extractor), because Catalyst cannot push a join through
``mapInPandas``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .search import valid_vector

NEW, CHANGED, UNCHANGED, DELETED = "new", "changed", "unchanged", "deleted"


def with_hash(files: DataFrame, content_col: str = "content", out: str = "content_hash") -> DataFrame:
    """F1 applied to a file table."""
    return files.withColumn(out, tx.content_hash(content_col))


def delta_classify(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``path, status, content_hash, prev_hash`` for the union of paths.

    Equal hash -> unchanged; differing -> changed; only now -> new; only
    before -> deleted.  A null hash on either side counts as changed.
    """
    cur = current.select("path", F.col("content_hash"))
    prev = previous.select("path", F.col("content_hash").alias("prev_hash"))
    j = cur.join(prev, "path", "full_outer")
    status = (F.when(F.col("prev_hash").isNull() & F.col("content_hash").isNotNull(), F.lit(NEW))
              .when(F.col("content_hash").isNull() & F.col("prev_hash").isNotNull(), F.lit(DELETED))
              .when(F.col("content_hash") == F.col("prev_hash"), F.lit(UNCHANGED))
              .otherwise(F.lit(CHANGED)))
    # A current file whose own hash is null is still present: changed.
    return j.withColumn("status", status)


def changed_only(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of ``current`` without an equal (path, hash) before."""
    prev = previous.select("path", "content_hash").filter(F.col("content_hash").isNotNull())
    return current.join(prev, ["path", "content_hash"], "left_anti")


def next_state(current: DataFrame, previous: DataFrame, chunks: DataFrame,
               chunk_path_col: str = "file_path") -> DataFrame:
    """I3 / K4 content: unchanged files keep their hash; processed files with
    at least one chunk take the new hash; failed or chunkless files are left
    out (so they are retried next run); deleted files fall out."""
    prev = previous.select("path", "content_hash")
    unchanged = current.select("path", "content_hash").join(prev, ["path", "content_hash"], "left_semi")
    processed = changed_only(current.select("path", "content_hash"), prev)
    with_chunks = chunks.select(F.col(chunk_path_col).alias("path"))
    produced = processed.join(with_chunks, "path", "left_semi")
    return unchanged.unionByName(produced)


def drop_bad_vectors(chunks: DataFrame, dim: int, vec_col: str = "vector") -> DataFrame:
    """K1 filter: keep rows whose vector is non-null, of length ``dim`` and
    free of null / NaN elements."""
    return chunks.filter(valid_vector(vec_col, dim))


def delete_by_file(chunks: DataFrame, paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    """K2: chunks of files not in ``paths`` (a one-column table of paths)."""
    p = paths.select(F.col(paths.columns[0]).alias(path_col))
    return chunks.join(p, path_col, "left_anti")


def upsert_chunks(old: DataFrame, new: DataFrame, deleted_paths: DataFrame | None = None,
                  mode: str = "replace", path_col: str = "file_path") -> DataFrame:
    """K3: replace the chunks of every file present in ``new`` (and drop those
    of ``deleted_paths``), then add ``new``.  ``mode="append_only"`` keeps
    stale rows, as the reference's pipeline does with its delete disabled."""
    if mode == "append_only":
        return old.unionByName(new)
    if mode != "replace":
        raise ValueError(mode)
    gone = new.select(path_col)
    if deleted_paths is not None:
        gone = gone.unionByName(deleted_paths.select(F.col(deleted_paths.columns[0]).alias(path_col)))
    return delete_by_file(old, gone, path_col).unionByName(new)
