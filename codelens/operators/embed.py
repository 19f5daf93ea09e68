"""Embedding.

The default embedder is native feature hashing, entirely in Catalyst:
tokens are exploded row-locally, each token's bucket is the first 8 hex
digits of its MD5 modulo ``dim``, counts are aggregated per (row, bucket)
with map-side combine, and the vector is L2-normalized.  A trained model
plugs in through :func:`embed_with_model`, an iterator pandas UDF that sees
Arrow batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows.
Results are keyed by row, never matched by position.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .search import valid_vector

__all__ = ["hash_bucket", "hash_embed_long", "hash_embed", "embed_with_model", "valid_vector"]


def hash_bucket(token, dim: int):
    """First 8 hex digits of md5(token) as an unsigned number, mod ``dim``."""
    t = F.col(token) if isinstance(token, str) else token
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hash_embed_long(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """Dense hashed embedding in long form: ``id, dim, value`` for every
    dimension 0..dim-1 (rows without tokens get zeros)."""
    toks = df.select(F.col(id_col).alias("_id"), F.explode_outer(tx.tokenize(text_col)).alias("_t"))
    counts = (toks.withColumn("_b", F.when(F.col("_t").isNotNull(), hash_bucket("_t", dim)))
              .groupBy("_id", "_b").agg(F.count("_t").alias("_n")))
    per_row = counts.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(),
                                                 F.struct("_b", "_n")))).alias("_m"),
        F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    dense = per_row.select("_id", "_norm", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)))).alias("dim", "_c"))
    value = F.when(F.col("_norm") > 0, F.col("_c") / F.col("_norm")).otherwise(F.lit(0.0))
    return dense.select(F.col("_id").alias(id_col), F.col("dim").cast("int"), value.alias("value"))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int,
               out_col: str = "vector") -> DataFrame:
    """Array form ``id, vector array<float>`` of :func:`hash_embed_long`.

    The per-row bucket map is at most ``dim`` entries, so the second
    aggregation is bounded per row whatever the text length.
    """
    toks = df.select(F.col(id_col).alias("_id"), F.explode_outer(tx.tokenize(text_col)).alias("_t"))
    counts = (toks.withColumn("_b", F.when(F.col("_t").isNotNull(), hash_bucket("_t", dim)))
              .groupBy("_id", "_b").agg(F.count("_t").alias("_n")))
    per_row = counts.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(),
                                                 F.struct("_b", "_n")))).alias("_m"),
        F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: (F.when(F.col("_norm") > 0,
                                        F.coalesce(F.element_at("_m", i), F.lit(0)) / F.col("_norm"))
                                 .otherwise(F.lit(0.0))).cast("float"))
    return per_row.select(F.col("_id").alias(id_col), vec.alias(out_col))


# I5 (fixed value): texts per call of an embedding model.
EMBED_BATCH = 64


def embed_with_model(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray],
                     dim: int, out_col: str = "vector", prefix: str | None = None,
                     batch_size: int = EMBED_BATCH) -> DataFrame:
    """Apply a user embedding model to batches of at most ``batch_size`` texts
    (each Arrow batch of a task is cut into such).

    ``model(texts) -> array (len(texts), dim)``.  Rows whose vector has the
    wrong length come back null (dropped later by ``valid_vector``), so one
    bad result never shifts another row's vector.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            vecs = [v for i in range(0, len(texts), batch_size) for v in model(texts[i:i + batch_size])]
            out = [np.asarray(v, dtype=np.float32).tolist() if v is not None and len(v) == dim
                   else None for v in vecs]
            yield pd.Series(out)

    src = F.col(text_col) if prefix is None else F.concat(F.lit(prefix), F.col(text_col))
    return df.withColumn(out_col, _embed(src))
