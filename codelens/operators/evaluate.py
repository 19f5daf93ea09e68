"""Retrieval evaluation as set-based jobs.

The reference loops over golden queries one by one; here one join and two
aggregations answer all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize

# Rationale of a failed judgement and rank text when not found.
JUDGE_FAILED_RATIONALE = "Judge failed"
NOT_FOUND_RANK = "N/A"


# E1 ------------------------------------------------------------------------
def first_relevant_rank(hits: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """Smallest rank <= k whose normalized path contains the normalized
    expected path; null when none.

    ``hits(query_id, rank, file_path)``, ``golden(query_id, expected_file)``
    -> ``query_id, rank``.  The containment test is a residual predicate on
    an equi-join by query id (k rows per query), not a theta join over all
    pairs.
    """
    g = golden.select("query_id", tx.normalize_path("expected_file").alias("_exp"))
    h = hits.filter(F.col("rank") <= k).select("query_id", "rank", tx.normalize_path("file_path").alias("_act"))
    matched = h.join(g, "query_id").filter(F.col("_act").contains(F.col("_exp"))) \
        .groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.select("query_id").join(matched, "query_id", "left")


# E2 / E3 / E6 --------------------------------------------------------------
def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """One row: ``n_queries, hit_rate (percent), mrr``; zeros when empty."""
    n = F.count(F.lit(1))
    return ranks.agg(
        n.alias("n_queries"),
        F.coalesce(F.try_divide(F.count("rank") * F.lit(100.0), n), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


# E4 ------------------------------------------------------------------------
def judge_averages(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean accuracy and completeness over all queries; a missing or failed
    judgement counts as 0."""
    j = queries.select("query_id").join(scores, "query_id", "left")
    return j.agg(
        F.coalesce(F.avg(F.coalesce(F.col("accuracy"), F.lit(0)).cast("double")), F.lit(0.0)).alias("avg_accuracy"),
        F.coalesce(F.avg(F.coalesce(F.col("completeness"), F.lit(0)).cast("double")), F.lit(0.0))
        .alias("avg_completeness"))


# E6 ------------------------------------------------------------------------
def benchmark_summary(ranks: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for the whole benchmark: ``n_queries, hit_rate, mrr,
    avg_accuracy, avg_completeness`` over the queries of ``ranks`` (both sides
    of the join are one-row aggregates).  The ranks are read twice, so they
    are written once: the search behind them runs once."""
    ranks = materialize(ranks.select("query_id", "rank"), "ranks")
    return retrieval_metrics(ranks).crossJoin(judge_averages(ranks.select("query_id"), scores))


# E5 ------------------------------------------------------------------------
def eval_report(ranks: DataFrame, scores: DataFrame, latencies: DataFrame | None = None,
                golden: DataFrame | None = None) -> DataFrame:
    """Per query: its text (``query``, when ``golden`` has it), ``found``, ``rank`` (null when not found), ``rank_text``
    (``N/A`` when not found), latencies when given, and the judge struct
    (a missing judgement becomes 0 / 0 / "Judge failed")."""
    df = ranks.join(scores, "query_id", "left")
    if latencies is not None:
        df = df.join(latencies, "query_id", "left")
    if golden is not None and "query" in golden.columns:
        df = df.join(golden.select("query_id", "query"), "query_id", "left")
    missing = F.col("accuracy").isNull() & F.col("completeness").isNull()
    rationale = F.col("rationale") if "rationale" in df.columns else F.lit(None).cast("string")
    return df.select(
        "query_id", *([c for c in ("query",) if c in df.columns]),
        F.col("rank").isNotNull().alias("found"),
        F.col("rank"),
        F.coalesce(F.col("rank").cast("string"), F.lit(NOT_FOUND_RANK)).alias("rank_text"),
        *([c for c in ("retrieval_latency", "generation_latency") if c in df.columns]),
        F.struct(F.coalesce("accuracy", F.lit(0)).alias("accuracy"),
                 F.coalesce("completeness", F.lit(0)).alias("completeness"),
                 F.when(missing, F.lit(JUDGE_FAILED_RATIONALE)).otherwise(rationale).alias("rationale"))
        .alias("scores"))


# E7 ------------------------------------------------------------------------
def parity_compare(expected: DataFrame, actual: DataFrame, key: str, outcome: str = "outcome") -> DataFrame:
    """Per (expected, actual) outcome pair: count and match flag."""
    e = expected.select(key, F.col(outcome).alias("expected"))
    a = actual.select(key, F.col(outcome).alias("actual"))
    j = e.join(a, key, "full_outer")
    return (j.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("match", F.col("expected").eqNullSafe(F.col("actual"))))
