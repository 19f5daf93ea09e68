"""Keep CPU-heavy row-local work parallel (call on plain scans only).

A scan yields one task per file split / row group.  A corpus stored as a few
large row groups would put all tokenizing or parsing on a few cores, so
before such work the rows are spread round-robin -- but only when the input
has fewer partitions than the session's parallelism.  On a cluster reading
many files the scan already has thousands of splits and this is a no-op, so
no extra shuffle is added at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, keys: list[str], min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition on ``keys`` to the session's parallelism when the
    input has fewer partitions.

    Hash (not round-robin) partitioning: round-robin sorts every input
    partition first to stay deterministic on retry, which is costly for one
    big split.  It also satisfies a following aggregation keyed by (a
    superset of) the keys, so that aggregation needs no second shuffle.

    Call it on a plain scan: for a DataFrame that already contains a shuffle,
    asking for its partition count makes adaptive execution run that shuffle
    eagerly.  The operators therefore never call it themselves; callers that
    hold a scan (the stand-in views, a stored vector table) do.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, *keys)
    return df
