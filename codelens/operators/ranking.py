"""Positions and top-k that hold up when one group holds a third of the rows.

``row_number() over (partition by g ...)`` sends a whole group to one task.
For unbounded groups we instead range-partition on (group, order) keys, so a
hot group is cut across many tasks, number rows locally and add per-partition
offsets.  The offsets table has at most (partitions x groups-in-partition)
rows and is itself aggregated with map-side combine.

Range bounds are sampled per plan branch, so two branches over the same
``repartitionByRange`` may see different partitionings.  The partition id and
the in-partition sequence number are therefore computed once, in the job that
writes the range-sorted rows as Parquet under the shared checkpoint folder
(:func:`codelens.session.materialize`); the counting branch and the
numbering branch both read those files, so positions are consistent and a
lost executor never changes one.

For top-k (k small) plain ``row_number() <= k`` is used on purpose: Catalyst
plans a partial ``WindowGroupLimit`` before the shuffle, so at most k rows
per group leave each map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _n_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_position(df: DataFrame, order_cols: list, out: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order_cols``.

    One range shuffle; the per-partition counts table has exactly one row per
    partition, so broadcasting it is size-bounded by the partition count.
    """
    n = _n_partitions(df, num_partitions)
    ranged = materialize(df.repartitionByRange(n, *order_cols)
                         .sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_pid", "_first", F.coalesce("_off", F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_off", "_first"))


# A group is hot when it holds more rows than one task should number,
# whatever the size of the table.
HOT_MIN_ROWS = 1 << 20


def position_within(df: DataFrame, group_cols: list[str], order_cols: list,
                    out: str = "pos", num_partitions: int | None = None,
                    hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """0-based ``row_number`` within each group, safe for hot groups.

    The input is written once; group sizes are counted with map-side
    combine.  Ordinary groups (bounded by the hot threshold) are numbered by
    a plain window; hot groups go through :func:`_ranged_positions`, which
    cuts each of them across many tasks.  Rows equal on every order column
    get distinct positions in arbitrary order, exactly as ``row_number``
    would give them.
    """
    base = materialize(df, "grouped")
    hot = (base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > hot_min_rows).drop("_n"))
    hot = materialize(hot, "hot-groups")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    if hot.isEmpty():
        return base.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    keys = hot.select([F.col(c).alias(f"_h_{c}") for c in group_cols]).withColumn("_hot", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in group_cols])
    tagged = base.join(keys, cond, "left").drop(*[f"_h_{c}" for c in group_cols])
    cold = tagged.filter(F.col("_hot").isNull()).drop("_hot") \
        .withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    hot_rows = tagged.filter(F.col("_hot")).drop("_hot")
    return cold.unionByName(_ranged_positions(hot_rows, group_cols, order_cols, out, num_partitions))


def _ranged_positions(df: DataFrame, group_cols: list[str], order_cols: list,
                      out: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Positions by range partitioning on (group, order) keys plus
    per-partition offsets: a hot group is numbered by many tasks."""
    n = _n_partitions(df, num_partitions)
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    ranged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    stats = ranged.groupBy("_pid", *group_cols).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    s = stats.alias("_s")
    r = ranged.alias("_r")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_r.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in group_cols],
                  F.col("_r._pid") == F.col("_s._pid"))
    joined = r.join(s, cond).select(
        "_r.*", (F.col("_s._off") + F.col("_r._mid") - F.col("_s._first")).alias(out))
    return joined.drop("_pid", "_mid")


def top_k(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Rows with ``row_number() <= k`` per group, rank 1-based (int)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))
