"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed pseudo-random position (60 bits of the MD5 of its
id).  Word counts are summed by source and hash bucket; the running sums show
in which bucket a source's budget ends, only that bucket is cut finer, and the
result is one threshold per source.  Documents below it are taken: a filter,
no sort, the same on every run, and a larger budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..session import materialize
from .common import fresh, word_count

HASH_BITS = 60
DIGIT_BITS = 12


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, pos): words and hash position of each row."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(text_id), 1, HASH_BITS // 4), 16, 10).cast("long").alias("pos"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) for sources ``(source, source_size)``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share the total.  A target stops at ``cap`` times its source; the excess
    is shared by weight among the others until none is above: the rounds
    below only exchange three sums with the driver.
    """
    ranked = global_position(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    s = materialize(ranked.select("source", "source_size", weight.cast("long").alias("_w")), "mix-sources")
    level, before = 0.0, None
    while level != before:
        full = F.col("source_size") * cap < F.col("_w") * F.lit(level)
        total, held, open_w = s.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("_w")))).first()
        before, level = level, (((total or 0) - (held or 0)) / open_w if open_w else level)
    return s.select("source", "source_size", F.least(
        (F.col("source_size") * cap).cast("double"), F.col("_w") * F.lit(float(level))).alias("target"))


def _prefix(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source of ``budgets (source, budget)``: ``(source, stop, spent)``,
    the largest ``stop`` such that the rows with ``pos < stop`` hold at most
    the budget, and what they hold.

    Two histogram levels of 4096 buckets narrow the end of the budget down to
    2^-24 of the source; the rows of that bucket are summed by exact position.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("base"), F.lit(0.0).alias("spent"))
    shift = HASH_BITS
    for level in range(3):
        width = shift - DIGIT_BITS if level < 2 else 0
        st = materialize(state, "mix-level").withColumnRenamed("source", "_s")
        inside = rows.join(st, F.col("source").eqNullSafe(F.col("_s"))) \
            .filter(F.shiftright("pos", shift) == F.shiftright("base", shift))
        # the bucket's first position: the lower bits are cleared
        hist = inside.groupBy("source", F.shiftleft(F.shiftright("pos", width), width).alias("start")) \
            .agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("spent").alias("spent0"))
        w = Window.partitionBy("source").orderBy("start")
        run = hist.withColumn("cum", F.col("spent0") + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bucket that no longer fits is where the budget ends
        over = run.filter(F.col("cum") > F.col("budget")).groupBy("source") \
            .agg(F.min("start").alias("cut"), F.min(F.struct("start", (F.col("cum") - F.col("n")).alias("v")))
                 .getField("v").alias("at_cut")).withColumnRenamed("source", "_o")
        total = run.groupBy("source").agg(F.max("cum").alias("all_in")).withColumnRenamed("source", "_t")
        end = F.shiftleft(F.shiftright("base", shift) + 1, shift)
        state = (st.join(over, F.col("_s").eqNullSafe(F.col("_o")), "left")
                 .join(total, F.col("_s").eqNullSafe(F.col("_t")), "left")
                 .select(F.col("_s").alias("source"), "budget",
                         F.coalesce("cut", end).alias("base"),
                         F.coalesce("at_cut", "all_in", "spent").cast("double").alias("spent")))
        shift = width
    return materialize(state.select("source", F.col("base").alias("stop"), "spent"), "mix-stops")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``
    plus ``source`` and ``copies``.

    A source with target ``t`` and size ``s`` takes every document
    ``floor(t/s)`` times; the rest of ``t`` is a word budget.  The budget is
    spent along the hash order up to a first threshold; documents behind it
    that still fit into what is left are taken up to a second one, so that a
    single long document at the boundary does not leave the budget unspent.

    Null text has size 0, a null source is a source of its own, rows that
    repeat an id are separate documents with one common position (taken
    together), an empty table gives no rows.
    """
    rows = materialize(sized(docs.select("doc_id", "source", "text")), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(per_source, weights, cap)
    plan = materialize(t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    first = _prefix(rows, plan.select("source", "budget")) \
        .select(F.col("source").alias("_f"), F.col("stop").alias("stop1"), "spent")
    plan = plan.join(first, F.col("source").eqNullSafe(F.col("_f"))).drop("_f") \
        .withColumn("left", F.col("budget") - F.col("spent"))
    plan = materialize(plan, "mix-plan")
    p = plan.select(F.col("source").alias("_p"), "stop1", "left")
    small = rows.join(p, F.col("source").eqNullSafe(F.col("_p"))) \
        .filter((F.col("pos") >= F.col("stop1")) & (F.col("size") <= F.col("left"))).select("source", "pos", "size")
    second = _prefix(materialize(small, "mix-small"), plan.select("source", F.col("left").alias("budget"))) \
        .select(F.col("source").alias("_f"), F.col("stop").alias("stop2"))
    plan = plan.join(second, F.col("source").eqNullSafe(F.col("_f"))).drop("_f") \
        .withColumnRenamed("source", "_p")
    extra = (F.col("pos") < F.col("stop1")) | ((F.col("size") <= F.col("left")) & (F.col("pos") < F.col("stop2")))
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_p")))
            .withColumn("copies", F.col("whole") + extra.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents that the mix takes, all columns kept, with their number
    of copies in a new column ``copies`` (``_copies``, ... if that name is
    used).  A row without words carries no weight and is not taken."""
    out = "copies" if "copies" not in {c.lower() for c in docs.columns} else fresh(docs, "copies")
    key, n = fresh(docs, "mix_id"), fresh(docs, "mix_copies")
    chosen = mix(docs, weights, cap).filter("taken > 0") \
        .groupBy(F.col("doc_id").alias(key), F.col("source").alias(f"{key}_source"),
                 F.col("size").alias(f"{key}_size")).agg(F.max("copies").alias(n))
    joined = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col(key))
                       & docs["source"].cast("string").eqNullSafe(F.col(f"{key}_source"))
                       & (word_count(docs["text"]) == F.col(f"{key}_size")))
    return joined.select(*[docs[c] for c in docs.columns], F.col(n).alias(out))
