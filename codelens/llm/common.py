"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# White space that separates words, as a Java regular-expression class body.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


# Bytes of one Arrow batch on its way to a Python task: texts differ in length
# by a factor of 10^4, so a bound on rows alone does not bound memory.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most about ``BATCH_BYTES``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def byte_words(text) -> list[bytes]:
    """The same words inside a Python task, A-Z lower-cased, as UTF-8 bytes
    (``bytes.split`` and ``bytes.lower`` act on exactly the ASCII blanks and
    letters)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, i = f"_{stem}", 0
    while name.lower() in taken:
        i += 1
        name = f"_{stem}{i}"
    return name


def attach(df: DataFrame, key: str, extra: DataFrame, how: str = "left") -> DataFrame:
    """Join ``extra`` (its key column is called ``key`` too, one row per key)
    to every row of ``df``; null keys match null keys."""
    k = fresh(df, "attach_key")
    right = extra.withColumnRenamed(key, k)
    return df.join(right, df[key].eqNullSafe(right[k]), how).drop(k)


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without moving the filter below them.

    The optimizer pushes a filter through projections by putting the column
    definitions into it, also into lambdas, where an array would be built
    once per element.  A condition on a non-deterministic column stays."""
    mark = fresh(df, "row_mark")
    return df.withColumn(mark, F.monotonically_increasing_id()) \
        .filter(condition & (F.col(mark) >= 0)).drop(mark)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every vertex of ``(u, v)``, ``v`` the smaller one, either has
    one edge to a smaller vertex or only edges to larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two non-null columns ``a`` and ``b`` of one orderable type.
    Returns ``(id, comp)`` with one row per vertex; ``comp`` is the smallest
    id of its component.

    Alternating large-star and small-star rounds; the smallest neighbour of
    a vertex is a partial aggregate (combined before the shuffle) joined back
    to the edges, so a hub never has to fit into one group.  Each round's
    edges are written to the shared folder, which cuts the lineage.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter(F.col("u") != F.col("v")).distinct(), "edges")
    vertices = e.select(F.col("u").alias("id")).union(e.select(F.col("v").alias("id"))).distinct()
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        # large star: every larger neighbour of x points to the smallest of x's neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")) \
            .select("x", F.least("x", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).filter(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: x and its smaller neighbours point to the smallest of them
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")) \
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("x").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        e = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return vertices.join(e, F.col("id") == F.col("u"), "left") \
        .select("id", F.coalesce("v", "id").alias("comp"))
