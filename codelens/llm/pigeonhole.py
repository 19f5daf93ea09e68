"""Components of a similarity graph whose links always share a block key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import components


CHAIN_ROUNDS = 2


def linked_components(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], traits: DataFrame,
                      close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
                      known: DataFrame | None = None, chain_rounds: int = CHAIN_ROUNDS) -> DataFrame:
    """``(id, comp)`` for every id that has a link.

    ``keys`` holds ``(key, id)``; two linked ids have at least one key in
    common.  ``verify`` takes candidate pairs ``(a, b)`` and returns the links
    among them; ``known`` are links that need no check.  ``traits`` has one
    row ``(id, ...)`` per id, and ``close`` is a cheap condition on the traits
    of two ids that holds for every link.

    First, every member of a key's group is paired with the smallest id of the
    group.  Then, for ``chain_rounds`` rounds, the members of groups that still lie in
    several components are put in a pseudo-random order and neighbours from
    different components are paired.  Both give fewer pairs than members, and
    a large group of similar members is one component after them.  Last, the
    members of different components that share a key and are close are
    verified, all of them: pairs inside one component cannot change the
    result, so no link that matters is lost.  (Where ``close`` is as sharp as
    the link itself, the last step needs no chains before it.)"""
    w = Window.partitionBy("key").orderBy("id")
    groups = (keys.select("key", "id", F.first("id").over(w).alias("head"), F.row_number().over(w).alias("r"),
                          F.lead("id", 1).over(w).alias("n1"), F.lead("id", 2).over(w).alias("n2"))
              .filter((F.col("r") > 1) | F.col("n2").isNotNull())
              .select("key", "id", "head", ((F.col("r") > 2) | F.col("n2").isNotNull()
                                            | ((F.col("r") == 2) & F.col("n1").isNotNull())).alias("three")))
    groups = materialize(groups, "pigeonhole-groups")
    star = groups.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    edges = verify(star)
    if known is not None:
        edges = known.union(edges)
    comp = materialize(components(edges), "pigeonhole-components")
    rest = groups.filter("three").select("key", F.col("id").alias("member"))
    for chain in range(chain_rounds + 1):
        placed = rest.join(comp, F.col("member") == F.col("id"), "left") \
            .select("key", "member", F.coalesce("comp", "member").alias("comp"))
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
            .filter("lo != hi").select("key")
        rest = materialize(placed.join(split, "key", "left_semi").distinct(), "pigeonhole-rest")
        if chain == chain_rounds or rest.isEmpty():
            break
        w = Window.partitionBy("key").orderBy(F.xxhash64("member", F.lit(chain)), "member")
        pairs = rest.select(F.lag("member").over(w).alias("p"), "member", F.lag("comp").over(w).alias("cp"), "comp") \
            .filter("cp != comp").select(F.least("p", "member").alias("a"), F.greatest("p", "member").alias("b"))
        more = verify(pairs.distinct())
        rest = rest.select("key", "member")
        if more.isEmpty():
            continue
        edges = edges.union(more)
        comp = materialize(components(edges), "pigeonhole-components")
    if rest.isEmpty():
        return comp
    shown = [c for c in traits.columns if c != "id"]
    full = materialize(rest.join(traits, F.col("member") == F.col("id")).drop("id"), "pigeonhole-members")

    def side(x):
        return full.select(F.col("key"), F.col("member").alias(x), F.col("comp").alias(f"c{x}"),
                           *[F.col(c).alias(f"{x}_{c}") for c in shown])
    near = side("a").join(side("b"), "key").filter(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
        & close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    more = verify(near.select("a", "b").distinct())
    return comp if more.isEmpty() else components(edges.union(more))
