"""Symbol graph kept up to date run by run.

A call is resolved by the simple name it names, so a changed file moves only
edges of names that it defines or calls, now or before.  The store holds, cut
into buckets (:mod:`codelens.sources.bucketed`):

* by name: ``symbols`` (definitions), ``sites`` (call sites with their
  caller) and ``calls`` (resolved edges),
* by file: ``nodes``, ``contains`` and ``names`` (what a file defines or calls).

A run resolves the touched names again and rewrites their buckets; all other
buckets keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import scratch
from ..sources.bucketed import bucket_of, read_bucketed, upsert_bucketed
from .graph import NODE_ATTRS, build_nodes, edge_keys, resolve_calls, symbol_table
from .symbols import graph_rows


def _schema(columns: str) -> T.StructType:
    types = {"ordinal": T.IntegerType()}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in columns.split()])


_BY_NAME = {"symbols": _schema("name node_id file_path ordinal"),
            "sites": _schema("name caller_id raw_callee file_path ordinal"),
            "calls": _schema("name src dst type file_path ordinal")}
_BY_FILE = {"nodes": _schema("file_path node_id ordinal " + " ".join(NODE_ATTRS)),
            "contains": _schema("file_path src dst type ordinal"),
            "names": _schema("file_path name")}


class GraphRuns:
    """The graph under ``base``, a shared folder."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def table(self, name: str, only: set[int] | None = None) -> DataFrame:
        return read_bucketed(self.spark, f"{self.base}/{name}", {**_BY_NAME, **_BY_FILE}[name], only)

    def update(self, extracted: DataFrame, replaced: DataFrame, source_suffix: str = ".py") -> dict[str, list[int]]:
        """One run: ``extracted`` are the symbol rows of new and changed
        files, ``replaced`` (one column) the paths whose earlier rows go.
        Returns the touched buckets of every table."""
        with scratch(self.spark) as keep:
            return self._update(keep, extracted, replaced, source_suffix)

    def _update(self, keep, extracted: DataFrame, replaced: DataFrame, source_suffix: str) -> dict[str, list[int]]:
        ex = keep(extracted.filter(F.col("file_path").endswith(source_suffix)), "graph-extract")
        gone = keep(replaced.select(F.col(replaced.columns[0]).alias("file_path"))
                    .union(ex.select("file_path")).distinct(), "graph-replaced")
        rows = graph_rows(ex)
        sym = rows.filter(F.col("kind") == "symbol")
        # the first node of a file (in order) that is named like the enclosing function
        callers = sym.groupBy("file_path", "name").agg(F.min_by("node_id", F.col("ordinal")).alias("caller_id"))
        sites = keep(ex.filter(F.col("kind") == "call").join(callers, ["file_path", "name"]).select(
            tx.simple_name("raw_callee").alias("name"), "caller_id", "raw_callee", "file_path", "ordinal"), "graph-sites")
        symbols = keep(sym.select("name", "node_id", "file_path", "ordinal"), "graph-symbols")
        names = symbols.select("file_path", "name").union(sites.select("file_path", "name")).distinct()
        file_buckets = self._buckets(gone, "file_path")
        before = self.table("names", file_buckets).join(gone, "file_path", "left_semi")
        touched = keep(names.select("name").union(before.select("name")).filter(F.col("name").isNotNull()).distinct(),
                       "graph-touched")
        only = self._buckets(touched, "name")

        def renewed(table: str, new: DataFrame) -> DataFrame:
            """All rows of the touched names after this run."""
            old = self.table(table, only).join(touched, "name", "left_semi").join(gone, "file_path", "left_anti")
            return keep(old.unionByName(new), f"graph-{table}")
        symbols, sites = renewed("symbols", symbols), renewed("sites", sites)
        winners = symbol_table(symbols.select("name", "node_id", F.struct("file_path", "ordinal").alias("_ord")), ["_ord"])
        calls = resolve_calls(sites, winners)
        new = {"symbols": symbols, "sites": sites, "calls": keep(calls, "graph-calls"),
               "nodes": rows.select("file_path", "node_id", "ordinal", *NODE_ATTRS),
               "contains": sym.select("file_path", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"),
                                      F.lit("CONTAINS").alias("type"), "ordinal"),
               "names": names}
        return {t: upsert_bucketed(f"{self.base}/{t}", schema, new[t], touched if t in _BY_NAME else gone,
                                   "name" if t in _BY_NAME else "file_path")
                for t, schema in {**_BY_FILE, **_BY_NAME}.items()}

    def _buckets(self, keys: DataFrame, column: str) -> set[int]:
        return {r["b"] for r in keys.select(bucket_of(column).alias("b")).distinct().collect()}

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """``(nodes, edges)`` as :func:`codelens.operators.symbols.build_graph`
        gives them for all files; nothing is resolved here, only parallel
        edges are numbered."""
        nodes = build_nodes(self.table("nodes").withColumn("_ord", F.struct("file_path", "ordinal")), "_ord")
        contains = self.table("contains").withColumn("_phase", F.lit(0))
        calls = self.table("calls").drop("name").withColumn("_phase", F.lit(1))
        edges = edge_keys(contains.unionByName(calls), ["_phase", "file_path", "ordinal"])
        return nodes, edges.select("src", "dst", "type", "key")
