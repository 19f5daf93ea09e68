"""BM25 index kept up to date run by run.

Every run writes what it adds and what it retires, never the whole index:

* ``docs(id, path, dl)`` and ``postings(id, term, tf, dl)`` of new and changed
  files,
* ``retired(id)``: documents of earlier runs whose file changed or went away,
* ``terms(term, df)``: how each document frequency moves, up or down,
* ``totals(n_docs, length)``: how the corpus totals move.

A document of run r counts until a later run retires its id.  Document
frequencies and totals are sums over the runs.  ``compact`` writes the living
rows as one run, from which readers start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from ..sources.versioned import list_versions, mark_complete, next_version
from .delta import CHANGED, DELETED, NEW
from .search import BM25Index

_TABLES = {"docs": "id {id}, path string, dl long", "postings": "id {id}, term string, tf long, dl int",
           "retired": "id {id}", "terms": "term string, df long", "totals": "n_docs long, length long, whole boolean"}


class IndexRuns:
    """The runs under ``base``, a shared folder; ids are of type ``id_type``."""

    def __init__(self, spark: SparkSession, base: str, id_type: str = "string") -> None:
        self.spark, self.base, self.id_type = spark, base.rstrip("/"), id_type

    def _paths(self) -> list[tuple[int, str]]:
        """Complete runs, from the last compacted one on."""
        runs = [(v, f"{self.base}/v={v:06d}") for v in list_versions(self.spark, self.base)]
        if not runs:
            return []
        whole = self._read("totals", runs).filter("whole").agg(F.max("run")).first()[0]
        return [r for r in runs if whole is None or r[0] >= whole]

    def _read(self, table: str, runs: list[tuple[int, str]]) -> DataFrame:
        schema = _TABLES[table].format(id=self.id_type)
        parts = [self.spark.read.schema(schema).parquet(f"{p}/{table}").withColumn("run", F.lit(v)) for v, p in runs]
        return reduce(DataFrame.unionByName, parts) if parts else \
            self.spark.createDataFrame([], schema).withColumn("run", F.lit(0))

    def _living(self, table: str, runs: list[tuple[int, str]]) -> DataFrame:
        """Rows that no later run retires.  Ids retired in any run are few
        against the corpus, but not bounded: an ordinary join."""
        ends = self._read("retired", runs).groupBy(F.col("id").alias("_id")).agg(F.max("run").alias("_end"))
        rows = self._read(table, runs)
        return rows.join(ends, F.col("id") == F.col("_id"), "left") \
            .filter(F.col("_end").isNull() | (F.col("run") >= F.col("_end"))).drop("_id", "_end", "run")

    def update(self, classified: DataFrame, docs: DataFrame) -> str:
        """One run.  ``classified(path, status)`` as
        :func:`codelens.operators.delta.delta_classify` gives it; ``docs(id,
        path, content)``, of which only new and changed files are read."""
        runs, path = self._paths(), next_version(self.spark, self.base)
        status = lambda *wanted: classified.filter(F.col("status").isin(*wanted)).select("path")
        add = docs.select(F.col("id").cast(self.id_type).alias("id"), "path", "content").join(status(NEW, CHANGED), "path", "left_semi")
        tokens = materialize(add.select("id", "path", tx.tokenize("content").alias("t")), "index-tokens")
        length = F.coalesce(F.size("t"), F.lit(0))
        tokens.select("id", "path", length.cast("long").alias("dl")).write.parquet(f"{path}/docs")
        tokens.select("id", length.alias("dl"), F.explode_outer("t").alias("term")).groupBy("id", "term", "dl") \
            .agg(F.count("term").alias("tf")).select("id", "term", "tf", "dl").write.parquet(f"{path}/postings")
        # a new file may be known to the index: its last run may have died
        # between this index and the state
        out = self._living("docs", runs).join(status(NEW, CHANGED, DELETED), "path", "left_semi")
        out.select("id").distinct().write.parquet(f"{path}/retired")
        retired = self.spark.read.parquet(f"{path}/retired")
        added = self._read("postings", [(0, path)]).filter("term IS NOT NULL").select("term", F.lit(1).alias("df"))
        lost = self._living("postings", runs).filter("term IS NOT NULL").join(retired, "id", "left_semi") \
            .select("term", F.lit(-1).alias("df"))
        added.union(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0").write.parquet(f"{path}/terms")
        self._totals(self._read("docs", [(0, path)]).select("dl", F.lit(1).alias("sign"))
                     .union(out.select("dl", F.lit(-1)))).write.parquet(f"{path}/totals")
        mark_complete(self.spark, path)
        return path

    @staticmethod
    def _totals(rows: DataFrame, whole: bool = False) -> DataFrame:
        return rows.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n_docs"),
                        F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).cast("long").alias("length"),
                        F.lit(whole).alias("whole"))

    def compact(self) -> str:
        """All living rows as one run; earlier runs are no longer read."""
        runs, path = self._paths(), next_version(self.spark, self.base)
        docs = self._living("docs", runs)
        docs.write.parquet(f"{path}/docs")
        self._living("postings", runs).write.parquet(f"{path}/postings")
        self._read("retired", []).select("id").write.parquet(f"{path}/retired")
        self._terms(runs).write.parquet(f"{path}/terms")
        self._totals(docs.select("dl", F.lit(1).alias("sign")), True).write.parquet(f"{path}/totals")
        mark_complete(self.spark, path)
        return path

    def _terms(self, runs: list[tuple[int, str]]) -> DataFrame:
        return self._read("terms", runs).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def index(self) -> BM25Index:
        """The index of all living documents; no text is read."""
        runs = self._paths()
        totals = self._read("totals", runs).agg(F.sum("n_docs"), F.sum("length")).first()
        return BM25Index.of_tables(self._living("postings", runs), self._living("docs", runs).select("id", "dl"),
                                   self._terms(runs), int(totals[0] or 0), int(totals[1] or 0))
