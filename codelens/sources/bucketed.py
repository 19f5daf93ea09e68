"""Tables cut into hash buckets of a key, of which a run rewrites only those
it touches (SURVEY §2.2 K2/K3 at the size of a whole corpus).

Layout: ``<base>/data/run=<n>/bucket=<b>/*.parquet`` and manifests
``<base>/manifest/v=<n>`` with one row ``(bucket, run)`` per filled bucket.
A run writes its buckets into a folder of its own, then the manifest; the
manifest's marker is what makes the run count.  A run that dies in between
leaves files that no manifest names, and the next run starts from the last
manifest.  Files of untouched buckets are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.delta import upsert_chunks
from .versioned import _fs, latest_version, next_version

# Fixed for the life of a table: rows keep their bucket.
BUCKETS = 256
_MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.StringType())])


def bucket_of(key, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, base: str) -> dict[int, str]:
    """Filled buckets and the run that wrote them: at most ``buckets`` rows."""
    path = latest_version(spark, f"{base}/manifest")
    return {r["bucket"]: r["run"] for r in spark.read.schema(_MANIFEST).parquet(path).collect()} if path else {}


def read_bucketed(spark: SparkSession, base: str, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
    """The table's rows; with ``only``, of those buckets."""
    paths = [f"{base}/data/run={run}/bucket={b}" for b, run in sorted(_current(spark, base).items())
             if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_bucketed(base: str, schema: T.StructType, new: DataFrame, replaced: DataFrame | None = None,
                    path_col: str = "file_path", buckets: int = BUCKETS) -> list[int]:
    """Replace the rows of every ``path_col`` in ``new`` (and drop those of
    the paths in ``replaced``), rewriting only the buckets of these paths.
    Returns the touched buckets.  ``new`` is read twice: pass a written table
    where it is expensive."""
    spark = new.sparkSession
    new = new.select(*[f.name for f in schema.fields])
    gone = new.select(F.col(path_col).alias("p"))
    if replaced is not None:
        gone = gone.union(replaced.select(F.col(replaced.columns[0]).alias("p")))
    touched = {r["b"] for r in gone.select(bucket_of("p", buckets).alias("b")).distinct().collect()}
    if not touched:
        return []
    before = _current(spark, base)
    old = read_bucketed(spark, base, schema, touched)
    rows = upsert_chunks(old, new, gone, path_col=path_col).withColumn("bucket", bucket_of(path_col, buckets))
    manifest = next_version(spark, f"{base}/manifest")
    run = f"{int(manifest.rsplit('=', 1)[1]):06d}"
    while _taken(spark, f"{base}/data/run={run}"):  # left by a run that died before its manifest
        run += "r"
    # together by bucket, a hot bucket cut into several files
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{base}/data/run={run}")
    filled = _filled(spark, f"{base}/data/run={run}")
    now = {**{b: r for b, r in before.items() if b not in touched}, **{b: run for b in filled}}
    spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.parquet(manifest)
    return sorted(touched)


def _taken(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _filled(spark: SparkSession, path: str) -> set[int]:
    """Buckets that a run has written files for."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n[len("bucket="):]) for n in names if n.startswith("bucket=")}
