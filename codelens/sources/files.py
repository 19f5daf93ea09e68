"""Sources.

All readers return DataFrames with explicit schemas (no inference) and do
their filtering in the scan or right after it.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx
from .bucketed import read_bucketed
from .versioned import latest_version, list_versions


def scan_files(spark: SparkSession, root: str,
               extensions: Iterable[str] = tx.DEFAULT_EXTENSIONS) -> DataFrame:
    """S1 + S2: recursive scan keeping files whose name ends with one of the
    extensions (case-sensitive), classified ``metadata`` / ``source``.

    The extensions go into the scan's ``pathGlobFilter`` (one brace glob), so
    other files are never opened.  Content is decoded as UTF-8 with invalid
    bytes dropped.  ``path`` is relative to ``root``.
    """
    exts = list(extensions)
    glob = "*{" + ",".join(exts) + "}"
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob)
           .load(root))
    root_uri = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*" + _glob_escape(root_uri.lstrip("/")), "")
    raw_text = F.col("content").cast("string")
    # errors="ignore": only files with invalid bytes lose them; a valid file
    # keeps any U+FFFD it really contains.
    content = F.when(F.expr("is_valid_utf8(cast(content as string))"), raw_text) \
        .otherwise(F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "\ufffd", ""))
    out = raw.select(rel.alias("path"), content.alias("content"))
    return out.filter(tx.has_extension("path", exts)).select(
        "path", tx.file_kind("path").alias("kind"), "content")


def _glob_escape(s: str) -> str:
    import re
    return re.escape(s)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON array of {query, expected_file, expected_logic}.

    ``query_id`` is a hash of the whole item, so it is stable across
    recomputation and one question asked of two files stays two items; of
    items equal in every field each counts (their number is hashed too)."""
    if not _exists(spark, path):  # E6: a missing golden set scores zeros
        return empty(spark, schemas.GOLDEN).withColumn("query_id", F.xxhash64("query"))
    df = spark.read.schema(schemas.GOLDEN).option("multiLine", "true").json(path)
    fields = [f.name for f in schemas.GOLDEN.fields]
    same = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n"))
    return same.select(*fields, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")) \
        .select(*fields, F.xxhash64(*fields, "_k").alias("query_id"))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_state(spark: SparkSession, base: str) -> DataFrame:
    """Newest complete version of the hash state; empty when none."""
    path = latest_version(spark, base)
    if path is None:
        return empty(spark, schemas.FILE_STATE)
    return spark.read.schema(schemas.FILE_STATE).parquet(path)


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """S4 import of a JSON object path -> hash."""
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return txt.select(F.explode(m).alias("path", "content_hash"))


def open_vector_table(spark: SparkSession, path: str) -> DataFrame:
    """The vector table with its fixed schema, its current buckets or its
    newest complete version if it is kept in such; empty when absent."""
    if not _exists(spark, path):
        return empty(spark, schemas.VECTOR_TABLE)
    if _exists(spark, f"{path}/manifest"):
        return read_bucketed(spark, path, schemas.VECTOR_TABLE)
    if list_versions(spark, path, complete=False):
        path = latest_version(spark, path)
        if path is None:
            return empty(spark, schemas.VECTOR_TABLE)
    return spark.read.schema(schemas.VECTOR_TABLE).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


# S6 --------------------------------------------------------------------------
_ATTVALUE = T.StructType([T.StructField("_for", T.StringType()), T.StructField("_value", T.StringType())])
_ATTVALUES = T.StructType([T.StructField("attvalue", T.ArrayType(_ATTVALUE))])
_GEXF_NODE = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("_label", T.StringType()),
    T.StructField("attvalues", _ATTVALUES)])
_GEXF_EDGE = T.StructType([
    T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()),
    T.StructField("_id", T.StringType()), T.StructField("_type", T.StringType()),
    T.StructField("attvalues", _ATTVALUES)])
_GEXF_ATTRS = T.StructType([
    T.StructField("_class", T.StringType()),
    T.StructField("attribute", T.ArrayType(T.StructType([
        T.StructField("_id", T.StringType()), T.StructField("_title", T.StringType()),
        T.StructField("_type", T.StringType())])))])

NODE_TITLES = ["type", "name", "doctype", "parent_class", "hook_type"]


def _xml(spark, path, row_tag, schema):
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def _attr_ids(spark, path, cls: str) -> DataFrame:
    a = _xml(spark, path, "attributes", _GEXF_ATTRS).filter(F.col("_class") == cls)
    return a.select(F.inline("attribute")).select(F.col("_id").alias("_for"), F.col("_title").alias("title"))


def _resolve(df: DataFrame, ids: DataFrame, key: str, titles: list[str]) -> DataFrame:
    """Attribute ids are per file: resolve them by title, then pivot."""
    vals = df.select(key, F.inline_outer("attvalues.attvalue"))
    named = vals.join(F.broadcast(ids), "_for").select(key, "title", "_value")
    return named.groupBy(key).pivot("title", titles).agg(F.first("_value"))


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a GEXF 1.2 file with the built-in XML source.

    The attribute declarations hold a few rows per file, so broadcasting them
    is bounded.  Missing attributes come back null.
    """
    nodes_raw = _xml(spark, path, "node", _GEXF_NODE)
    edges_raw = _xml(spark, path, "edge", _GEXF_EDGE)
    node_attrs = _resolve(nodes_raw.withColumnRenamed("_id", "node_id"),
                          _attr_ids(spark, path, "node"), "node_id", NODE_TITLES)
    nodes = nodes_raw.select(F.col("_id").alias("node_id")).join(node_attrs, "node_id", "left")
    edge_attrs = _resolve(edges_raw.withColumnRenamed("_id", "edge_id"),
                          _attr_ids(spark, path, "edge"), "edge_id", ["networkx_key"])
    edges = edges_raw.select(F.col("_id").alias("edge_id"), F.col("_source").alias("src"),
                             F.col("_target").alias("dst"), F.col("_type").alias("type")) \
        .join(edge_attrs, "edge_id", "left") \
        .select("edge_id", "src", "dst", "type", F.col("networkx_key").cast("int").alias("key"))
    return nodes, edges


def read_eval_report(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation report, one JSON array per file or JSON lines (the first
    sign in the files tells which); ``rank`` may be a number or "N/A"."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    array = first is not None and first["value"].lstrip().startswith("[")
    df = spark.read.schema(schemas.EVAL_REPORT_RAW).option("multiLine", str(array).lower()).json(path)
    return df.withColumn("rank", F.expr("try_cast(rank as int)"))
