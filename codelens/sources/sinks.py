"""Sinks and table mutation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..operators.graph import MERMAID_HEADER
from .files import NODE_TITLES, _exists
from .versioned import latest_version, mark_complete, next_version, write_next_version


def append_vectors(chunks: DataFrame, path: str, dim: int) -> None:
    """K1: append rows with a valid vector; no uniqueness on ``id``."""
    delta.drop_bad_vectors(chunks, dim).write.mode("append").parquet(path)


def write_state(state: DataFrame, base: str) -> str:
    """K4: full replacement of the hash state as a new version folder."""
    return write_next_version(state.select("path", "content_hash"), base)


def save_graph(nodes: DataFrame, edges: DataFrame, base: str, entity: str) -> str:
    """K5: one new version ``<base>/<entity>/v=<n>`` that holds ``nodes`` and
    ``edges``; it counts only once both are written."""
    root = f"{base.rstrip('/')}/{entity}"
    path = next_version(nodes.sparkSession, root)
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    mark_complete(nodes.sparkSession, path)
    return root


def load_graph(spark: SparkSession, base: str, entity: str):
    """K6: ``(nodes, edges)`` of the newest complete version, or None when the
    entity has no saved graph."""
    path = latest_version(spark, f"{base.rstrip('/')}/{entity}")
    return None if path is None else (spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


# The GEXF 1.2 frame; numbers are the attribute ids.
GEXF_HEAD = """<?xml version='1.0' encoding='utf-8'?>
<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">
  <graph defaultedgetype="directed" mode="static" name="">
    <attributes mode="static" class="edge">
      <attribute id="5" title="networkx_key" type="long" />
    </attributes>
    <attributes mode="static" class="node">
%s
    </attributes>
    <nodes>"""
GEXF_BETWEEN = "    </nodes>\n    <edges>"
GEXF_FOOT = "    </edges>\n  </graph>\n</gexf>"


def _xml_text(column):
    """A value inside a double-quoted XML attribute; characters that XML 1.0
    cannot hold become U+FFFD."""
    out = F.regexp_replace(F.col(column).cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "\uFFFD")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def _attvalues(columns: list[tuple[int, str]]):
    """The attributes that are not null."""
    each = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<attvalue for="{i}" value="'), _xml_text(c), F.lit('" />')))
            for i, c in columns]
    return F.concat(F.lit("<attvalues>"), F.concat_ws("", *each), F.lit("</attvalues>"))


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, ord, line`` rows of one GEXF 1.2 document: frame, nodes by id,
    frame, edges by (src, dst, key, type), frame."""
    spark = nodes.sparkSession
    titles = [(i, c) for i, c in enumerate(NODE_TITLES) if c in nodes.columns]
    declared = "\n".join(f'      <attribute id="{i}" title="{c}" type="string" />' for i, c in titles)
    frame = spark.createDataFrame([(0, "", GEXF_HEAD % declared), (2, "", GEXF_BETWEEN), (4, "", GEXF_FOOT)],
                                  "part int, ord string, line string")
    ident = _xml_text("node_id")
    body = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("ord"), F.concat(
        F.lit('      <node id="'), ident, F.lit('" label="'), ident, F.lit('">'), _attvalues(titles),
        F.lit("</node>")).alias("line"))
    order = F.concat_ws("\x01", "src", "dst", F.lpad(F.col("key").cast("string"), 12, "0"), "type")
    number = F.monotonically_increasing_id().cast("string")
    arcs = edges.select(F.lit(3).alias("part"), order.alias("ord"), F.concat(
        F.lit('      <edge source="'), _xml_text("src"), F.lit('" target="'), _xml_text("dst"), F.lit('" id="'), number,
        F.lit('" type="'), _xml_text("type"), F.lit('">'), _attvalues([(5, "key")]), F.lit("</edge>")).alias("line"))
    return frame.unionByName(body).unionByName(arcs)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K5: the graph as one GEXF file at ``path``, which
    :func:`codelens.sources.files.read_gexf` reads back.

    Tasks render and write the lines, range-partitioned in document order,
    into a folder beside it; their files are then joined as byte streams, so
    neither rows nor files pass through Python or the driver's memory.  The
    document appears under its name only when it is whole."""
    spark = nodes.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop
    parts, whole, target = (hadoop.fs.Path(f"{path}{x}") for x in (".parts", ".joined", ""))
    fs = target.getFileSystem(conf)
    lines = gexf_lines(nodes, edges).repartitionByRange("part", "ord").sortWithinPartitions("part", "ord")
    lines.select("line").write.mode("overwrite").text(f"{path}.parts")
    out = fs.create(whole, True)
    try:
        for name in sorted(s.getPath().getName() for s in fs.listStatus(parts)):
            if name.startswith("part-"):
                hadoop.io.IOUtils.copyBytes(fs.open(hadoop.fs.Path(parts, name)), out, conf, False)
    finally:
        out.close()
    fs.delete(parts, True)
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"cannot rename {whole} to {target}")


# Title and sentence of the diagram document.
MERMAID_TITLE = "### Logic Flow for `%s`\n"
MERMAID_BLURB = "This diagram shows the relationships between files and functions discovered in the repository.\n"


def mermaid_document(lines: DataFrame, entity: str, order_col: str) -> DataFrame:
    """K7 content: title, blurb, fenced block with ``graph TD`` and the
    rendered arrows ordered by ``order_col``: ``part, ord, line`` rows."""
    spark = lines.sparkSession
    head = [(0, 0, MERMAID_TITLE % entity), (0, 1, MERMAID_BLURB), (0, 2, "```mermaid"),
            (0, 3, MERMAID_HEADER)]
    header = spark.createDataFrame(head, "part int, ord long, line string")
    body = lines.select(F.lit(1).alias("part"), F.col(order_col).cast("long").alias("ord"), "line")
    footer = spark.createDataFrame([(2, 0, "```")], "part int, ord long, line string")
    return header.unionByName(body).unionByName(footer)


def write_mermaid(doc: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """K7: range-partition on (part, ord) and sort within partitions; part
    files in name order then read as the document.  ``num_partitions``
    defaults to the session's shuffle partitions; pass 1 only for a small
    subgraph that should land in a single file."""
    n = num_partitions or int(doc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (doc.repartitionByRange(n, "part", "ord").sortWithinPartitions("part", "ord")
     .select("line").write.mode("overwrite").text(path))


def write_eval_report(report: DataFrame, path: str) -> None:
    """K8: the per-query report as JSON lines, one part file per task
    (:func:`codelens.sources.files.read_eval_report` reads them back)."""
    report.write.mode("overwrite").json(path)


def run_log_row(spark: SparkSession, config: dict, metric_frames: list[DataFrame],
                artifacts: dict) -> DataFrame:
    """K9: one run record ``run_id, config, metrics, artifacts``.

    ``metric_frames`` are one-row DataFrames whose numeric columns become
    metric entries; they are unpivoted and folded into one map by a single
    aggregation.  Only artifacts whose path exists are kept.
    """
    longs = [m.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in m.columns]),
        F.array(*[F.col(c).cast("double") for c in m.columns]))).alias("k", "v"))
        for m in metric_frames]
    allm = reduce(lambda a, b: a.unionByName(b), longs)
    kept = {k: v for k, v in artifacts.items() if _exists(spark, v)}
    art = F.create_map(*[x for kv in kept.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) if kept \
        else F.create_map().cast("map<string,string>")
    cfg = F.create_map(*[x for kv in config.items() for x in (F.lit(kv[0]), F.lit(str(kv[1])))])
    return allm.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics")).select(
        F.lit(str(uuid.uuid4())).alias("run_id"), cfg.alias("config"), "metrics", art.alias("artifacts"))


def append_run_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)
