"""Symbol graph as two tables.

``nodes(node_id, type, name, doctype, parent_class, hook_type)`` and
``edges(src, dst, type, key)``.  Construction is joins and aggregations;
traversal is an iterated join with a visited anti-join, lineage cut with
``checkpoint()`` into the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ensure_checkpoint_dir, materialize
from .ranking import position_within

NODE_ATTRS = ["type", "name", "doctype", "parent_class", "hook_type"]


# G1 ------------------------------------------------------------------------
def build_nodes(rows: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """One node per id; the attributes of the last row (highest
    ``order_col``) win.  ``max_by`` aggregates with map-side combine."""
    attrs = [c for c in NODE_ATTRS if c in rows.columns]
    packed = F.struct(*[F.col(c) for c in attrs])
    out = rows.groupBy("node_id").agg(F.max_by(packed, F.col(order_col)).alias("_a"))
    return out.select("node_id", *[F.col("_a")[c].alias(c) for c in attrs])


# G2 ------------------------------------------------------------------------
def parent_of(node_id, name):
    """Container id: the node id without its trailing ``:name``."""
    nid = F.col(node_id) if isinstance(node_id, str) else node_id
    nm = F.col(name) if isinstance(name, str) else name
    return F.substring(nid, F.lit(1), F.length(nid) - F.length(nm) - 1)


def contains_edges(nodes: DataFrame) -> DataFrame:
    """CONTAINS edge from each non-file node to its container; repeats stay
    parallel edges."""
    return (nodes.filter(F.col("type") != "file")
            .select(parent_of("node_id", "name").alias("src"), F.col("node_id").alias("dst"),
                    F.lit("CONTAINS").alias("type")))


# G3 ------------------------------------------------------------------------
def symbol_table(defs: DataFrame, order_cols: list[str] = ("ordinal",)) -> DataFrame:
    """simple name -> node id, last definition (highest order key) wins."""
    key = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    return defs.groupBy("name").agg(F.max_by("node_id", key).alias("node_id"))


# G4 / G5 -------------------------------------------------------------------
def resolve_calls(sites: DataFrame, symbols: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One CALLS edge per call site whose simple callee name is in the symbol
    table; unresolved sites drop.  With ``nodes``, both ends must exist.

    ``sites(caller_id, raw_callee, ...)`` -> ``src, dst, type, ...``.  The
    equi-join on name is where hot names concentrate; AQE's skew-join split
    handles a name called from a third of all sites.
    """
    s = sites.withColumn("_name", tx.simple_name("raw_callee"))
    t = symbols.select(F.col("name").alias("_name"), F.col("node_id").alias("dst"))
    e = s.join(t, "_name").withColumnRenamed("caller_id", "src").drop("_name", "raw_callee") \
        .withColumn("type", F.lit("CALLS"))
    if nodes is not None:
        ids = nodes.select("node_id")
        e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi") \
             .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return e


# G6 ------------------------------------------------------------------------
def edge_keys(edges: DataFrame, order_cols: list) -> DataFrame:
    """Parallel-edge key 0,1,2... per (src, dst) over all edge types.

    Uses :func:`position_within`, so one (src, dst) pair holding a third of
    all edges is still numbered by many tasks.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    out = position_within(edges, ["src", "dst"], cols, out="key")
    return out.withColumn("key", F.col("key").cast("int"))


# G7 / G8 -------------------------------------------------------------------
def select_nodes(nodes: DataFrame, entity: str, id_col: str = "node_id") -> DataFrame:
    """Nodes whose normalized id contains the entity or its snake case."""
    nid = tx.normalize_path(id_col)
    return nodes.filter(nid.contains(F.lower(F.lit(entity))) | nid.contains(tx.snake_case(F.lit(entity))))


def induced_subgraph(edges: DataFrame, selected: DataFrame, id_col: str = "node_id") -> DataFrame:
    """Edges with both ends selected (two semi joins)."""
    ids = selected.select(id_col)
    return edges.join(ids.withColumnRenamed(id_col, "src"), "src", "left_semi") \
        .join(ids.withColumnRenamed(id_col, "dst"), "dst", "left_semi")


# G9 ------------------------------------------------------------------------
# Edges of one task that looks for equal ones: it holds their names.
EDGE_TASK_ROWS = 1 << 19


def _dealt(edges: DataFrame, rows: int | None) -> DataFrame:
    """``edges`` dealt by ``(src, dst)`` to tasks of about ``EDGE_TASK_ROWS``
    where there are more of them (``rows``, None: not known).  Otherwise a
    task collects the distinct names of a whole split of the input, whose
    rows are few bytes on disk and many in memory.  Rows of one hot pair
    stream through one task, which holds the pair once."""
    if rows is None or rows <= EDGE_TASK_ROWS:
        return edges
    return edges.repartition(-(-rows // EDGE_TASK_ROWS), "src", "dst")


def simple_edges(edges: DataFrame, order_col: str | None = None, rows: int | None = None) -> DataFrame:
    """Parallel edges collapsed; edge type ignored.  With ``order_col`` the
    first occurrence's value is kept (for output order).  ``rows`` is about
    how many edges there are (sizes the tasks)."""
    edges = _dealt(edges.select("src", "dst", *([order_col] if order_col else [])), rows)
    if order_col is None:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(F.min(order_col).alias(order_col))


# G10 / K7 ------------------------------------------------------------------
# Diagram header and arrow format.
MERMAID_HEADER = "graph TD"
ARROW_FORMAT = '    %s["%s"] --> %s["%s"]'


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """One rendered arrow per (already simple) edge: ``src, dst, line``."""
    line = F.format_string(ARROW_FORMAT, tx.mermaid_id("src"), tx.node_label("src"),
                           tx.mermaid_id("dst"), tx.node_label("dst"))
    return edges.select("src", "dst", line.alias("line"), *[c for c in edges.columns
                                                           if c not in ("src", "dst")])


# G11 -----------------------------------------------------------------------
def _adjacency(edges: DataFrame, direction: str, rows: int | None = None) -> DataFrame:
    """Distinct ``(_from, _to)`` to follow."""
    edges = _dealt(edges.select("src", "dst"), rows)
    down = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    up = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
    if direction not in ("down", "up", "both"):
        raise ValueError(direction)
    return (down.unionByName(up) if direction == "both" else down if direction == "down" else up).distinct()


def khop_neighbors(edges: DataFrame, seeds: DataFrame, k: int, direction: str = "down", rows: int | None = None) -> DataFrame:
    """Nodes within k hops of the seeds: ``node_id, depth`` (min depth; seeds
    at 0).  ``direction`` is ``down`` (follow src->dst), ``up`` or ``both``;
    ``rows`` is about how many edges there are (sizes the tasks).

    The distinct adjacency is written once as Parquet under the shared
    checkpoint folder; each round joins the frontier to it and anti-joins the
    visited set.  The new frontier of every round is written there too, so the
    plan of a round holds two joins whatever its number.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    # The adjacency is read once per round: materialize it once.
    adj = materialize(_adjacency(edges, direction, rows), "adjacency")
    visited = seeds.select(F.col("node_id")).distinct().withColumn("depth", F.lit(0))
    frontier = visited.select("node_id")
    for d in range(1, k + 1):
        nxt = (frontier.join(adj, frontier.node_id == adj._from)
               .select(F.col("_to").alias("node_id")).distinct()
               .join(visited.select("node_id"), "node_id", "left_anti"))
        frontier = materialize(nxt, "frontier")
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(d)))
    return visited


WORD_BITS = 64


def khop_by_seed(edges: DataFrame, seeds: DataFrame, k: int, direction: str = "down", rows: int | None = None) -> DataFrame:
    """Nodes within k hops of each seed: ``seed_id, node_id, depth, previous``
    (min depth; ``previous`` is the smallest node one hop nearer to the seed,
    null at depth 0).  ``direction`` and ``rows`` are as in
    ``khop_neighbors``.

    All seeds walk together: 64 of them share a word, and a frontier row
    ``(node_id, word, bits)`` says which of these have just reached the node.
    A round joins the frontier to the adjacency once, unites the bits per node
    in the map tasks and takes off what was reached before, so its joins and
    its plan do not grow with the number of seeds.  Seeds that repeat or are
    null count once or not at all; a seed without edges reaches itself."""
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    adj = materialize(_adjacency(edges, direction, rows), "adjacency")
    number = F.monotonically_increasing_id()
    named = materialize(seeds.filter(F.col("node_id").isNotNull()).select(F.col("node_id").alias("seed_id")).distinct()
                        .withColumn("number", number), "seeds")
    place = [F.floor(F.col("number") / WORD_BITS).alias("word"), F.pmod("number", F.lit(WORD_BITS)).cast("int").alias("bit")]
    named = named.select("seed_id", *place)
    bit = F.expr("shiftleft(1L, bit)")
    frontier = materialize(named.select(F.col("seed_id").alias("node_id"), "word", bit.alias("bits")), "seed-frontier")
    seen, found = frontier, named.select("seed_id", F.col("seed_id").alias("node_id"), F.lit(0).alias("depth"),
                                         F.lit(None).cast("string").alias("previous"))
    places = F.array(*[F.lit(i) for i in range(WORD_BITS)])
    for d in range(1, k + 1):
        steps = frontier.join(adj, frontier.node_id == adj._from).select(F.col("_to").alias("node_id"), "_from", "word", "bits")
        reached = steps.groupBy("node_id", "word").agg(F.bit_or("bits").alias("reached"))
        before = seen.select("node_id", "word", F.col("bits").alias("before"))
        new = reached.join(before, ["node_id", "word"], "left") \
            .select("node_id", "word", F.col("reached").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0)))).alias("bits")) \
            .filter("bits != 0")
        new = materialize(new, "seed-frontier")
        # who brought each bit: only the bits that are new
        brought = steps.join(new.select("node_id", "word", F.col("bits").alias("new")), ["node_id", "word"]) \
            .select("node_id", "word", "_from", F.col("bits").bitwiseAND(F.col("new")).alias("bits"))
        brought = brought.select("node_id", "word", "_from", F.explode_outer(F.filter(
            places, lambda i: F.getbit("bits", i) == 1)).alias("bit")).filter(F.col("bit").isNotNull())
        hop = brought.groupBy("node_id", "word", "bit").agg(F.min("_from").alias("previous")).join(named, ["word", "bit"]) \
            .select("seed_id", "node_id", F.lit(d).alias("depth"), "previous")
        found = found.unionByName(materialize(hop, "seed-hop"))
        if d < k:
            seen = materialize(seen.unionByName(new).groupBy("node_id", "word").agg(F.bit_or("bits").alias("bits")), "seed-seen")
            frontier = new
    return found
