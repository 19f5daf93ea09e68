"""Incremental indexing of a source corpus, as Spark jobs.

``files`` -> content hash -> anti-join against the previous state (before
any Python) -> symbol extraction (one ``mapInPandas``) -> chunk table,
embeddings, upsert into the vector table -> calls of the touched names
resolved against the whole corpus -> next hash state.  The vector table and
the graph store are cut into buckets, and a run writes only the buckets of
what it touched (:mod:`codelens.sources.bucketed`); the other outputs are new
version folders; no input path is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators import delta, symbols
from ..operators.embed import hash_embed
from ..operators.graph_runs import GraphRuns
from ..operators.search import valid_vector
from ..session import materialize
from ..sources import files as src
from ..sources import sinks
from ..sources.bucketed import upsert_bucketed

DEFAULT_DIM = 768


def index_corpus(files: DataFrame, root: str, entity: str, dim: int = DEFAULT_DIM,
                 embed=None, full_listing: bool = True) -> dict:
    """Index ``files(path, content)`` under ``root`` (a shared folder).

    ``embed(chunks) -> chunks + vector`` defaults to the hashed embedder.
    With ``full_listing`` the files are the whole corpus, so a path missing
    from them was deleted; otherwise (a stream micro-batch) they are only
    new or rewritten files and every other path keeps its state.
    Returns the paths written and row counts of the run.
    """
    spark = files.sparkSession
    state_base, table_base = f"{root}/state", f"{root}/vectors"
    symbols_base, graph_base = f"{root}/symbols", f"{root}/graph"
    prev = src.read_state(spark, state_base)
    # The only pass over the contents: hashes of all files, texts of the
    # changed ones.  Every later step reads this, so state and chunks come
    # from one reading of a file.
    known = prev.select(F.col("path").alias("_p"), F.col("content_hash").alias("_h")).filter("_h is not null")
    hashed = delta.with_hash(files.select("path", "content"))
    seen = hashed.join(known, (F.col("path") == F.col("_p")) & (F.col("content_hash") == F.col("_h")), "left")
    seen = materialize(seen.select("path", "content_hash", F.col("_p").isNull().alias("todo"),
                                   F.when(F.col("_p").isNull(), F.col("content")).alias("content")), "files")
    cur = seen.select("path", "content_hash")
    todo = seen.filter("todo").select("path", "content", "content_hash")
    gone = prev.select("path").join(cur.select("path"), "path", "left_anti")
    if not full_listing:
        gone = gone.filter(F.lit(False))
    # One Python pass over changed files only; four outputs read its result.
    extracted = materialize(symbols.extract_symbols(todo), "extracted")
    chunks = symbols.symbol_chunks(extracted)
    keyed = chunks.withColumn("_key", F.concat_ws("#", "file_path", F.col("ordinal").cast("string")))
    if embed is None:
        vecs = hash_embed(keyed.withColumn("_text", tx.embed_prefix("content", is_query=False)), "_key", "_text", dim)
        with_vec = keyed.join(vecs, "_key")
    else:
        with_vec = embed(keyed)
    # the embedder runs once; a vector that is rejected is counted, not lost
    checked = materialize(with_vec.withColumn("_valid", F.coalesce(valid_vector("vector", dim), F.lit(False))), "vectors")
    new_rows = checked.filter("_valid").select(*[f.name for f in schemas.VECTOR_TABLE.fields])
    replaced = gone.select("path").union(todo.select("path"))
    buckets = upsert_bucketed(table_base, schemas.VECTOR_TABLE, new_rows, replaced)
    store = GraphRuns(spark, symbols_base)
    store.update(extracted, replaced)
    nodes, edges = store.graph()
    graph_root = sinks.save_graph(nodes, edges, graph_base, entity)
    state = delta.next_state(cur, prev, chunks)
    if not full_listing:
        state = prev.join(cur.select("path"), "path", "left_anti").unionByName(state)
    state_path = sinks.write_state(state, state_base)
    return {"vectors": table_base, "symbols": symbols_base, "graph": graph_root, "state": state_path,
            "touched_buckets": buckets, "rejected_vectors": checked.filter("NOT _valid").count(),
            "processed_files": todo.count(), "errors": symbols.extraction_errors(extracted).count()}
