"""Context and prompt rendering.

Per query the fused list is at most ``limit`` rows, so collecting it into an
ordered array per query is bounded; the text is assembled JVM-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Section texts of the rendered context.
CONTEXT_HEADER = "## Relevant Code\n"
CHUNK_FORMAT = "### %s (%s)\n**File**: `%s:%s`\n**Hook**: %s\n```python\n%s\n```\n"
FLOW_HEADER = "\n## Call Flow\n```\n"
FLOW_FOOTER = "\n```"
FLOW_LINE = "  └── %s()"
NO_HOOK = "N/A"


def render_context(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """``hits(query_id, rank, symbol_name, symbol_type, file_path,
    start_line, hook_type, content)`` -> ``query_id, context``."""
    hook = F.coalesce(F.nullif(F.col("hook_type"), F.lit("")), F.lit(NO_HOOK))
    piece = F.format_string(CHUNK_FORMAT, F.col("symbol_name"), F.col("symbol_type"),
                            F.col("file_path"), F.col("start_line").cast("string"), hook,
                            F.col("content"))
    per = hits.select(query_key, F.struct(F.col("rank").alias("r"), piece.alias("t"),
                                          F.col("symbol_name").alias("n")).alias("_p"))
    g = per.groupBy(query_key).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    chunks = F.transform("_ps", lambda p: p["t"])
    names = F.array_distinct(F.transform("_ps", lambda p: p["n"]))
    flow = F.array_join(F.transform(names, lambda n: F.format_string(FLOW_LINE, n)), "\n")
    parts = F.concat(F.array(F.lit(CONTEXT_HEADER)), chunks,
                     F.array(F.concat(F.lit(FLOW_HEADER), flow, F.lit(FLOW_FOOTER))))
    return g.select(query_key, F.array_join(parts, "\n").alias("context"))


def question_prompts(queries: DataFrame, hits: DataFrame, entity: str, query_col: str = "query",
                     needle: str = tx.FLOW_NEEDLE) -> DataFrame:
    """R9 -> R10 -> R12: the prompt of every query with the context of its
    hits; a query without hits gets the empty context."""
    context = render_context(hits).withColumnRenamed("query_id", "_qid")
    joined = queries.join(context, F.col("query_id") == F.col("_qid"), "left").drop("_qid") \
        .withColumn("context", F.coalesce("context", F.lit("")))
    return build_prompts(joined, entity, query_col, "context", needle)


def build_prompts(queries: DataFrame, entity: str, query_col: str = "query",
                  context_col: str | None = None, needle: str = tx.FLOW_NEEDLE) -> DataFrame:
    """Default query (F15), template choice (F14) and filled prompt
    (F19) per row; adds ``active_query, template, prompt``."""
    ent = F.lit(entity)
    ctx = F.col(context_col) if context_col else F.lit("")
    df = queries.withColumn("active_query", tx.default_query(query_col, ent))
    df = df.withColumn("template", tx.template_choice("active_query", needle))
    return df.withColumn("prompt", tx.phase_prompt("template", ent, "active_query", ctx))
