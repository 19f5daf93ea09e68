"""Driver query bindings: one callable per operator key (FIXTURES.md §3.2).

Every query reads whole test tables through :class:`Views` and runs the
library's own operators.  Output columns are cast explicitly and doubles
rounded so the DuckDB oracle in :mod:`codelens.plans.oracle` can be compared
value for value.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import delta, evaluate, graph, render, rules, search
from ..operators.chunking import structural_chunks
from ..operators.embed import hash_embed_long
from ..session import materialize, read_table
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Binding parameters (FIXTURES.md §3.2).
URL_PATTERN = r"^https?://([^/]+)/([^/]+)/([^/?#]+)(.*)$"
EVENT_HOOKS = ("click", "purchase")
EVENT_DOCTYPE_NEEDLE = "sign"
PROMPT_NEEDLE = "the"
PROMPT_ENTITY = "Sales Invoice"
EMBED_DIM = 16
VECTOR_DIM = 64
KNN_K = 16
BM25_N = 16
HYBRID_LIMIT = 8
EVAL_K = 5
KHOP_SEED = "ASIA"
KHOP_K = 2
SUBGRAPH_ENTITY = "MiddleEast"


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _v(spark, sf_dir) -> Views:
    return Views(spark, sf_dir)


# -- S1, S2 -----------------------------------------------------------------
@query("scan_filter_classify")
def q_scan_filter_classify(spark, sf_dir):
    f = _v(spark, sf_dir).v_files
    return f.filter(tx.has_extension("path")).select("path", tx.file_kind("path").alias("kind"))


# -- F1 .. F19 ----------------------------------------------------------------
@query("content_hash")
def q_content_hash(spark, sf_dir):
    d = _v(spark, sf_dir).t("documents")
    return d.select("doc_id", tx.content_hash("text").alias("content_hash"))


@query("parse_repo_url")
def q_parse_repo_url(spark, sf_dir):
    p = _v(spark, sf_dir).t("pages")
    loc = tx.parse_repo_url("url", URL_PATTERN)
    return p.select("page_id", loc["owner"].alias("owner"), loc["repo"].alias("repo"),
                    loc["branch"].alias("branch"), loc["path"].alias("path"))


@query("normalize_path")
def q_normalize_path(spark, sf_dir):
    g = _v(spark, sf_dir).v_golden
    return g.select("query_id", tx.normalize_path("expected_file").alias("norm_path"))


@query("entity_name")
def q_entity_name(spark, sf_dir):
    n = _v(spark, sf_dir).t("nation")
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"),
                    tx.entity_name(F.concat(F.lit("a/b/"), F.col("n_name"))).alias("entity"))


@query("snake_case")
def q_snake_case(spark, sf_dir):
    p = _v(spark, sf_dir).t("part")
    return p.select("p_partkey", tx.snake_case("p_brand").alias("brand_snake"),
                    tx.snake_case("p_name").alias("name_snake"))


@query("hook_tag")
def q_hook_tag(spark, sf_dir):
    e = _v(spark, sf_dir).t("events")
    return e.select("event_id", tx.hook_tag("event_type", EVENT_HOOKS, empty_as="").alias("hook_type"),
                    tx.doctype_tag("event_type", EVENT_DOCTYPE_NEEDLE).alias("doctype"))


@query("tokenize")
def q_tokenize(spark, sf_dir):
    d = _v(spark, sf_dir).t("documents")
    return d.select("doc_id", F.posexplode_outer(tx.tokenize("text")).alias("pos", "token")) \
        .filter(F.col("token").isNotNull()).select("doc_id", F.col("pos").cast("long"), "token")


@query("simple_name")
def q_simple_name(spark, sf_dir):
    s = _v(spark, sf_dir).v_sites
    return s.select("caller_id", F.col("ordinal").cast("long"), tx.simple_name("raw_callee").alias("callee"))


@query("embed_prefix")
def q_embed_prefix(spark, sf_dir):
    v = _v(spark, sf_dir)
    q = v.v_queries.select(F.col("query_id").alias("id"), F.lit("query").alias("kind"),
                           tx.embed_prefix("query", is_query=True).alias("_t"))
    d = v.t("documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"),
                                tx.embed_prefix("text", is_query=False).alias("_t"))
    return q.unionByName(d).select("id", "kind", F.md5("_t").alias("text_md5"),
                                   F.length("_t").cast("long").alias("text_len"))


@query("prompt_build")
def q_prompt_build(spark, sf_dir):
    c = _v(spark, sf_dir).t("conversations").filter(F.col("role") == "user")
    p = render.build_prompts(c, PROMPT_ENTITY, query_col="text", needle=PROMPT_NEEDLE)
    return p.select("conv_id", "turn", "template", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_len"))


@query("violation_text")
def q_violation_text(spark, sf_dir):
    inv = _v(spark, sf_dir).v_invoice
    v = inv.select("invoice_id", rules.pos_violation().alias("v")).filter(F.col("v").isNotNull())
    return v.select("invoice_id", tx.violation_text(F.col("v")["code"], F.col("v")["details"]).alias("text"))


# -- C3 -----------------------------------------------------------------------
@query("structural_chunks")
def q_structural_chunks(spark, sf_dir):
    d = _v(spark, sf_dir).t("documents")
    ch = structural_chunks(d, "doc_id", "text")
    return ch.select("doc_id", F.col("seg").cast("long"), F.col("start_line").cast("long"),
                     F.col("end_line").cast("long"), F.md5("text").alias("text_md5"))


# -- G1 .. G11 ------------------------------------------------------------------
@query("graph_nodes")
def q_graph_nodes(spark, sf_dir):
    v = _v(spark, sf_dir)
    base = v.v_nodes.withColumn("ordinal", F.lit(0))
    # A second write of every class node with changed attributes: last wins.
    again = v.v_nodes.filter(F.col("type") == "class").withColumn("name", F.lower("name")) \
        .withColumn("parent_class", F.lit("rewritten")).withColumn("ordinal", F.lit(1))
    return graph.build_nodes(base.unionByName(again)).select("node_id", "type", "name", "parent_class")


@query("contains_edges")
def q_contains_edges(spark, sf_dir):
    return graph.contains_edges(_v(spark, sf_dir).v_nodes)


@query("symbol_table")
def q_symbol_table(spark, sf_dir):
    return graph.symbol_table(_v(spark, sf_dir).v_defs)


def _call_nodes(v: Views) -> DataFrame:
    callers = v.t("orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return v.v_defs.select("node_id").unionByName(callers)


@query("resolve_calls")
def q_resolve_calls(spark, sf_dir):
    v = _v(spark, sf_dir)
    table = graph.symbol_table(v.v_defs)
    e = graph.resolve_calls(v.v_sites, table, _call_nodes(v))
    return e.select("src", "dst", "type", F.col("ordinal").cast("long"))


@query("edge_keys")
def q_edge_keys(spark, sf_dir):
    calls = _v(spark, sf_dir).v_calls
    k = graph.edge_keys(calls, ["l_orderkey", "l_linenumber", "l_partkey"])
    return k.select("src", "dst", "l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey",
                    F.col("key").cast("long"))


def _all_edges(v: Views) -> DataFrame:
    return v.v_contains.unionByName(v.v_calls.select("src", "dst", "type"))


def _n_calls(v: Views) -> int:
    """Rows of the calls' table, from the footers of its files."""
    return read_table(v.spark, v.sf_dir, "lineitem").count()


@query("induced_subgraph")
def q_induced_subgraph(spark, sf_dir):
    v = _v(spark, sf_dir)
    sel = graph.select_nodes(v.v_nodes, SUBGRAPH_ENTITY)
    return graph.induced_subgraph(_all_edges(v), sel).select("src", "dst", "type")


@query("simple_edges")
def q_simple_edges(spark, sf_dir):
    v = _v(spark, sf_dir)
    return graph.simple_edges(_all_edges(v), rows=_n_calls(v))


@query("mermaid_lines")
def q_mermaid_lines(spark, sf_dir):
    v = _v(spark, sf_dir)
    edges = graph.simple_edges(_all_edges(v), rows=_n_calls(v))
    return graph.mermaid_lines(edges).select("src", "dst", "line")


@query("khop_neighbors")
def q_khop_neighbors(spark, sf_dir):
    v = _v(spark, sf_dir)
    seeds = v.v_nodes.filter(F.col("node_id") == KHOP_SEED).select("node_id")
    out = graph.khop_neighbors(_all_edges(v), seeds, KHOP_K, "down", _n_calls(v))
    return out.select("node_id", F.col("depth").cast("long"))


@query("khop_by_seed")
def q_khop_by_seed(spark, sf_dir):
    v = _v(spark, sf_dir)
    seeds = graph.select_nodes(v.v_nodes, SUBGRAPH_ENTITY).select("node_id")
    out = graph.khop_by_seed(_all_edges(v), seeds, KHOP_K, "down", _n_calls(v))
    return out.select("seed_id", "node_id", F.col("depth").cast("long"), "previous")


# -- I1 .. I3, K1 .. K4 -------------------------------------------------------
@query("delta_classify")
def q_delta_classify(spark, sf_dir):
    v = _v(spark, sf_dir)
    return delta.delta_classify(v.v_cur, v.v_prev_state).select("path", "status")


@query("delta_filter")
def q_delta_filter(spark, sf_dir):
    v = _v(spark, sf_dir)
    return delta.changed_only(v.v_cur, v.v_prev_state).select("doc_id", "path", "content_hash")


def _processed_chunks(v: Views) -> DataFrame:
    """Stand-in chunker output for the processed files: a file whose text
    has no line break yields no chunk."""
    changed = delta.changed_only(v.v_cur, v.v_prev_state)
    return changed.filter(F.col("content").contains("\n")).select(F.col("path").alias("file_path"))


@query("next_state")
def q_next_state(spark, sf_dir):
    v = _v(spark, sf_dir)
    return delta.next_state(v.v_cur, v.v_prev_state, _processed_chunks(v))


def _chunks_with_bad_vectors(v: Views) -> DataFrame:
    """v_chunks where every eleventh document's vector is cut to 63 values."""
    c = v.v_chunks
    cut = F.when(F.col("doc_id") % 11 == 0, F.slice("vector", 1, VECTOR_DIM - 1)).otherwise(F.col("vector"))
    return c.withColumn("vector", cut)


@query("drop_bad_vectors")
def q_drop_bad_vectors(spark, sf_dir):
    c = delta.drop_bad_vectors(_chunks_with_bad_vectors(_v(spark, sf_dir)), VECTOR_DIM)
    return c.select("id", "doc_id")


@query("delete_by_file")
def q_delete_by_file(spark, sf_dir):
    v = _v(spark, sf_dir)
    st = delta.delta_classify(v.v_cur, v.v_prev_state)
    gone = st.filter(F.col("status").isin(delta.CHANGED, delta.DELETED)).select("path")
    return delta.delete_by_file(v.v_chunks, gone).select("id", "doc_id")


@query("upsert_chunks")
def q_upsert_chunks(spark, sf_dir):
    v = _v(spark, sf_dir)
    chunks = v.v_chunks.select("id", "file_path", "content")
    prev_paths = v.v_prev_state.select(F.col("path").alias("file_path"))
    old = chunks.join(prev_paths, "file_path", "left_semi").withColumn("version", F.lit("previous"))
    todo = delta.changed_only(v.v_cur, v.v_prev_state).select(F.col("path").alias("file_path"))
    new = chunks.join(todo, "file_path", "left_semi").withColumn("version", F.lit("current"))
    up = delta.upsert_chunks(old, new)
    return up.select("id", "file_path", "version", F.md5("content").alias("content_md5"))


# -- R1 .. R12 ------------------------------------------------------------------
@query("embed_hash")
def q_embed_hash(spark, sf_dir):
    d = _v(spark, sf_dir).t("documents")
    e = hash_embed_long(d, "doc_id", "text", EMBED_DIM)
    return e.select("doc_id", F.col("dim").cast("long"), F.round("value", 6).alias("value"))


@query("knn_topk")
def q_knn_topk(spark, sf_dir):
    e = _v(spark, sf_dir).t("embeddings")
    qs = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    r = search.knn_topk(qs, corpus, KNN_K)
    return r.select("query_id", F.col("rank").cast("long"), F.col("id").alias("vec_id"),
                    F.round("dist", 6).alias("dist"))


def _doc_index(v: Views) -> search.BM25Index:
    # the index deals the texts by id itself, so the scan is not spread first
    return search.BM25Index(read_table(v.spark, v.sf_dir, "documents"), "doc_id", "text")


@query("bm25_stats")
def q_bm25_stats(spark, sf_dir):
    idx = _doc_index(_v(spark, sf_dir))
    return idx.terms.select("term", F.col("df").cast("long"), F.round("idf_raw", 6).alias("idf_raw"),
                            F.round("idf", 6).alias("idf"))


@query("bm25_score")
def q_bm25_score(spark, sf_dir):
    v = _v(spark, sf_dir)
    s = search.bm25_scores(_doc_index(v), v.v_queries)
    return s.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("bm25_topk")
def q_bm25_topk(spark, sf_dir):
    v = _v(spark, sf_dir)
    r = search.bm25_topk(_doc_index(v), v.v_queries, BM25_N, score_digits=6)
    return r.select("query_id", F.col("rank").cast("long"), F.col("id").alias("doc_id"), "score")


def _vector_corpus(v: Views) -> DataFrame:
    """The chunk table, stored once (as the index job does) so the dense,
    sparse and render steps all read the same table.  Every text is in it; a
    chunk without a vector is found by its words only."""
    return materialize(v.v_chunks, "vector_table")


def _hybrid(v: Views) -> DataFrame:
    corpus = _vector_corpus(v)
    return search.hybrid_search(corpus, v.v_queries, HYBRID_LIMIT, score_digits=6)


@query("rrf_fuse")
def q_rrf_fuse(spark, sf_dir):
    h = _hybrid(_v(spark, sf_dir))
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("score", 8).alias("score"))


@query("hybrid_search")
def q_hybrid_search(spark, sf_dir):
    h = _hybrid(_v(spark, sf_dir))
    return h.select("query_id", F.col("rank").cast("long"), "id", "file_path",
                    F.round("score", 8).alias("score"))


@query("context_render")
def q_context_render(spark, sf_dir):
    h = _hybrid(_v(spark, sf_dir))
    ctx = render.render_context(h)
    return ctx.select("query_id", F.md5("context").alias("context_md5"),
                      F.length("context").cast("long").alias("context_len"))


@query("question_prompt")
def q_question_prompt(spark, sf_dir):
    """Search, context and prompt of every question as one job."""
    v = _v(spark, sf_dir)
    p = render.question_prompts(v.v_queries, _hybrid(v), PROMPT_ENTITY, needle=PROMPT_NEEDLE)
    return p.select("query_id", "template", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_len"))


# -- E1 .. E7 ---------------------------------------------------------------------
def _golden_ranks(v: Views) -> DataFrame:
    hits = search.knn_topk(v.v_golden, v.v_paths, EVAL_K, exclude_self=True)
    hits = hits.join(v.v_paths.select("id", "file_path"), "id")
    return evaluate.first_relevant_rank(hits, v.v_golden, EVAL_K)


@query("first_relevant_rank")
def q_first_relevant_rank(spark, sf_dir):
    r = _golden_ranks(_v(spark, sf_dir))
    return r.select("query_id", F.col("rank").cast("long"))


@query("retrieval_metrics")
def q_retrieval_metrics(spark, sf_dir):
    m = evaluate.retrieval_metrics(_golden_ranks(_v(spark, sf_dir)))
    return m.select(F.col("n_queries").cast("long"), F.round("hit_rate", 6).alias("hit_rate"),
                    F.round("mrr", 6).alias("mrr"))


def _judged(v: Views) -> DataFrame:
    """All queries, also those that have no judgement (they count as 0)."""
    return v.t("documents").select(F.col("doc_id").alias("query_id"))


@query("judge_averages")
def q_judge_averages(spark, sf_dir):
    v = _v(spark, sf_dir)
    a = evaluate.judge_averages(_judged(v), v.v_scores)
    return a.select(F.round("avg_accuracy", 6).alias("avg_accuracy"),
                    F.round("avg_completeness", 6).alias("avg_completeness"))


@query("benchmark_summary")
def q_benchmark_summary(spark, sf_dir):
    v = _v(spark, sf_dir)
    m = evaluate.benchmark_summary(_golden_ranks(v), v.v_scores)
    return m.select(F.col("n_queries").cast("long"), *[F.round(c, 6).alias(c) for c in (
        "hit_rate", "mrr", "avg_accuracy", "avg_completeness")])


@query("eval_report")
def q_eval_report(spark, sf_dir):
    v = _v(spark, sf_dir)
    rep = evaluate.eval_report(_golden_ranks(v), v.v_scores)
    return rep.select("query_id", "found", F.col("rank").cast("long"), "rank_text",
                      F.col("scores.accuracy").cast("long").alias("accuracy"),
                      F.col("scores.completeness").cast("long").alias("completeness"),
                      F.col("scores.rationale").alias("rationale"))


@query("run_log_row")
def q_run_log_row(spark, sf_dir):
    from ..sources.sinks import run_log_row
    v = _v(spark, sf_dir)
    metrics = evaluate.retrieval_metrics(_golden_ranks(v)).select("mrr")
    judged = evaluate.judge_averages(_judged(v), v.v_scores).select(F.col("avg_accuracy").alias("accuracy"))
    row = run_log_row(spark, {"entity": PROMPT_ENTITY, "chunk_size": "500"},
                      [metrics, judged], {"evaluation_report": sf_dir})
    return row.select(F.col("config")["entity"].alias("entity"),
                      F.col("config")["chunk_size"].cast("long").alias("chunk_size"),
                      F.round(F.col("metrics")["accuracy"], 6).alias("accuracy"),
                      F.round(F.col("metrics")["mrr"], 6).alias("mrr"),
                      F.size("artifacts").cast("long").alias("n_artifacts"))


def _pipeline(v: Views, use_tolerance: bool = True) -> DataFrame:
    return rules.validate(v.v_invoice, v.v_items, v.v_credit, v.v_allowed,
                          invoice_key="invoice_id", item_key="l_orderkey", use_tolerance=use_tolerance)


@query("parity_compare")
def q_parity_compare(spark, sf_dir):
    v = _v(spark, sf_dir)
    # Both rule variants read the same prepared invoices (one plan subtree).
    prepared = rules.attach_lookups(v.v_invoice, v.v_items, v.v_credit, v.v_allowed,
                                    invoice_key="invoice_id", item_key="l_orderkey")
    legacy = rules.apply_rules(prepared, use_tolerance=False) \
        .select("invoice_id", rules.violation_code().alias("outcome"))
    actual = rules.apply_rules(prepared).select("invoice_id", rules.violation_code().alias("outcome"))
    p = evaluate.parity_compare(legacy, actual, "invoice_id")
    return p.select("expected", "actual", F.col("n").cast("long"), "match")


# -- V1 .. V6 -----------------------------------------------------------------------
@query("rule_pos")
def q_rule_pos(spark, sf_dir):
    inv = _v(spark, sf_dir).v_invoice
    v = inv.select("invoice_id", rules.pos_violation().alias("v")).filter(F.col("v").isNotNull())
    return v.select("invoice_id", F.col("v.code").alias("code"), F.col("v.details").alias("details"))


@query("rule_credit")
def q_rule_credit(spark, sf_dir):
    v = _v(spark, sf_dir)
    df = rules.attach_item_flags(v.v_invoice, v.v_items, "invoice_id", "l_orderkey")
    df = rules.attach_credit(df, v.v_credit, ["customer", "company"])
    out = df.select("invoice_id", rules.credit_violation().alias("v")).filter(F.col("v").isNotNull())
    return out.select("invoice_id", F.col("v.code").alias("code"))


@query("rule_dropship")
def q_rule_dropship(spark, sf_dir):
    v = _v(spark, sf_dir)
    df = rules.attach_item_flags(v.v_invoice, v.v_items, "invoice_id", "l_orderkey")
    out = df.select("invoice_id", rules.dropship_violation().alias("v")).filter(F.col("v").isNotNull())
    return out.select("invoice_id", F.col("v.code").alias("code"))


@query("rule_intercompany")
def q_rule_intercompany(spark, sf_dir):
    v = _v(spark, sf_dir)
    df = rules.attach_allowed(v.v_invoice, v.v_allowed)
    out = df.select("invoice_id", rules.intercompany_violation().alias("v")).filter(F.col("v").isNotNull())
    return out.select("invoice_id", F.col("v.code").alias("code"))


@query("qualified_id")
def q_qualified_id(spark, sf_dir):
    v = _v(spark, sf_dir)
    n, r = v.t("nation"), v.t("region")
    # every third nation has no class part
    part = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", tx.qualified_id("r_name", part, F.lit("handler")).alias("qualified_id"))


@query("list_membership")
def q_list_membership(spark, sf_dir):
    v = _v(spark, sf_dir)
    lists = v.v_allowed.groupBy("customer").agg(F.collect_set("company").alias("allowed"))
    return rules.attach_allowed_list(v.v_invoice, lists).select("invoice_id", F.col("_allowed").alias("allowed"))


@query("validate_pipeline")
def q_validate_pipeline(spark, sf_dir):
    return _pipeline(_v(spark, sf_dir)).select("invoice_id", rules.violation_code().alias("code"))


@query("validate_rules")
def q_validate_rules(spark, sf_dir):
    p = _pipeline(_v(spark, sf_dir))
    return p.groupBy(rules.violation_code().alias("code")).agg(F.count(F.lit(1)).alias("n"))
