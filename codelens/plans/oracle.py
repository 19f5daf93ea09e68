"""DuckDB oracle SQL for each driver key (FIXTURES.md §3).

The views of :mod:`codelens.plans.views` are repeated here as CTEs since the
oracle only sees the base tables.  The oracle may brute-force (cross joins
for kNN and zero-filled BM25) -- it only runs at small scale factors.
"""

from __future__ import annotations

import string

from ..functions import text as tx
from ..operators import rules
from ..operators.render import NO_HOOK

# The bindings' parameters, repeated here so that the two sides are independent.
BM25_N, EMBED_DIM, EVAL_K, HYBRID_LIMIT, KHOP_K, KNN_K, VECTOR_DIM = 16, 16, 5, 8, 2, 16, 64
KHOP_SEED, SUBGRAPH_ENTITY = "ASIA", "MiddleEast"
PROMPT_ENTITY, PROMPT_NEEDLE = "Sales Invoice", "the"
URL_PATTERN = r"^https?://([^/]+)/([^/]+)/([^/?#]+)(.*)$"

NL = "chr(10)"
BS = "chr(92)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


VIEWS = {
    "v_files": f"""SELECT doc_id, source || '/doc_' || cast(doc_id AS varchar) ||
        CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 3 THEN '.txt' ELSE '.py' END AS path,
        text AS content FROM documents""",
    "v_prev_state": """SELECT path, CASE WHEN doc_id % 7 = 0 THEN repeat('0', 64) ELSE sha256(content) END
        AS content_hash FROM v_files WHERE doc_id % 10 <> 0""",
    "v_cur": "SELECT doc_id, path, content, sha256(content) AS content_hash FROM v_files WHERE doc_id % 13 <> 0",
    "v_chunks": f"""SELECT f.path || ':doc_' || cast(f.doc_id AS varchar) AS id, f.doc_id, f.path AS file_path,
        'doc_' || cast(f.doc_id AS varchar) AS symbol_name, d.lang AS symbol_type,
        CASE WHEN f.doc_id % 5 = 0 THEN 'validate' END AS hook_type, f.content, 1 AS start_line,
        1 + length(f.content) - length(replace(f.content, {NL}, '')) AS end_line, e.embedding AS vector
        FROM v_files f JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN embeddings e ON e.vec_id = f.doc_id""",
    "v_queries": """SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "v_golden": f"""SELECT vec_id AS query_id, embedding AS vector,
        'LABEL' || {BS} || cast(label AS varchar) || {BS} AS expected_file FROM embeddings""",
    "v_paths": """SELECT vec_id AS id, embedding AS vector,
        'label/' || cast(label AS varchar) || '/vec' || cast(vec_id AS varchar) AS file_path FROM embeddings""",
    "v_nodes": """SELECT replace(r_name, ' ', '_') AS node_id, 'file' AS type, r_name AS name,
            CAST(NULL AS varchar) AS parent_class FROM region
        UNION ALL SELECT replace(r_name, ' ', '_') || ':' || n_name, 'class', n_name, CAST(NULL AS varchar)
            FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT replace(r_name, ' ', '_') || ':' || n_name || ':' || c_name, 'function', c_name, n_name
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT replace(r_name, ' ', '_') || ':' || n_name || ':' || s_name, 'function', s_name, n_name
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_contains": """SELECT substring(node_id, 1, length(node_id) - length(name) - 1) AS src, node_id AS dst,
        'CONTAINS' AS type FROM v_nodes WHERE type <> 'file'""",
    "v_calls": """SELECT cn.node_id AS src, sn.node_id AS dst, 'CALLS' AS type, l_orderkey, l_linenumber, l_partkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN v_nodes cn ON cn.name = c_name
        JOIN v_nodes sn ON sn.name = s_name""",
    "v_defs": """SELECT p_name AS name, 'part:' || cast(p_partkey AS varchar) AS node_id, p_partkey AS ordinal
        FROM part""",
    "v_sites": """SELECT 'order:' || cast(l_orderkey AS varchar) AS caller_id, 'self.' || p_name AS raw_callee,
        l_linenumber AS ordinal FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_items": """SELECT l_orderkey, l_linenumber, 'P' || cast(l_partkey AS varchar) AS item_code,
        l_quantity AS qty,
        CASE WHEN l_linestatus = 'O' THEN '' ELSE 'SO-' || cast(l_orderkey AS varchar) END AS sales_order,
        CASE WHEN l_returnflag = 'N' THEN '' ELSE 'DN-' || cast(l_orderkey AS varchar) END AS delivery_note,
        l_suppkey % 10 = 0 AS delivered_by_supplier FROM lineitem""",
    "v_invoice": """SELECT o_orderkey AS invoice_id, c_custkey AS customer,
        'Company-' || cast(o_orderkey % 4 AS varchar) AS company, o_orderstatus = 'F' AS is_return,
        c_mktsegment IN ('BUILDING', 'MACHINERY') AS bypass_credit,
        cast(o_totalprice AS decimal(18,4)) AS grand_total,
        cast(CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 0) ELSE 0 END AS decimal(18,4)) AS rounded_total,
        cast(cast(o_totalprice AS decimal(18,4)) + CASE o_orderkey % 5 WHEN 0 THEN 0.0010 WHEN 1 THEN 0.0011
            ELSE -1.0000 END AS decimal(18,4)) AS paid_amount,
        cast(CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0 END AS decimal(18,4)) AS write_off,
        2 AS precision_gt, o_orderpriority IN ('1-URGENT', '2-HIGH') AS update_stock,
        c_nationkey < 5 AS is_internal,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'REF' END AS inter_company_ref
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_credit": """SELECT c_custkey AS customer, 'Company-' || cast(k AS varchar) AS company,
        c_acctbal < CASE WHEN k = 3 THEN -500 ELSE 0 END AS exceeded
        FROM customer, (VALUES (0), (1), (2), (3)) x(k)""",
    "v_allowed": """SELECT c_custkey AS customer, 'Company-' || cast(c_custkey % 4 AS varchar) AS company FROM customer
        UNION SELECT c_custkey, 'Company-' || cast((c_custkey + 1) % 4 AS varchar) FROM customer""",
    "v_scores": """SELECT doc_id AS query_id, quality * 5 AS accuracy,
        CASE WHEN toxic = 1 THEN NULL ELSE 4 END AS completeness FROM labels""",
}
VIEW_ORDER = list(VIEWS)


def _with(views: list[str], extra: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """WITH clause holding the named views (dependencies added) and extra CTEs."""
    need = set(views)
    changed = True
    while changed:
        changed = False
        for v in list(need):
            for dep in VIEW_ORDER:
                if dep not in need and dep in VIEWS[v]:
                    need.add(dep)
                    changed = True
    ctes = [(v, VIEWS[v]) for v in VIEW_ORDER if v in need] + list(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n"


def _tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '\\s+'), lambda x: x <> '')"


def _sqdist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(generate_series(1, len({a})), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))")


def _norm(col: str) -> str:
    return f"lower(replace({col}, {BS}, '/'))"


def _title(s: str) -> str:
    chars = f"string_split({s}, '')"
    return (f"array_to_string(list_transform({chars}, lambda ch, i: CASE WHEN i = 1 OR "
            f"lower({chars}[i - 1]) = upper({chars}[i - 1]) THEN upper(ch) ELSE lower(ch) END), '')")


def _snake(col: str) -> str:
    return f"lower(regexp_replace(regexp_replace({col}, '(\\p{{Lu}})', '_\\1', 'g'), '^_+', ''))"


def _label(col: str) -> str:
    return (f"CASE WHEN contains({col}, ':') THEN string_split({col}, ':')[-1] "
            f"ELSE string_split({col}, '/')[-1] END")


def _format_sql(template: str, **fields: str) -> str:
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(_q(literal))
        if field is not None:
            parts.append(fields[field])
    return " || ".join(parts)


# BM25 statistics of a corpus view (id, text).
def _bm25_stat_ctes(corpus_sql: str) -> list[tuple[str, str]]:
    return [
        ("c_docs", f"SELECT id, {_tokens('text')} AS toks FROM ({corpus_sql})"),
        ("c_tf", "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM c_docs) GROUP BY 1, 2"),
        ("c_dl", "SELECT id, len(toks) AS dl FROM c_docs"),
        ("c_n", "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM c_docs"),
        ("c_df", "SELECT term, count(*) AS df FROM c_tf GROUP BY term"),
        ("c_raw", "SELECT term, df, ln(c_n.n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM c_df, c_n"),
        ("c_idf", """SELECT term, df, idf_raw, CASE WHEN idf_raw < 0 THEN 0.25 * m.m ELSE idf_raw END AS idf
            FROM c_raw, (SELECT avg(idf_raw) AS m FROM c_raw) m"""),
    ]


# The same with the scores of a query view (query_id, query).
def _bm25_ctes(corpus_sql: str, queries_sql: str) -> list[tuple[str, str]]:
    return _bm25_stat_ctes(corpus_sql) + [
        ("q_terms", f"""SELECT query_id, term, count(*) AS qtf FROM
            (SELECT query_id, unnest({_tokens('query')}) AS term FROM ({queries_sql})) GROUP BY 1, 2"""),
        ("c_scores", """SELECT q.query_id, t.id, sum(q.qtf * i.idf * (t.tf * 2.5::DOUBLE) /
            (t.tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * d.dl / c_n.avgdl))) AS score
            FROM q_terms q JOIN c_idf i ON i.term = q.term JOIN c_tf t ON t.term = q.term
            JOIN c_dl d ON d.id = t.id, c_n GROUP BY 1, 2"""),
    ]


def _bm25_topn_ctes(corpus_sql: str, queries_sql: str, n: int) -> list[tuple[str, str]]:
    return _bm25_ctes(corpus_sql, queries_sql) + [
        ("c_all", f"""SELECT q.query_id, d.id, CASE WHEN coalesce(round(s.score, 6), 0) = 0 THEN 0.0::DOUBLE
                ELSE round(s.score, 6) END AS score
            FROM (SELECT DISTINCT query_id FROM ({queries_sql})) q CROSS JOIN c_docs d
            LEFT JOIN c_scores s ON s.query_id = q.query_id AND s.id = d.id"""),
        ("c_top", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)
            AS rank FROM c_all) WHERE rank <= {n}"""),
    ]


def _hybrid_ctes() -> list[tuple[str, str]]:
    corpus = "SELECT * FROM v_chunks"
    n = 2 * HYBRID_LIMIT
    return [("corpus", corpus)] + _bm25_topn_ctes("SELECT id, content AS text FROM corpus",
                                                  "SELECT query_id, query FROM v_queries", n) + [
        ("dense", f"""SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)
            AS rank FROM (SELECT q.query_id, c.id, {_sqdist('q.vector', 'c.vector')} AS dist
            FROM v_queries q, corpus c WHERE c.vector IS NOT NULL)) WHERE rank <= {n}"""),
        ("fused", """SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS score, min(dr) AS dr, min(sr) AS sr FROM
            (SELECT query_id, id, rank AS r, rank AS dr, NULL::BIGINT AS sr FROM dense
             UNION ALL SELECT query_id, id, rank, NULL::BIGINT, rank FROM c_top) GROUP BY 1, 2"""),
        ("hyb", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
            dr ASC NULLS LAST, sr ASC NULLS LAST) AS rank FROM fused) WHERE rank <= {HYBRID_LIMIT}"""),
        ("hyb_rows", "SELECT h.query_id, h.rank, h.score, c.* EXCLUDE (vector) FROM hyb h JOIN corpus c ON c.id = h.id"),
    ]


def _golden_ctes() -> list[tuple[str, str]]:
    return [
        ("g_hits", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank
            FROM (SELECT g.query_id, p.id, p.file_path, g.expected_file, {_sqdist('g.vector', 'p.vector')} AS dist
                  FROM v_golden g, v_paths p WHERE p.id <> g.query_id)) WHERE rank <= {EVAL_K}"""),
        ("g_match", f"""SELECT query_id, min(rank) AS rank FROM g_hits
            WHERE contains({_norm('file_path')}, {_norm('expected_file')}) GROUP BY 1"""),
        ("g_ranks", "SELECT g.query_id, m.rank FROM v_golden g LEFT JOIN g_match m ON m.query_id = g.query_id"),
    ]


def _rules_ctes() -> list[tuple[str, str]]:
    return [
        ("flags", """SELECT l_orderkey AS invoice_id,
            max(CASE WHEN coalesce(sales_order, '') = '' AND coalesce(delivery_note, '') = '' THEN 1 ELSE 0 END) AS unl,
            max(CASE WHEN coalesce(delivered_by_supplier, false) THEN 1 ELSE 0 END) AS sup
            FROM v_items GROUP BY 1"""),
        ("inv", """SELECT i.*, coalesce(f.unl, 0) AS unl, coalesce(f.sup, 0) AS sup, c.exceeded,
            a.customer IS NOT NULL AS allowed,
            CASE WHEN i.rounded_total > 0 THEN i.rounded_total ELSE i.grand_total END AS total
            FROM v_invoice i LEFT JOIN flags f ON f.invoice_id = i.invoice_id
            LEFT JOIN v_credit c ON c.customer = i.customer AND c.company = i.company
            LEFT JOIN v_allowed a ON a.customer = i.customer AND a.company = i.company"""),
    ]


def _outcome(tol: str) -> str:
    return f"""CASE WHEN is_return AND paid_amount + write_off - total > {tol} THEN {_q(rules.ERR_POS_AMOUNT)}
        WHEN (NOT bypass_credit OR unl = 1) AND coalesce(exceeded, true) THEN {_q(rules.ERR_CREDIT_LIMIT)}
        WHEN update_stock AND sup = 1 THEN {_q(rules.ERR_DROP_SHIP)}
        WHEN coalesce(inter_company_ref, '') = '' AND is_internal AND NOT allowed THEN {_q(rules.ERR_INTER_COMPANY)}
        ELSE 'none' END"""


TOL = "1.0::DOUBLE / power(10, precision_gt + 1)"
POS_WHERE = f"is_return AND paid_amount + write_off - total > {TOL}"
EDGES_ALL = "SELECT src, dst, type FROM v_contains UNION ALL SELECT src, dst, type FROM v_calls"


def _prompt_from(source: str, keys: str, query: str, context: str) -> str:
    """Prompts over ``source`` with columns ``keys``, the query and context."""
    active = f"CASE WHEN {query} IS NULL OR {query} = '' THEN " + _q(tx.DEFAULT_QUERY_PREFIX + PROMPT_ENTITY) + \
        f" ELSE {query} END"
    tmpl = f"CASE WHEN contains(lower(active), {_q(PROMPT_NEEDLE)}) THEN 'process_flow' ELSE 'debugging' END"
    fields = dict(entity_name=_q(PROMPT_ENTITY), user_query="active", context_data="context")
    prompt = "CASE " + " ".join(f"WHEN template = {_q(name)} THEN {_format_sql(t, **fields)}"
                                for name, t in tx.TEMPLATES.items()) + " END"
    return f"""SELECT {keys}, template, md5(prompt) AS prompt_md5, cast(length(prompt) AS bigint) AS prompt_len
        FROM (SELECT *, {prompt} AS prompt FROM (SELECT *, {tmpl} AS template FROM
        (SELECT {keys}, {active} AS active, {context} AS context FROM {source})))"""


def _prompt_sql() -> str:
    return _prompt_from("conversations WHERE role = 'user'", "conv_id, turn", "text", "''")


def _context_ctes() -> list[tuple[str, str]]:
    piece = (f"'### ' || symbol_name || ' (' || symbol_type || ')' || {NL} || '**File**: `' || file_path || ':' || "
             f"cast(start_line AS varchar) || '`' || {NL} || '**Hook**: ' || coalesce(nullif(hook_type, ''), "
             f"{_q(NO_HOOK)}) || {NL} || '```python' || {NL} || content || {NL} || '```' || {NL}")
    return _hybrid_ctes() + [
        ("pieces", f"SELECT query_id, rank, {piece} AS t FROM hyb_rows"),
        ("names", "SELECT query_id, symbol_name, min(rank) AS fr FROM hyb_rows GROUP BY 1, 2"),
        ("flow", f"SELECT query_id, string_agg('  └── ' || symbol_name || '()', {NL} ORDER BY fr) AS f "
                 "FROM names GROUP BY 1"),
        ("body", f"SELECT query_id, string_agg(t, {NL} ORDER BY rank) AS b FROM pieces GROUP BY 1"),
        ("ctx", f"""SELECT body.query_id, '## Relevant Code' || {NL} || {NL} || b || {NL} || {NL} || '## Call Flow'
            || {NL} || '```' || {NL} || f || {NL} || '```' AS c FROM body JOIN flow ON flow.query_id = body.query_id"""),
    ]


def _context_sql() -> str:
    return _with(["v_chunks", "v_queries"], _context_ctes()) + \
        "SELECT query_id, md5(c) AS context_md5, cast(length(c) AS bigint) AS context_len FROM ctx"


def _question_prompt_sql() -> str:
    source = "v_queries q LEFT JOIN ctx ON ctx.query_id = q.query_id"
    return _with(["v_chunks", "v_queries"], _context_ctes()) + \
        _prompt_from(f"(SELECT q.query_id, q.query, ctx.c FROM {source})", "query_id", "query", "coalesce(c, '')")


def oracle_sql() -> dict[str, str]:
    hook_list = ", ".join(_q(h) for h in ("click", "purchase"))
    sel_nodes = (f"SELECT node_id FROM v_nodes WHERE contains({_norm('node_id')}, {_q(SUBGRAPH_ENTITY.lower())}) "
                 f"OR contains({_norm('node_id')}, {_q('middle_east')})")
    changed = ("SELECT * FROM v_cur c WHERE NOT EXISTS (SELECT 1 FROM v_prev_state p "
               "WHERE p.path = c.path AND p.content_hash = c.content_hash)")
    classify = """SELECT coalesce(c.path, p.path) AS path,
        CASE WHEN p.content_hash IS NULL AND c.content_hash IS NOT NULL THEN 'new'
             WHEN c.content_hash IS NULL AND p.content_hash IS NOT NULL THEN 'deleted'
             WHEN c.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM v_cur c FULL OUTER JOIN v_prev_state p ON c.path = p.path"""
    symtab = "SELECT name, arg_max(node_id, ordinal) AS node_id FROM v_defs GROUP BY name"
    bucket = f"('0x' || substr(md5(tok), 1, 8))::BIGINT % {EMBED_DIM}"
    ranks_metrics = """SELECT cast(count(*) AS bigint) AS n_queries,
        round(coalesce(100.0::DOUBLE * count(rank) / count(*), 0), 6) AS hit_rate,
        round(coalesce(avg(coalesce(1.0::DOUBLE / rank, 0)), 0), 6) AS mrr FROM g_ranks"""
    judge = """SELECT coalesce(avg(coalesce(s.accuracy, 0)::DOUBLE), 0) AS avg_accuracy,
        coalesce(avg(coalesce(s.completeness, 0)::DOUBLE), 0) AS avg_completeness
        FROM (SELECT doc_id AS query_id FROM documents) q LEFT JOIN v_scores s ON s.query_id = q.query_id"""
    golden_judge = """SELECT coalesce(avg(coalesce(s.accuracy, 0)::DOUBLE), 0) AS avg_accuracy,
        coalesce(avg(coalesce(s.completeness, 0)::DOUBLE), 0) AS avg_completeness
        FROM v_golden q LEFT JOIN v_scores s ON s.query_id = q.query_id"""
    s = {}
    s["scan_filter_classify"] = _with(["v_files"]) + """SELECT path,
        CASE WHEN ends_with(path, '.json') THEN 'metadata' ELSE 'source' END AS kind
        FROM v_files WHERE ends_with(path, '.py') OR ends_with(path, '.json')"""
    s["content_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
    p = _q(URL_PATTERN)
    s["parse_repo_url"] = "SELECT page_id, " + ", ".join(
        f"CASE WHEN regexp_matches(url, {p}) THEN regexp_extract(url, {p}, {i}) END AS {n}"
        for i, n in enumerate(["owner", "repo", "branch", "path"], 1)) + " FROM pages"
    s["normalize_path"] = _with(["v_golden"]) + \
        f"SELECT query_id, {_norm('expected_file')} AS norm_path FROM v_golden"
    s["entity_name"] = f"""SELECT cast(n_nationkey AS bigint) AS n_nationkey, {_title('s')} AS entity FROM
        (SELECT n_nationkey, replace(string_split('a/b/' || n_name, '/')[-1], '_', '') AS s FROM nation)"""
    s["snake_case"] = f"SELECT p_partkey, {_snake('p_brand')} AS brand_snake, {_snake('p_name')} AS name_snake FROM part"
    s["hook_tag"] = f"""SELECT event_id, CASE WHEN event_type IN ({hook_list}) THEN event_type ELSE '' END AS hook_type,
        CASE WHEN contains(event_type, 'sign') THEN {_q(tx.DOCTYPE_LABEL)} ELSE '' END AS doctype FROM events"""
    s["tokenize"] = f"""SELECT doc_id, cast(pos - 1 AS bigint) AS pos, token FROM
        (SELECT doc_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM
         (SELECT doc_id, {_tokens('text')} AS toks FROM documents))"""
    s["simple_name"] = _with(["v_sites"]) + """SELECT caller_id, cast(ordinal AS bigint) AS ordinal,
        string_split(raw_callee, '.')[-1] AS callee FROM v_sites"""
    qp, dp = _q(tx.QUERY_PREFIX), _q(tx.DOCUMENT_PREFIX)
    s["embed_prefix"] = _with(["v_queries"]) + f"""SELECT query_id AS id, 'query' AS kind, md5({qp} || query) AS text_md5,
        cast(length({qp} || query) AS bigint) AS text_len FROM v_queries
        UNION ALL SELECT doc_id, 'document', md5({dp} || text), cast(length({dp} || text) AS bigint) FROM documents"""
    s["prompt_build"] = _prompt_sql()
    s["violation_text"] = _with(["v_invoice"]) + f"""SELECT invoice_id, {_q(rules.ERR_POS_AMOUNT)} || ': total paid ' ||
        cast(cast(paid_amount + write_off AS decimal(18,2)) AS varchar) || ' exceeds invoice total ' ||
        cast(cast(total AS decimal(18,2)) AS varchar) AS text FROM
        (SELECT *, CASE WHEN rounded_total > 0 THEN rounded_total ELSE grand_total END AS total FROM v_invoice)
        WHERE {POS_WHERE}"""
    s["structural_chunks"] = f"""WITH li AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(0, len(l) - 1)) AS pos
            FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)),
        fl AS (SELECT doc_id, pos, line, sum(CASE WHEN pos = 0 OR length(line) > 120 THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM li)
        SELECT doc_id, cast(seg AS bigint) AS seg, cast(min(pos) + 1 AS bigint) AS start_line,
            cast(max(pos) + 1 AS bigint) AS end_line, md5(string_agg(line, {NL} ORDER BY pos)) AS text_md5
        FROM fl GROUP BY doc_id, seg"""
    s["graph_nodes"] = _with(["v_nodes"]) + """SELECT node_id, type, name, parent_class FROM
        (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord DESC) AS rn FROM
         (SELECT node_id, type, name, parent_class, 0 AS ord FROM v_nodes
          UNION ALL SELECT node_id, type, lower(name), 'rewritten', 1 FROM v_nodes WHERE type = 'class'))
        WHERE rn = 1"""
    s["contains_edges"] = _with(["v_contains"]) + "SELECT src, dst, type FROM v_contains"
    s["symbol_table"] = _with(["v_defs"]) + symtab
    s["resolve_calls"] = _with(["v_defs", "v_sites"], [
        ("st", symtab),
        ("nodes", "SELECT node_id FROM v_defs UNION ALL SELECT 'order:' || cast(o_orderkey AS varchar) FROM orders")]) + \
        """SELECT s.caller_id AS src, st.node_id AS dst, 'CALLS' AS type, cast(s.ordinal AS bigint) AS ordinal
        FROM v_sites s JOIN st ON st.name = string_split(s.raw_callee, '.')[-1]
        WHERE s.caller_id IN (SELECT node_id FROM nodes) AND st.node_id IN (SELECT node_id FROM nodes)"""
    s["edge_keys"] = _with(["v_calls"]) + """SELECT src, dst, l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber,
        l_partkey, cast(row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey, l_linenumber, l_partkey) - 1
        AS bigint) AS key FROM v_calls"""
    s["induced_subgraph"] = _with(["v_contains", "v_calls", "v_nodes"], [("e", EDGES_ALL), ("sel", sel_nodes)]) + \
        "SELECT src, dst, type FROM e WHERE src IN (SELECT node_id FROM sel) AND dst IN (SELECT node_id FROM sel)"
    s["simple_edges"] = _with(["v_contains", "v_calls"], [("e", EDGES_ALL)]) + "SELECT DISTINCT src, dst FROM e"
    mid = lambda c: f"translate({c}, {BS} || '/:.', '____')"
    s["mermaid_lines"] = _with(["v_contains", "v_calls"], [("e", EDGES_ALL)]) + f"""SELECT src, dst, '    ' || {mid('src')} || '["' || {_label('src')}
        || '"] --> ' || {mid('dst')} || '["' || {_label('dst')} || '"]' AS line
        FROM (SELECT DISTINCT src, dst FROM e)"""
    s["khop_neighbors"] = _with(["v_contains", "v_calls", "v_nodes"], [
        ("e", EDGES_ALL),
        ("walk", f"""SELECT node_id, 0 AS depth FROM v_nodes WHERE node_id = {_q(KHOP_SEED)}
            UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node_id WHERE w.depth < {KHOP_K}""")],
        recursive=True) + "SELECT node_id, cast(min(depth) AS bigint) AS depth FROM walk GROUP BY node_id"
    s["khop_by_seed"] = _with(["v_contains", "v_calls", "v_nodes"], [
        ("e", "SELECT DISTINCT src, dst FROM (" + EDGES_ALL + ")"), ("sel", sel_nodes),
        ("walk", f"""SELECT node_id AS seed_id, node_id, 0 AS depth FROM sel
            UNION SELECT w.seed_id, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node_id WHERE w.depth < {KHOP_K}"""),
        ("near", "SELECT seed_id, node_id, min(depth) AS depth FROM walk GROUP BY seed_id, node_id")],
        recursive=True) + """SELECT n.seed_id, n.node_id, cast(n.depth AS bigint) AS depth, min(p.node_id) AS previous
        FROM near n LEFT JOIN e ON e.dst = n.node_id AND n.depth > 0
        LEFT JOIN near p ON p.seed_id = n.seed_id AND p.node_id = e.src AND p.depth = n.depth - 1 GROUP BY 1, 2, 3"""
    s["delta_classify"] = _with(["v_cur", "v_prev_state"]) + classify
    s["delta_filter"] = _with(["v_cur", "v_prev_state"]) + f"SELECT doc_id, path, content_hash FROM ({changed})"
    s["next_state"] = _with(["v_cur", "v_prev_state"], [("changed", changed)]) + f"""SELECT path, content_hash FROM v_cur c
        WHERE EXISTS (SELECT 1 FROM v_prev_state p WHERE p.path = c.path AND p.content_hash = c.content_hash)
        UNION ALL SELECT path, content_hash FROM changed WHERE contains(content, {NL})"""
    s["drop_bad_vectors"] = _with(["v_chunks"]) + f"""SELECT id, doc_id FROM
        (SELECT id, doc_id, CASE WHEN doc_id % 11 = 0 THEN vector[1:{VECTOR_DIM - 1}] ELSE vector END AS v FROM v_chunks)
        WHERE v IS NOT NULL AND len(v) = {VECTOR_DIM} AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR isnan(x)))"""
    s["delete_by_file"] = _with(["v_chunks", "v_cur", "v_prev_state"], [("st", classify)]) + """SELECT id, doc_id
        FROM v_chunks c WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.path = c.file_path
        AND st.status IN ('changed', 'deleted'))"""
    s["upsert_chunks"] = _with(["v_chunks", "v_cur", "v_prev_state"], [
        ("chunks", "SELECT id, file_path, content FROM v_chunks"),
        ("old", "SELECT *, 'previous' AS version FROM chunks WHERE file_path IN (SELECT path FROM v_prev_state)"),
        ("todo", f"SELECT path FROM ({changed})"),
        ("new", "SELECT *, 'current' AS version FROM chunks WHERE file_path IN (SELECT path FROM todo)")]) + \
        """SELECT id, file_path, version, md5(content) AS content_md5 FROM old
        WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.file_path = old.file_path)
        UNION ALL SELECT id, file_path, version, md5(content) FROM new"""
    s["embed_hash"] = f"""WITH toks AS (SELECT doc_id, unnest({_tokens('text')}) AS tok FROM documents),
        cnt AS (SELECT doc_id, {bucket} AS b, count(*) AS n FROM toks GROUP BY 1, 2),
        nrm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM cnt GROUP BY 1),
        grid AS (SELECT d.doc_id, g.dim FROM documents d CROSS JOIN range(0, {EMBED_DIM}) g(dim))
        SELECT g.doc_id, cast(g.dim AS bigint) AS dim,
            round(CASE WHEN coalesce(nrm.norm, 0) > 0 THEN coalesce(cnt.n, 0) / nrm.norm ELSE 0.0 END, 6) AS value
        FROM grid g LEFT JOIN cnt ON cnt.doc_id = g.doc_id AND cnt.b = g.dim
        LEFT JOIN nrm ON nrm.doc_id = g.doc_id"""
    s["knn_topk"] = f"""SELECT query_id, cast(rank AS bigint) AS rank, vec_id, round(dist, 6) AS dist FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM
         (SELECT q.vec_id AS query_id, c.vec_id, {_sqdist('q.embedding', 'c.embedding')} AS dist
          FROM embeddings q, embeddings c)) WHERE rank <= {KNN_K}"""
    doc_corpus = "SELECT doc_id AS id, text FROM documents"
    # one pass over the texts: only how many documents hold a term matters
    s["bm25_stats"] = f"""WITH t AS MATERIALIZED (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM documents),
        f AS MATERIALIZED (SELECT term, count(*) AS df FROM t GROUP BY term),
        n AS (SELECT count(*) AS n FROM documents),
        r AS MATERIALIZED (SELECT term, df, ln(n.n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM f, n),
        m AS (SELECT avg(idf_raw) AS m FROM r)
        SELECT term, cast(df AS bigint) AS df, round(idf_raw, 6) AS idf_raw,
            round(CASE WHEN idf_raw < 0 THEN 0.25 * m.m ELSE idf_raw END, 6) AS idf FROM r, m"""
    s["bm25_score"] = _with(["v_queries"], _bm25_ctes(doc_corpus, "SELECT query_id, query FROM v_queries")) + \
        "SELECT query_id, id AS doc_id, round(score, 6) AS score FROM c_scores"
    s["bm25_topk"] = _with(["v_queries"], _bm25_topn_ctes(doc_corpus, "SELECT query_id, query FROM v_queries",
                                                          BM25_N)) + \
        "SELECT query_id, cast(rank AS bigint) AS rank, id AS doc_id, score FROM c_top"
    s["rrf_fuse"] = _with(["v_chunks", "v_queries"], _hybrid_ctes()) + \
        "SELECT query_id, cast(rank AS bigint) AS rank, id, round(score, 8) AS score FROM hyb"
    s["hybrid_search"] = _with(["v_chunks", "v_queries"], _hybrid_ctes()) + \
        "SELECT query_id, cast(rank AS bigint) AS rank, id, file_path, round(score, 8) AS score FROM hyb_rows"
    s["context_render"] = _context_sql()
    s["question_prompt"] = _question_prompt_sql()
    s["first_relevant_rank"] = _with(["v_golden", "v_paths"], _golden_ctes()) + \
        "SELECT query_id, cast(rank AS bigint) AS rank FROM g_ranks"
    s["retrieval_metrics"] = _with(["v_golden", "v_paths"], _golden_ctes()) + ranks_metrics
    s["judge_averages"] = _with(["v_scores"]) + \
        f"SELECT round(avg_accuracy, 6) AS avg_accuracy, round(avg_completeness, 6) AS avg_completeness FROM ({judge})"
    s["benchmark_summary"] = _with(["v_golden", "v_paths", "v_scores"], _golden_ctes() + [
        ("m", ranks_metrics), ("j", golden_judge)]) + """SELECT n_queries, hit_rate, mrr,
        round(avg_accuracy, 6) AS avg_accuracy, round(avg_completeness, 6) AS avg_completeness FROM m, j"""
    s["eval_report"] = _with(["v_golden", "v_paths", "v_scores"], _golden_ctes()) + """SELECT r.query_id,
        r.rank IS NOT NULL AS found, cast(r.rank AS bigint) AS rank, coalesce(cast(r.rank AS varchar), 'N/A') AS rank_text,
        cast(coalesce(s.accuracy, 0) AS bigint) AS accuracy, cast(coalesce(s.completeness, 0) AS bigint) AS completeness,
        CASE WHEN s.accuracy IS NULL AND s.completeness IS NULL THEN 'Judge failed' END AS rationale
        FROM g_ranks r LEFT JOIN v_scores s ON s.query_id = r.query_id"""
    s["run_log_row"] = _with(["v_golden", "v_paths", "v_scores"], _golden_ctes() + [
        ("m", ranks_metrics.replace("round(", "(").replace(", 6)", ")")), ("j", judge)]) + \
        f"""SELECT {_q(PROMPT_ENTITY)} AS entity, cast(500 AS bigint) AS chunk_size, round(j.avg_accuracy, 6) AS accuracy,
        round(m.mrr, 6) AS mrr, cast(1 AS bigint) AS n_artifacts FROM m, j"""
    s["parity_compare"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + f"""SELECT expected,
        actual, cast(count(*) AS bigint) AS n, expected IS NOT DISTINCT FROM actual AS match FROM
        (SELECT {_outcome('0')} AS expected, {_outcome(TOL)} AS actual FROM inv) GROUP BY 1, 2"""
    s["rule_pos"] = _with(["v_invoice"]) + f"""SELECT invoice_id, {_q(rules.ERR_POS_AMOUNT)} AS code,
        'total paid ' || cast(cast(paid_amount + write_off AS decimal(18,2)) AS varchar) || ' exceeds invoice total '
        || cast(cast(total AS decimal(18,2)) AS varchar) AS details FROM
        (SELECT *, CASE WHEN rounded_total > 0 THEN rounded_total ELSE grand_total END AS total FROM v_invoice)
        WHERE {POS_WHERE}"""
    s["rule_credit"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + \
        f"""SELECT invoice_id, {_q(rules.ERR_CREDIT_LIMIT)} AS code FROM inv
        WHERE (NOT bypass_credit OR unl = 1) AND coalesce(exceeded, true)"""
    s["rule_dropship"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + \
        f"SELECT invoice_id, {_q(rules.ERR_DROP_SHIP)} AS code FROM inv WHERE update_stock AND sup = 1"
    s["rule_intercompany"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + \
        f"""SELECT invoice_id, {_q(rules.ERR_INTER_COMPANY)} AS code FROM inv
        WHERE coalesce(inter_company_ref, '') = '' AND is_internal AND NOT allowed"""
    s["qualified_id"] = """SELECT n_nationkey, concat_ws(':', r_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL
        ELSE n_name END, 'handler') AS qualified_id FROM nation JOIN region ON n_regionkey = r_regionkey"""
    s["list_membership"] = _with(["v_allowed", "v_invoice"]) + """SELECT i.invoice_id,
        EXISTS (SELECT 1 FROM v_allowed a WHERE a.customer = i.customer AND a.company = i.company) AS allowed
        FROM v_invoice i"""
    s["validate_pipeline"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + \
        f"SELECT invoice_id, {_outcome(TOL)} AS code FROM inv"
    s["validate_rules"] = _with(["v_items", "v_invoice", "v_credit", "v_allowed"], _rules_ctes()) + \
        f"SELECT code, cast(count(*) AS bigint) AS n FROM (SELECT {_outcome(TOL)} AS code FROM inv) GROUP BY 1"
    return s
