"""Symbol extraction from Python source files
and the symbol graph built from it (§2.5 G1-G6).

The only Python stage is :func:`extract_symbols`: a ``mapInPandas`` over the
file table that parses each file with the standard-library ``ast`` module and
emits flat rows -- one per class / function definition (pre-order), one per
call site inside a function, one per file, and one per parse failure.  All
later work (chunk tables, node ids, the caller lookup, the last-write-wins
symbol table, call resolution, edge keys) is joins and aggregations in
Catalyst.  Put the delta anti-join *before* this stage so only changed files
reach Python.

Known difference: ``ast`` rejects a file with a syntax error as a whole (the
file gets an error row and no symbols); an error-recovering parser would
keep the valid parts.
"""

from __future__ import annotations

import ast
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .graph import build_nodes, edge_keys, resolve_calls, symbol_table

EXTRACT_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("kind", T.StringType()),          # file | symbol | call | error
    T.StructField("ordinal", T.IntegerType()),      # pre-order position within the file
    T.StructField("name", T.StringType()),          # symbol name / caller name for calls
    T.StructField("symbol_type", T.StringType()),   # class | method | function
    T.StructField("raw_type", T.StringType()),      # class_definition | function_definition
    T.StructField("class_name", T.StringType()),    # enclosing class (graph scope)
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("raw_callee", T.StringType()),
    T.StructField("error", T.StringType()),
])
_COLS = [f.name for f in EXTRACT_SCHEMA.fields]

CLASS_RAW = "class_definition"
FUNCTION_RAW = "function_definition"


_LINE_END = re.compile(rb"\r\n|\n|\r")


class _Extractor:
    """Walks one module in source pre-order."""

    def __init__(self, path: str, text: str):
        self.path = path
        # a byte-order mark is no part of the program; line ends are those
        # that the parser counts: LF, CR LF and CR
        self.data = text.removeprefix("\ufeff").encode("utf-8")
        self.starts = [0] + [m.end() for m in _LINE_END.finditer(self.data)]
        self.rows: list[dict] = []
        self.n_sym = 0
        self.n_call = 0

    def _span(self, node) -> str:
        a = self.starts[node.lineno - 1] + node.col_offset
        b = self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.data[a:b].decode("utf-8", "replace")

    def _symbol(self, node, symbol_type: str, raw: str, current_class):
        self.rows.append(dict(file_path=self.path, kind="symbol", ordinal=self.n_sym, name=node.name,
                              symbol_type=symbol_type, raw_type=raw, class_name=current_class,
                              start_line=node.lineno, end_line=node.end_lineno, content=self._span(node)))
        self.n_sym += 1

    def visit(self, node, current_class, caller, in_class_body: bool):
        if isinstance(node, ast.ClassDef):
            for d in node.decorator_list:
                self.visit(d, current_class, caller, False)
            self._symbol(node, "class", CLASS_RAW, current_class)
            for child in node.bases + node.keywords:
                self.visit(child, current_class, caller, False)
            for stmt in node.body:
                self.visit(stmt, node.name, caller, True)
            return
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in node.decorator_list:
                self.visit(d, current_class, caller, False)
            method = in_class_body and not node.decorator_list
            self._symbol(node, "method" if method else "function", FUNCTION_RAW, current_class)
            rest = [node.args] + ([node.returns] if node.returns else []) + node.body
            for child in rest:
                self.visit(child, current_class, node.name, False)
            return
        if isinstance(node, ast.Call) and caller is not None:
            self.rows.append(dict(file_path=self.path, kind="call", ordinal=self.n_call, name=caller,
                                  raw_callee=self._span(node.func)))
            self.n_call += 1
        for child in ast.iter_child_nodes(node):
            self.visit(child, current_class, caller, False)

    def run(self) -> list[dict]:
        self.rows.append(dict(file_path=self.path, kind="file", ordinal=-1, name=self.path))
        try:
            tree = ast.parse(self.data.decode("utf-8"), filename=self.path)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.rows.append(dict(file_path=self.path, kind="error", ordinal=0,
                                  error=f"{type(e).__name__}: {e}"))
            return self.rows
        for stmt in tree.body:
            self.visit(stmt, None, None, False)
        return self.rows


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[dict] = []
        for path, text in zip(pdf["file_path"], pdf["content"]):
            try:
                rows.extend(_Extractor(path, text if text is not None else "").run())
            except Exception as e:  # noqa: BLE001 -- one bad file never stops the job
                rows.append(dict(file_path=path, kind="error", ordinal=0, error=f"{type(e).__name__}: {e}"))
        # Column-wise object lists: all-null columns stay object (not float NaN).
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLS})


def extract_symbols(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """C1/C2/C4/I4 raw rows (``EXTRACT_SCHEMA``) for a table of files."""
    src = files.select(F.col(path_col).alias("file_path"), F.col(content_col).alias("content"))
    return src.mapInPandas(_extract_batches, EXTRACT_SCHEMA)


# ---------------------------------------------------------------------------
# Chunk tables
# ---------------------------------------------------------------------------
def symbol_chunks(extracted: DataFrame, style: str = "symbol") -> DataFrame:
    """C1 (``style="symbol"``: class/method/function, functions tagged with
    their hook name) or C2 (``style="raw"``: grammar names, classes tagged
    too).  The id is ``file:symbol``, shared by same-named symbols of a file;
    ``ordinal`` keeps them apart."""
    s = extracted.filter(F.col("kind") == "symbol")
    if style == "symbol":
        stype = F.col("symbol_type")
        hook = F.when(F.col("raw_type") == FUNCTION_RAW, tx.hook_tag("name"))
    elif style == "raw":
        stype = F.col("raw_type")
        hook = tx.hook_tag("name")
    else:
        raise ValueError(style)
    return s.select(tx.chunk_id("file_path", "name").alias("id"), "file_path",
                    F.col("name").alias("symbol_name"), stype.alias("symbol_type"), "content",
                    "start_line", "end_line", hook.alias("hook_type"),
                    F.col("class_name").alias("parent_class"), "ordinal")


def extraction_errors(extracted: DataFrame) -> DataFrame:
    """I4: files that failed, with the message."""
    return extracted.filter(F.col("kind") == "error").select("file_path", "error")


# ---------------------------------------------------------------------------
# Graph
# ---------------------------------------------------------------------------
def graph_rows(extracted: DataFrame) -> DataFrame:
    """Node rows with node ids (§1 grammar) and a corpus-wide order key."""
    s = extracted.filter(F.col("kind").isin("file", "symbol"))
    is_class = F.col("symbol_type") == "class"
    node_id = (F.when(F.col("kind") == "file", F.col("file_path"))
               .when(is_class, tx.qualified_id("file_path", "name"))
               .otherwise(tx.qualified_id("file_path", "class_name", "name")))
    ntype = F.when(F.col("kind") == "file", F.lit("file")).when(is_class, F.lit("class")).otherwise(F.lit("function"))
    return s.select(
        node_id.alias("node_id"), ntype.alias("type"), "name", "file_path", "ordinal", "kind",
        F.when(is_class, tx.doctype_tag("name")).alias("doctype"),
        F.when(~is_class & (F.col("kind") == "symbol"), F.coalesce("class_name", F.lit(""))).alias("parent_class"),
        F.when(~is_class & (F.col("kind") == "symbol"), tx.hook_tag("name", empty_as="")).alias("hook_type"),
        F.when(F.col("kind") == "symbol",
               F.when(is_class, F.col("file_path"))
               .otherwise(F.coalesce(tx.qualified_id("file_path", "class_name"), F.col("file_path"))))
        .alias("parent_id"))


def build_graph(extracted: DataFrame, source_suffix: str = ".py") -> tuple[DataFrame, DataFrame]:
    """G1-G6 over a whole corpus, two-pass: every symbol is known before any
    call is resolved.

    Returns ``nodes`` (one per id, last attributes win in (path, ordinal)
    order) and ``edges(src, dst, type, key)`` with CONTAINS edges (repeats
    kept as parallel edges) and one CALLS edge per resolved call site.
    """
    ex = extracted.filter(F.col("file_path").endswith(source_suffix))
    rows = graph_rows(ex)
    order = F.struct("file_path", "ordinal")
    nodes = build_nodes(rows.withColumn("_ord", order), order_col="_ord")
    sym = rows.filter(F.col("kind") == "symbol")
    contains = sym.select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"),
                          F.lit("CONTAINS").alias("type"), F.lit(0).alias("_phase"), "file_path", "ordinal")
    # Caller id: first node of the file (insertion order) named like the
    # enclosing function.
    callers = sym.groupBy("file_path", "name").agg(F.min_by("node_id", F.col("ordinal")).alias("caller_id"))
    calls = ex.filter(F.col("kind") == "call").join(callers, ["file_path", "name"])
    table = symbol_table(sym.select("name", "node_id", F.struct("file_path", "ordinal").alias("_ord")), ["_ord"])
    resolved = resolve_calls(calls.select("caller_id", "raw_callee", "file_path", "ordinal"), table, nodes)
    call_edges = resolved.select("src", "dst", "type", F.lit(1).alias("_phase"), "file_path", "ordinal")
    edges = edge_keys(contains.unionByName(call_edges), ["_phase", "file_path", "ordinal"])
    return nodes, edges.select("src", "dst", "type", "key")
