"""Scalar functions as Spark Column expressions.

All of them compile to built-in Catalyst expressions, so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

import string
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Lifecycle hook names that tag a symbol.
HOOK_NAMES = (
    "validate", "before_validate", "after_validate",
    "on_submit", "before_submit", "on_cancel",
    "on_update", "after_insert", "before_save",
    "on_trash", "after_delete",
)
# Doctype label of a class whose name holds the substring.
DOCTYPE_SUBSTRING = "SalesInvoice"
DOCTYPE_LABEL = "Sales Invoice"
# Repository URL pattern, matched at the start of the text only.
REPO_URL_PATTERN = r"https://github\.com/([^/]+)/([^/]+)/tree/([^/]+)/(.*)"
# Embedding prefixes.
QUERY_PREFIX = "search_query: "
DOCUMENT_PREFIX = "search_document: "
# Extensions kept by the file scan, and the one that marks metadata files.
DEFAULT_EXTENSIONS = (".py", ".json")
METADATA_EXTENSION = ".json"
# Default-query text and template-choice needle.
DEFAULT_QUERY_PREFIX = "Overview of "
FLOW_NEEDLE = "flow"
# Prompt templates, keyed by name.
TEMPLATES = {
    "process_flow": """
        ## Domain Context: {entity_name} (Selling Bounded Context)
        Act as a Senior System Analyst. Explain the step-by-step internal execution flow.

        {context_data}

        INSTRUCTIONS:
        1. Use the 'Call Flow' section to trace logic.
        2. Group by VALIDATION, ACCOUNTING, and STOCK phases.
    """,
    "debugging": """
        ## Domain Context: {entity_name} (Technical Logic Trace)
        Act as a Lead Developer. Help me understand the specific logic for: {user_query}.

        {context_data}
    """,
}
# ---------------------------------------------------------------------------

# Characters Python's ``str.split()`` treats as blanks (it is wider than
# Java's ASCII ``\s``), as a Java regex character class.
PY_BLANKS = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 ------------------------------------------------------------------------
def content_hash(text) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(_col(text), 256)


# F2 ------------------------------------------------------------------------
def parse_repo_url(url, pattern: str = REPO_URL_PATTERN) -> Column:
    """Struct(owner, repo, branch, path) from a 4-group pattern; null when the
    text does not match.  Anchored at the start like ``re.match``."""
    p = pattern if pattern.startswith("^") else "^(?:" + pattern + ")"
    u = _col(url)
    parts = [F.regexp_extract(u, p, i) for i in range(1, 5)]
    return F.when(u.rlike(p), F.struct(
        parts[0].alias("owner"), parts[1].alias("repo"),
        parts[2].alias("branch"), parts[3].alias("path")))


# F3 ------------------------------------------------------------------------
def normalize_path(path) -> Column:
    """Backslashes to slashes, then lower case."""
    return F.lower(F.translate(_col(path), "\\", "/"))


# F4 ------------------------------------------------------------------------
def _cased(ch: Column) -> Column:
    return F.lower(ch) != F.upper(ch)


def py_title(text) -> Column:
    """Python ``str.title()``: a cased character is upper-cased when the
    character before it is not cased, lower-cased otherwise."""
    chars = F.split(_col(text), "")
    out = F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~_cased(F.get(chars, i - 1)), F.upper(ch)).otherwise(F.lower(ch)))
    return F.array_join(out, "")


def entity_name(path) -> Column:
    """Last path segment, underscores dropped, title-cased."""
    last = F.element_at(F.split(_col(path), "/"), -1)
    return py_title(F.replace(last, F.lit("_"), F.lit("")))


# F5 ------------------------------------------------------------------------
def snake_case(name) -> Column:
    """``_`` before each upper-case letter, leading underscores stripped,
    lower-cased."""
    s = F.regexp_replace(_col(name), r"(\p{Lu})", "_$1")
    return F.lower(F.regexp_replace(s, "^_+", ""))


# F6 ------------------------------------------------------------------------
def mermaid_id(node_id) -> Column:
    """``\\ / : .`` become ``_`` (not injective)."""
    return F.translate(_col(node_id), "\\/:.", "____")


# F7 ------------------------------------------------------------------------
def node_label(node_id) -> Column:
    """Text after the last ``:`` when there is one, else after the last ``/``."""
    n = _col(node_id)
    return F.when(n.contains(":"), F.element_at(F.split(n, ":"), -1)) \
        .otherwise(F.element_at(F.split(n, "/"), -1))


# F8 ------------------------------------------------------------------------
def hook_tag(name, hooks: Iterable[str] = HOOK_NAMES, empty_as: str | None = None) -> Column:
    """The name when it is a hook name; otherwise null (chunks) or
    ``empty_as`` (graph nodes use ``""``)."""
    n = _col(name)
    tag = F.when(n.isin(list(hooks)), n)
    return tag if empty_as is None else F.coalesce(tag, F.lit(empty_as))


# F9 ------------------------------------------------------------------------
def doctype_tag(class_name, substring: str = DOCTYPE_SUBSTRING,
                label: str = DOCTYPE_LABEL) -> Column:
    return F.when(_col(class_name).contains(substring), F.lit(label)).otherwise(F.lit(""))


# F10 -----------------------------------------------------------------------
def tokenize(text) -> Column:
    """Lower-case, split on blank runs, drop empties; punctuation stays."""
    return F.filter(F.split(F.lower(_col(text)), PY_BLANKS), lambda t: t != "")


# F11 -----------------------------------------------------------------------
def simple_name(raw_callee) -> Column:
    """Text after the last ``.`` of a called expression."""
    return F.element_at(F.split(_col(raw_callee), r"\."), -1)


# F12 -----------------------------------------------------------------------
def qualified_id(*parts) -> Column:
    """``P``, ``P:C``, ``P:C:f`` or ``P:f``; null parts are skipped."""
    return F.concat_ws(":", *[_col(p) for p in parts])


def chunk_id(file_path, symbol_name) -> Column:
    return F.concat(_col(file_path), F.lit(":"), _col(symbol_name))


# F13 -----------------------------------------------------------------------
def embed_prefix(text, is_query: bool, legacy_prefix: bool = False) -> Column:
    """Task prefix for the embedder.  ``legacy_prefix=True`` reproduces the
    reference's query call sites, which embed queries as documents."""
    prefix = QUERY_PREFIX if (is_query and not legacy_prefix) else DOCUMENT_PREFIX
    return F.concat(F.lit(prefix), _col(text))


# F14 -----------------------------------------------------------------------
def template_choice(query, needle: str = FLOW_NEEDLE) -> Column:
    return F.when(F.lower(_col(query)).contains(needle), F.lit("process_flow")) \
        .otherwise(F.lit("debugging"))


# F15 -----------------------------------------------------------------------
def default_query(query, entity) -> Column:
    """The query, or ``Overview of <entity>`` when it is null or empty."""
    return F.coalesce(F.nullif(_col(query), F.lit("")),
                      F.concat(F.lit(DEFAULT_QUERY_PREFIX), _col(entity)))


# F16 -----------------------------------------------------------------------
def tolerance(precision) -> Column:
    """``1 / 10^(precision+1)`` as a double."""
    return F.lit(1.0) / F.pow(F.lit(10.0), _col(precision) + 1)


# F17 -----------------------------------------------------------------------
def violation_text(code, details) -> Column:
    """``code: details``, or ``code`` when details are null or empty."""
    d = _col(details)
    return F.when(d.isNotNull() & (d != ""), F.concat(_col(code), F.lit(": "), d)) \
        .otherwise(_col(code))


def money2(x) -> Column:
    """Two-decimal text of an amount (decimal rounding, so engines agree)."""
    return _col(x).cast("decimal(18,2)").cast("string")


# F18 -----------------------------------------------------------------------
def list_contains(values, item) -> Column:
    """Membership; a null list counts as not containing the item."""
    return F.coalesce(F.array_contains(_col(values), _col(item)), F.lit(False))


# F19 -----------------------------------------------------------------------
def format_template(template: str, **fields) -> Column:
    """``template.format(**fields)`` where field values are Columns.

    The template is split into literal text and named fields once, on the
    driver, so substituted values are never re-scanned for placeholders.
    """
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported")
            parts.append(_col(fields[field]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def phase_prompt(template_name, entity, query, context) -> Column:
    """Fill the template chosen by ``template_name`` (a Column of names)."""
    expr = None
    for name, tpl in TEMPLATES.items():
        filled = format_template(tpl, entity_name=entity, user_query=query, context_data=context)
        expr = F.when(_col(template_name) == name, filled) if expr is None \
            else expr.when(_col(template_name) == name, filled)
    return expr


# S1 / S2 helpers -----------------------------------------------------------
def has_extension(path, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> Column:
    """Case-sensitive suffix test against any of the extensions."""
    p = _col(path)
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | p.endswith(ext)
    return cond


def file_kind(path) -> Column:
    return F.when(_col(path).endswith(METADATA_EXTENSION), F.lit("metadata")) \
        .otherwise(F.lit("source"))
