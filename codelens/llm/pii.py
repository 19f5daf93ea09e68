"""Personal data and the words that give it away, DataFrame functions only.

Base spans (addresses, numbers) come from fixed patterns.  Around each of them
the corpus is asked which terms disclose it: the point-wise mutual information
of term and entity, as a share of the entity's own information content, is 1
when a term occurs nowhere but next to the entity and near 0 when it is
independent.  Terms above the upper threshold are removed, terms above the
lower one are generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh

# Kinds in report order; a disclosing term comes after the base kinds.
KINDS = ("email", "ip", "card", "phone", "term")

# The base patterns of the contract in a form that never backtracks over a
# long run: a match can only begin where its run begins or where the last
# match ended, and inner runs are possessive.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_TERM = r"[\p{L}\p{M}\p{N}]+"

CONTEXT_CHARS = 120
MIN_CONTEXTS = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.95


def located(text: Column, pattern: str) -> Column:
    """Array of ``(s, v)``: code-point start and value of every match.

    The pieces between the matches give the offsets.  ``text`` must be a
    plain column: it is used several times."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("v"))
    none = F.array().cast("array<struct<s:int,v:string>>")
    return F.aggregate(
        zipped, F.struct(F.lit(0).alias("p"), none.alias("out")),
        lambda a, x: F.struct(
            (a["p"] + F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0))).alias("p"),
            F.when(x["v"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
                (a["p"] + F.length(x["g"])).alias("s"), x["v"].alias("v"))))).alias("out")),
        lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when(
            (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(digits, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n_digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    if kind == "ip":
        return v.rlike(_IP_PARTS)
    if kind == "card":
        return n_digits.between(12, 19) & _luhn(F.regexp_replace(v, "[^0-9]", ""))
    if kind == "phone":
        return n_digits.between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _valid(kind, x["v"])


def _span(k: int, n: int):
    def make(x):
        end = x["s"] + F.length(x["v"])
        return F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), end.alias("e"), x["v"].alias("v"),
            F.substring("t", F.greatest(x["s"] - n, F.lit(0)) + 1, F.least(x["s"], F.lit(n))).alias("left"),
            F.substring("t", end + 1, F.lit(n)).alias("right"), F.length("t").alias("size"))
    return make


def _placed(at: str):
    return lambda x: F.struct((F.col(at) + x["s"]).alias("ts"), (F.col(at) + x["s"] + F.length(x["v"])).alias("te"),
                              F.lower(x["v"]).alias("term"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base): ``base`` is the sorted array of ``(s, k, e, v,
    left, right, size)`` with the kind's index ``k``, the context on either
    side and the text's length; ``th`` identifies the text, so rows that
    share an id are told apart."""
    n = CONTEXT_CHARS
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    might = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+"),
             "ip": F.col("t").rlike(PATTERNS["ip"]), "card": F.col("t").rlike(PATTERNS["card"])}
    kind_type = "array<struct<s:int,k:int,e:int,v:string,left:string,right:string,size:int>>"
    found = []
    for k, kind in enumerate(KINDS[:4]):
        hits = F.when(might[kind], located(F.col("t"), PATTERNS[kind]))
        found.append(F.coalesce(F.transform(F.filter(hits, _checker(kind)), _span(k, n)), F.array().cast(kind_type)))
    return d.select("doc_id", F.xxhash64("t").alias("th"), F.sort_array(F.concat(*found)).alias("base"))


def _contexts(spans: DataFrame) -> DataFrame:
    """Every term near a base span: (doc_id, th, entity, window, term, ts, te).

    The context is up to ``CONTEXT_CHARS`` code points on either side, cut to
    whole terms; terms inside another base span are not counted."""
    n = CONTEXT_CHARS
    m = spans.select("doc_id", "th", "base", F.explode("base").alias("x"))
    names = F.array(*map(F.lit, KINDS))
    m = m.select(
        "doc_id", "th", "base", F.concat_ws(":", F.element_at(names, F.col("x.k") + 1), F.lower("x.v")).alias("entity"),
        (F.col("x.s") - F.length("x.left")).alias("ls"), F.col("x.e").alias("rs"), F.col("x.size").alias("size"),
        F.col("x.left").alias("left"), F.col("x.right").alias("right"))
    sides = F.concat(F.transform(located(F.col("left"), _TERM), _placed("ls")),
                     F.transform(located(F.col("right"), _TERM), _placed("rs")))
    m = m.select("doc_id", "th", "entity", F.xxhash64("left", "right").alias("window"), "base", "ls", "rs", "size",
                 F.explode_outer(sides).alias("w")).filter(F.col("w").isNotNull())
    inside = F.exists("base", lambda b: (F.col("w.ts") < b["e"]) & (F.col("w.te") > b["s"]))
    cut = ((F.col("w.ts") == F.col("ls")) & (F.col("ls") > 0)) \
        | ((F.col("w.te") == F.col("rs") + n) & (F.col("w.te") < F.col("size")))
    return m.filter(~inside & ~cut).select("doc_id", "th", "entity", "window", "w.term", "w.ts", "w.te")


def disclosure(docs: DataFrame, contexts: DataFrame, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(entity, term, n_both, score) for terms seen near an entity in at least
    ``min_contexts`` different contexts.

    The corpus counts as ``M`` contexts of average length.  With ``n(t)``
    occurrences of the term in all texts, ``n(e)`` contexts of the entity and
    ``n(t,e)`` of both, score = PMI(t;e) / IC(e)
    = 1 + log2(n(t,e) / n(t)) / log2(M / n(e)).  Copies of one context count
    once in ``n(t,e)`` and ``n(e)``, while ``n(t)`` counts every occurrence,
    so copies can only lower a score."""
    seen = contexts.select("entity", "window", "term").distinct()
    both = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")) \
        .filter(F.col("n_both") >= min_contexts)
    per_entity = contexts.select("entity", "window").distinct().groupBy("entity") \
        .agg(F.count(F.lit(1)).alias("n_entity"))
    length = contexts.groupBy("entity", "window").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.avg("n").alias("per_context"))
    # counted in the map tasks first, joined after
    terms = docs.select(F.explode_outer(F.regexp_extract_all(
        F.lower(F.coalesce("text", F.lit(""))), F.lit(_TERM), F.lit(0))).alias("term")) \
        .filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = materialize(terms, "pii-terms")
    total = terms.agg(F.sum("n_term").alias("n_all")).first()["n_all"] or 0
    per = length.first()["per_context"] or 1.0
    m = float(max(total, 1)) / max(per, 1.0)
    content = F.log2(F.lit(m) / F.col("n_entity"))
    return both.join(per_entity, "entity").join(terms, "term").filter(content > 0) \
        .select("entity", "term", "n_both",
                (1 + F.log2(F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))) / content).alias("score"))


def find(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per input row: ``doc_id, th, spans`` where ``spans`` is the
    sorted array of ``(s, k, e, remove)`` over base kinds and terms; a term is
    marked in the contexts of the entity that it discloses.

    Null and empty texts have no spans; rows with equal id and text get equal
    results; null ids are kept; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    spans = materialize(base_spans(docs), "pii-base")
    found = materialize(_contexts(spans), "pii-contexts")
    disclosing = disclosure(docs, found).filter(F.col("score") >= generalise_at)
    terms = found.join(disclosing.select("entity", "term", "score"), ["entity", "term"]) \
        .groupBy("doc_id", "th", "ts", "te").agg(F.max("score").alias("score")) \
        .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")) \
        .agg(F.collect_list(F.struct(F.col("ts").alias("s"), F.lit(4).alias("k"), F.col("te").alias("e"),
                                     (F.col("score") >= remove_at).alias("remove"))).alias("terms"))
    base = spans.select("doc_id", "th", F.transform("base", lambda b: F.struct(
        b["s"], b["k"], b["e"], F.lit(False).alias("remove"))).alias("base"))
    joined = base.join(terms, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.select("doc_id", "th", F.sort_array(F.concat(
        "base", F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int,remove:boolean>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, hash of the base spans, and all spans as a list."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(listed(F.filter("spans", lambda x: x["k"] < 4)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count(4).alias("n_term"))


def sanitise(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with the spans masked in ``text``: a base span and a
    generalised term become ``[KIND]``, a removed term disappears; of
    overlapping spans the first one counts.  Null text stays null."""
    found = find(docs) if found is None else found
    i, h, sp = (fresh(docs, x) for x in ("pii_id", "pii_hash", "pii_spans"))
    right = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("th").alias(h),
                                                     F.col("spans").alias(sp)).dropDuplicates([i, h])
    joined = docs.join(right, docs["doc_id"].eqNullSafe(F.col(i))
                       & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(h)), "left")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = docs["text"]
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    masked = F.aggregate(
        F.col(sp), F.struct(F.lit(0).alias("p"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] < a["p"], a).otherwise(F.struct(
            x["e"].alias("p"), F.concat(a["out"], cut(a["p"], x["s"]), F.when(x["remove"], "").otherwise(
                F.element_at(tags, x["k"] + 1))).alias("out"))),
        lambda a: F.concat(a["out"], cut(a["p"], F.length(text))))
    return joined.select(*[F.when(F.col(sp).isNull(), text).otherwise(masked).alias(c) if c == "text" else docs[c]
                           for c in docs.columns])
