"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and disclosing spans of every document."""
    from .pii import find, report
    return report(find(read_table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learned decision list's verdict on every document."""
    from .quality import quality_rules
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word-shingle Jaccard >= 0.85."""
    from .parity_join import jaccard_components
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) whose verified overlap leaks the item."""
    from .decontaminate import leaks
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fuzzy repeated lines removed: numbers of the
    removed lines, length and hash of the remaining text."""
    from .fuzzy_lines import dedup_lines
    done = dedup_lines(read_table(spark, sf_dir, "documents"), ("n_lines", "n_removed", "removed"))
    return done.select("doc_id", "n_lines", "n_removed",
                       F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                       F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated span that goes, with the document that keeps it."""
    from .sentence_spans import repeated_spans
    spans = repeated_spans(read_table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "first_doc_id", F.col("start").cast("long").alias("start"),
                        F.col("stop").cast("long").alias("stop"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word targets per source and what the mix takes of every document."""
    from .mixing import mix
    return mix(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract
    return extract(read_table(spark, sf_dir, "pages"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and context-mixing score of every document."""
    from .context_mixing import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and page by fused evidence."""
    from .language import evidence_rows, identify, labelled_documents, train
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    found = identify(evidence_rows(docs, pages), *train(labelled_documents(docs)))
    return found.select(F.when(F.col("source") == "documents", F.col("id")).alias("doc_id"),
                        F.when(F.col("source") == "pages", F.col("id")).alias("page_id"),
                        "lang", "confidence", "text_lang", "declared", "host")


def op11_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from .simhash_copies import near_copies
    return near_copies(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive of the embeddings."""
    from .hard_negatives import hard_negatives
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words, the first 2000 per language."""
    from .phrases import phrases
    return phrases(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_parity_join, op4_decontaminate, op5_fuzzy_lines,
                                   op6_mix_sources, op7_sentence_spans, op8_html_text, op9_context_mixing,
                                   op10_language, op11_simhash_copies, op12_hard_negatives,
                                   op13_phrases)}

# Words as in the contracts: runs of anything but the ASCII blanks.
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _prefix_sql(name: str, rows: str, budget: str) -> str:
    """CTEs ``{name}_run`` and ``{name}`` (source, stop, spent): how far along
    the hash order a source's budget reaches."""
    return f"""
    {name}_at AS (SELECT r.source, r.pos, sum(r.size) AS n, any_value(b.budget) AS budget
        FROM {rows} r JOIN {budget} b ON b.source IS NOT DISTINCT FROM r.source GROUP BY 1, 2),
    {name}_run AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY pos) AS cum FROM {name}_at),
    {name} AS (SELECT b.source, coalesce(min(CASE WHEN r.cum > b.budget THEN r.pos END), 1::BIGINT << 60) AS stop,
        coalesce(max(CASE WHEN r.cum <= b.budget THEN r.cum END), 0) AS spent
        FROM {budget} b LEFT JOIN {name}_run r ON b.source IS NOT DISTINCT FROM r.source GROUP BY 1)"""


_MIX_SQL = f"""WITH d AS (SELECT doc_id, source, {_SIZE} AS size,
        ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS pos FROM documents),
    s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY 1),
    k AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
    -- sources that fill up first come first: the level at which the rest share
    f AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, row_number() OVER o AS i FROM k
        WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST),
            before AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT coalesce(arg_min(level, i), 0) AS level FROM f WHERE 3 * source_size >= w * level),
    t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * l.level) AS target FROM f, l),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
    b1 AS (SELECT source, target - whole * source_size AS budget FROM p),
    {_prefix_sql("e1", "d", "b1")},
    b2 AS (SELECT b1.source, b1.budget - e1.spent AS budget, e1.stop FROM b1 JOIN e1 ON b1.source IS NOT DISTINCT FROM e1.source),
    d2 AS (SELECT d.source, d.pos, d.size FROM d JOIN b2 ON b2.source IS NOT DISTINCT FROM d.source
        WHERE d.pos >= b2.stop AND d.size <= b2.budget),
    {_prefix_sql("e2", "d2", "b2")},
    a AS (SELECT d.*, p.source_size, p.target, p.whole + CASE WHEN d.pos < b2.stop
            OR (d.size <= b2.budget AND d.pos < e2.stop) THEN 1 ELSE 0 END AS copies
        FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source JOIN b2 ON b2.source IS NOT DISTINCT FROM d.source
        JOIN e2 ON e2.source IS NOT DISTINCT FROM d.source)
    SELECT doc_id, cast(size AS BIGINT) AS size, cast(source_size AS BIGINT) AS source_size, target,
        cast(copies * size AS BIGINT) AS taken, cast(copies AS BIGINT) AS copies FROM a"""

_NEGATIVES_SQL = """WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT * FROM f WHERE vec_id % 50 = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, f.vec_id, f.label,
        cast(list_dot_product(a.v, f.v) AS BIGINT) AS score FROM a, f WHERE a.vec_id != f.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, cast(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
        positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE s.label != s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 3"""

_PHRASES_SQL = """WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
    p AS (SELECT lang, d, unnest(range(len(pieces))) AS i, unnest(pieces) AS piece FROM t),
    e AS (SELECT lang, d, i, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    x AS (SELECT lang, d, i, unnest(range(len(w))) AS j, unnest(w) AS w1 FROM e),
    y AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM x
        WINDOW o AS (PARTITION BY d, i ORDER BY j)),
    g AS (SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM y GROUP BY 1, 3
        UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM y WHERE w2 IS NOT NULL GROUP BY 1, 3
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM y WHERE w3 IS NOT NULL GROUP BY 1, 3),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= 10),
    k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp
        FROM c, (VALUES (1), (2)) s(k) WHERE k < m),
    s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r,
        (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score FROM k
        JOIN g x ON x.lang = k.lang AND x.phrase = k.lp AND x.m = k.k
        JOIN g y ON y.lang = k.lang AND y.phrase = k.rp AND y.m = k.m - k.k),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (SELECT lang, part, max(a) AS around FROM
        (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE m = 3)
        GROUP BY 1, 2),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
        LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase AND b.m = 2 WHERE o.around IS NULL OR 100 * o.around < 50 * b.a)
    SELECT r.lang, rank, phrase, a, l, r AS r, n.n, cast(score AS BIGINT) AS score
    FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""

# The other operators have no SQL form: hashed sketches, learned models and
# graph components are tested against brute force (tests/llm).
ORACLE_SQL: dict[str, str] = {"op6_mix_sources": _MIX_SQL, "op12_hard_negatives": _NEGATIVES_SQL,
                              "op13_phrases": _PHRASES_SQL}
