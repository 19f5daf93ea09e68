"""Quality rules as a learned decision list, DataFrame expressions only.

Sequential covering: one rule after the other is grown on labelled documents
(the threshold with the highest information gain is added until no accepted
document is left or nothing gains), pruned on held-out rows, and kept if it is
precise there; what it covers is set aside before the next rule is grown.  The
result is an ordered list of threshold conjunctions and becomes one
``CASE WHEN`` expression over the document statistics.

Every count that the search needs is a Spark aggregate over (statistic, bin);
the driver sees those bounded tables, never a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLANK, filter_computed, fresh, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# statistic name -> share (numerator, denominator) or plain value
STATISTICS = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
              "digit_share", "exclaim_per_word", "distinct_word_share", "words_per_line")
# Upper bound on the labelled rows that the rules are fitted on.
MAX_LABELLED = 20_000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_COVERED = 10
MIN_PRECISION = 0.95


@dataclass(frozen=True)
class Rule:
    """Reject when every ``(statistic, op, threshold)`` holds."""
    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [
            (F.col(s) >= F.lit(t)) if op == ">=" else (F.col(s) < F.lit(t)) for s, op, t in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{s} {op} {t:.6g}" for s, op, t in self.conditions)


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words inside 3-word windows that occur twice or more in the row.

    Windows are compared by 64-bit hash within one text.  Texts without a
    repeated window (most) stop after one hash-set pass; in the others the
    windows are sorted, equal neighbours give the repeated positions, and the
    sorted positions give the covered words."""
    h, s, r = f"{out}_h", f"{out}_s", f"{out}_r"
    n = F.size(words)
    df = df.withColumn(h, F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get(F.col(words), i), F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))))
        .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
        F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    at = lambda i: F.get(F.col(s), i)["h"]
    df = df.withColumn(r, F.when(F.col(s).isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (
            F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))),
        lambda i: F.get(F.col(s), i)["p"]))))
    df = df.withColumn(out, F.when(F.col(r).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0))), F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(i == 0, 3).otherwise(
            F.least(F.lit(3), F.get(F.col(r), i) - F.get(F.col(r), i - 1))))))
    return df.drop(h, s, r)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the base counts, ``base_failed`` and the learned
    rules' statistics for every row (null text: no words)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    kept_chars = lambda cls: F.length(F.regexp_replace("t", f"[^{cls}]+", "")).cast("long")
    d = d.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        kept_chars("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        kept_chars("A-Z").alias("n_upper"), kept_chars("0-9").alias("n_digits"), kept_chars("!").alias("n_exclaim"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))
    d = _repeated_words(d, "w", "n_repeat_words")
    # The counts leave this step as one value that no filter may be pushed
    # below: a caller's filter on a verdict would rebuild every array in it.
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_digits",
                      "n_exclaim", "n_distinct", "n_repeat_words")
    d = d.select("doc_id", F.when(F.monotonically_increasing_id() >= 0, counts).alias("c")).select("doc_id", "c.*")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_upper") / chars).alias("upper_share"), (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_exclaim") / words).alias("exclaim_per_word"),
        (F.col("n_distinct") / words).alias("distinct_word_share"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("words_per_line"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """Statistics of at most ``max_rows`` labelled documents (lowest hash of
    the id first), with ``bad`` = 1 where the label rejects the document.
    Labels without an id, without a verdict or with contradicting verdicts
    are not used."""
    picked = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
              .filter("lo = hi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
              .select(F.col("doc_id").alias("_lid"), (F.col("lo") == 0).cast("int").alias("bad")))
    # at most max_rows (id, flag) pairs: the side of proven size
    d = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_lid"))
    stats = statistics(d.select(F.struct("doc_id", "bad").alias("doc_id"), "text"))
    return stats.select("doc_id.bad", F.col("doc_id.doc_id").alias("_id"), *[
        c for c in stats.columns if c != "doc_id"])


def learn(sample: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
          min_covered: int = MIN_COVERED, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Decision list from ``sample`` (see :func:`labelled_statistics`).

    Rows that the base rules already reject teach nothing and are left out.
    An empty sample, or one without both verdicts, gives an empty list."""
    sample = filter_computed(sample, ~F.col("base_failed")).select(
        "bad", (F.pmod(F.xxhash64("_id", F.lit("split")), F.lit(3)) < 2).alias("grow"), *STATISTICS)
    sample = materialize(sample.repartition(4), "quality-sample")
    cuts_at = [i / BINS for i in range(1, BINS)]
    row = sample.agg(F.sum("bad"), F.count(F.lit(1)),
                     *[F.percentile(s, F.array(*[F.lit(q) for q in cuts_at])) for s in STATISTICS]).first()
    n_bad, n_all, cuts = row[0] or 0, row[1], [sorted(set(x or [])) for x in row[2:]]
    if not 0 < n_bad < n_all:
        return []
    # bin of a value: number of cuts that it reaches
    bin_of = [reduce(lambda a, b: a + b, [(F.col(s) >= F.lit(c)).cast("int") for c in cs], F.lit(0)).alias(f"b{j}")
              for j, (s, cs) in enumerate(zip(STATISTICS, cuts))]
    binned = materialize(sample.select("bad", "grow", *STATISTICS, *bin_of), "quality-bins")
    rules: list[Rule] = []
    open_rows = binned
    while len(rules) < max_rules:
        conditions = _grow(open_rows.filter("grow"), cuts, max_conditions, min_covered)
        rule = _prune(open_rows.filter("not grow"), conditions, min_precision, max(1, min_covered // 2))
        if rule is None:
            break
        rules.append(rule)
        open_rows = open_rows.filter(~rule.column())
    return rules


def _grow(rows: DataFrame, cuts: list[list[float]], max_conditions: int, min_covered: int) -> list:
    """Conditions of one rule, each the one of highest information gain."""
    conditions: list[tuple[str, str, float]] = []
    covered = rows
    while len(conditions) < max_conditions:
        bins = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"b{j}").alias("b"))
                                   for j in range(len(STATISTICS))])).alias("x")
        # at most statistics x bins rows
        counts = covered.select("bad", bins).groupBy("x.j", "x.b") \
            .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        p0 = sum(c["p"] for c in counts if c["j"] == 0)
        n0 = sum(c["n"] for c in counts if c["j"] == 0)
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for j, stat in enumerate(STATISTICS):
            mine = [c for c in counts if c["j"] == j]
            for k, cut in enumerate(cuts[j]):
                for op, side in ((">=", [c for c in mine if c["b"] > k]), ("<", [c for c in mine if c["b"] <= k])):
                    p, n = sum(c["p"] for c in side), sum(c["n"] for c in side)
                    if p >= min_covered and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, (stat, op, cut))
        if best[1] is None:
            break
        conditions.append(best[1])
        covered = covered.filter(Rule((best[1],)).column())
    return conditions


def _prune(rows: DataFrame, conditions: list, min_precision: float, min_covered: int) -> Rule | None:
    """The prefix with the best share of rejected rows on the held-out rows,
    or None if none is precise enough."""
    if not conditions:
        return None
    prefixes = [Rule(tuple(conditions[:k + 1])) for k in range(len(conditions))]
    got = rows.agg(*[F.sum(F.when(r.column(), x).otherwise(0)) for r in prefixes
                     for x in (F.col("bad"), 1 - F.col("bad"))]).first()
    scored = [((got[2 * k] or 0), (got[2 * k + 1] or 0), r) for k, r in enumerate(prefixes)]
    good = [((p - n) / (p + n), p, r) for p, n, r in scored if p >= min_covered and p / (p + n) >= min_precision]
    return max(good, key=lambda x: (round(x[0], 3), x[1]))[2] if good else None


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row (1-based), null if none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        out = out.when(r.column(), F.lit(k))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per input row: ``doc_id``, base counts, ``base_failed``,
    ``rule`` (the learned rule that rejects it, or null) and ``kept``.

    A null or empty text has no words and fails the base rules; rows with a
    null or repeated id are judged one by one; without usable labels only the
    base rules act; an empty table gives no rows."""
    rules = learn(labelled_statistics(docs, labels, max_labelled))
    return statistics(docs).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept", "rule")


def kept_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that base rules and learned rules keep, all columns
    unchanged; the verdict is computed in the row, without a join."""
    rules = learn(labelled_statistics(docs, labels, max_labelled))
    row, text = fresh(docs, "row"), F.col("text")
    packed = docs.select(F.struct(*docs.columns).alias(row), text.alias("text"))
    judged = statistics(packed.select(F.col(row).alias("doc_id"), "text"))
    return filter_computed(judged, ~F.col("base_failed") & verdict(rules).isNull()).select("doc_id.*")
