"""The five stages on odd rows and, one by one, on the small corpus."""

import corpus_pipeline as p
from codelens.session import materialize, read_table
from codelens.llm.quality import quality_rules
from codelens.llm.mixing import mix
from codelens.llm.parity_join import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), "test")
        kept[name] = before, docs
        assert docs.columns == columns + ["copies"] * (name == p.STAGES[-1][0])
    before, after = kept["quality rules"]
    want = {r.doc_id for r in quality_rules(before, read_table(spark, SF, "labels")).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["n-gram Jaccard join"]
    comp = {r.component_id for r in jaccard_components(before, k=5, percent=80).collect()}
    assert {r.doc_id for r in after.collect()} == comp
    # line dedup leaves no near copies in this small table: the stage must find those before it
    before = kept["line dedup"][0]
    comp = {r.component_id for r in jaccard_components(before, k=5, percent=80).collect()}
    assert {r.doc_id for r in p.near_copies(spark, before, SF).collect()} == comp and len(comp) < before.count()
    before, after = kept["mixing sources to target weights"]
    taken = {r.doc_id: r.copies for r in mix(before).filter("taken > 0").collect()}
    assert {r.doc_id: r.copies for r in after.collect()} == taken


def test_stages_on_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (None, long, "en", None, 1), (2, "", "en", "s", 0), (3, long, None, "s", 5),
            (3, long, None, "s", 5), (4, long + " end", "x", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS key", "'q' AS copies", "2 AS rule")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        assert out.count() > 0
    assert p.STAGES[0][1](spark, docs.limit(0), SF).count() == 0


def test_near_copies_of_five_words(spark):
    """Two inner words of 100 changed: 0.811 of the 5-word shingles are
    shared, 0.848 of the 4-word ones.  Rows of one id with unrelated texts
    are two documents."""
    base = [f"word{i}" for i in range(100)]
    near, other = list(base), " ".join(f"other{i}" for i in range(40))
    near[30], near[70] = "x", "y"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, other), (3, " ".join(f"third{i}" for i in range(40))),
            (3, other), (4, None), (4, None), (None, other), (5, other + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _vertex", "'k' AS kept")
    got = p.near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted(
        (d or 0, t or "") for d, t in [rows[0], rows[2], rows[3], rows[5], rows[7]])
