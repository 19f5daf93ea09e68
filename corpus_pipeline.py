"""The documents of a training corpus, cleaned and mixed in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.common import filter_computed, word_count
from codelens.llm.decontaminate import clean_documents
from codelens.llm.fuzzy_lines import dedup_lines
from codelens.llm.mixing import mixed_documents
from codelens.llm.parity_join import distinct_documents
from codelens.llm.quality import kept_documents
from codelens.session import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the base or learned rules reject go."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated fuzzy lines go, and documents of which no word is
    left."""
    cleaned = dedup_lines(docs)
    return filter_computed(cleaned, word_count(F.col("text")) > 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on shingles of five words, Jaccard >= 0.8: one document of
    each component stays."""
    return distinct_documents(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a test item go."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents of the mix, with their number of copies."""
    return mixed_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing)]

# The learned rules and the hashes of the later stages have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
