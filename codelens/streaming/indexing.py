"""Structured Streaming front-end for incremental indexing.

New or rewritten source files arriving under a folder are picked up by the
``binaryFile`` stream source; each micro-batch runs
:func:`codelens.plans.indexing.index_corpus`, whose content-hash anti-join
skips files whose text did not change.  Progress is kept in the query's
checkpoint location (a shared folder), so a restarted query resumes where it
stopped.  Deletions are not visible to a file stream; a batch run of
``index_corpus`` over a full listing handles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.indexing import DEFAULT_DIM, index_corpus

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, source_dir: str, extensions=tx.DEFAULT_EXTENSIONS,
                max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming ``path, content`` rows of matching files under ``source_dir``."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob)
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .load(source_dir))
    root = source_dir.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*" + _escape(root.lstrip("/")), "")
    text = F.col("content").cast("string")
    content = F.when(F.expr("is_valid_utf8(cast(content as string))"), text) \
        .otherwise(F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "�", ""))
    return raw.select(rel.alias("path"), content.alias("content"))


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def start_index_stream(spark: SparkSession, source_dir: str, root: str, checkpoint_location: str,
                       entity: str, dim: int = DEFAULT_DIM, available_now: bool = True):
    """Start the indexing stream; returns the ``StreamingQuery``."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        index_corpus(batch, root, entity, dim, full_listing=False)

    writer = (file_stream(spark, source_dir).writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
