"""Session construction and shared-folder helpers.

The library itself never creates a session: operators take DataFrames.  This
module is used by tests, ``bench.py`` and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Configuration that matters at scale as much as locally: adaptive execution
# (runtime re-planning, partition coalescing, skew-join splitting), UTC
# timestamps, Arrow transfer for the few Python stages.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "codelens", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the engine's defaults.

    ``master`` defaults to ``local[$BENCH_CPUS]`` (or ``local[*]``).  On a
    cluster pass the cluster master and leave ``spark.checkpoint.dir`` to the
    cluster configuration.  Shuffle partitions and driver memory are set only
    where the caller (or ``$CODELENS_DRIVER_MEMORY``) asks for it.
    """
    cpus = os.environ.get("BENCH_CPUS", "*")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if memory := os.environ.get("CODELENS_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = memory
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a local-mode session (tests, the
    bench) without the setting gets a fresh scratch folder of its own; a
    cluster session without the setting is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="codelens-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir


# Folders written inside the open scratch() blocks of a thread, innermost last.
_scratch = threading.local()


def materialize(df, label: str = "table"):
    """Write ``df`` as Parquet into a fresh folder under the shared checkpoint
    folder and return a DataFrame reading it back.

    This cuts lineage like ``checkpoint()`` but the copy is columnar: later
    reads prune columns and push filters, and the files survive the loss of
    any executor.  Inside a :func:`scratch` block the table lives until its
    end.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/codelens-{label}-{uuid.uuid4().hex}"
    if getattr(_scratch, "blocks", None):
        _scratch.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`materialize` writes inside the block are deleted at
    its end.  The block gets ``keep(df, label)``, which writes a table that
    lives on (until the end of an enclosing block): what an operator returns
    must read only such tables and its inputs."""
    blocks = _scratch.__dict__.setdefault("blocks", [])
    mine, kept = [], []
    blocks.append(mine)

    def keep(df, label: str = "table"):
        out = materialize(df, label)
        kept.append(blocks[-1].pop())
        return out
    try:
        yield keep
    finally:
        blocks.pop()
        if blocks:
            blocks[-1].extend(kept)
        for path in mine:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
