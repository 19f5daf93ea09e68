"""Versioned table folders: never overwrite the folder being read.

A write goes to ``<base>/v=<n+1>``, where n counts every version folder, also
one that a crashed write left behind; readers take the highest version that
holds a ``_SUCCESS`` marker, so a half-written version is ignored and never
stands in the way of the next one.  Listing is metadata only (driver side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_versions(spark: SparkSession, base: str, complete: bool = True) -> list[int]:
    """Sorted version numbers; with ``complete`` only those with a marker."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            jvm = spark.sparkContext._jvm
            ok = not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
            if ok:
                try:
                    out.append(int(name[2:]))
                except ValueError:
                    pass
    return sorted(out)


def latest_version(spark: SparkSession, base: str) -> str | None:
    v = list_versions(spark, base)
    return f"{base.rstrip('/')}/v={v[-1]:06d}" if v else None


def next_version(spark: SparkSession, base: str) -> str:
    """Path of the version to write: above every folder that is there."""
    v = list_versions(spark, base, complete=False)
    return f"{base.rstrip('/')}/v={(v[-1] + 1) if v else 1:06d}"


def mark_complete(spark: SparkSession, path: str) -> None:
    """Puts the marker into a version that consists of several tables."""
    fs, p = _fs(spark, path)
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"), True).close()


def write_next_version(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    path = next_version(df.sparkSession, base)
    df.write.mode("errorifexists").format(fmt).save(path)
    return path
