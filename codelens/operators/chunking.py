"""Structural chunks of any text.

A text is cut into segments at boundary lines; a segment runs from one
boundary line to the line before the next one.  Everything happens inside the
row with array functions: no explode-then-window, no shuffle, and a whole
document is processed however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LONG_LINE = 120


def long_line_boundary(threshold: int = LONG_LINE):
    """Boundary predicate: a line longer than ``threshold`` characters."""
    return lambda line: F.length(line) > threshold


def structural_chunks(df: DataFrame, id_col: str, text_col: str,
                      is_boundary=None) -> DataFrame:
    """``id, seg (1-based), start_line, end_line (1-based inclusive), text``.

    Line 0 always opens a segment; ``is_boundary(line: Column) -> Column``
    marks the other opening lines.
    """
    is_boundary = is_boundary or long_line_boundary()
    lines = F.split(F.col(text_col), "\n", -1)
    with_lines = df.select(F.col(id_col), lines.alias("_lines"))
    n = F.size("_lines")
    # Each step is a column of its own and read more than once, so Catalyst
    # keeps it and no lambda computes an array again per element.
    starts = F.filter(F.sequence(F.lit(0), n - 1),
                      lambda i: (i == 0) | is_boundary(F.get(F.col("_lines"), i)))
    marked = with_lines.select(F.col(id_col), "_lines", starts.alias("_starts"))
    segs = F.transform(F.sequence(F.lit(0), F.size("_starts") - 1), lambda j: F.struct(
        (j + 1).alias("seg"), F.get("_starts", j).alias("s0"),
        F.coalesce(F.get("_starts", j + 1) - 1, F.size("_lines") - 1).alias("e0")))
    placed = marked.select(F.col(id_col), "_lines", segs.alias("_segs"))
    # The text of a segment is cut out before the segments become rows: a row
    # carries its own lines only.
    cut = F.transform("_segs", lambda s: F.struct(
        s["seg"].alias("seg"), s["s0"].alias("s0"), s["e0"].alias("e0"),
        F.array_join(F.slice("_lines", s["s0"] + 1, s["e0"] - s["s0"] + 1), "\n").alias("text")))
    rows = placed.select(F.col(id_col), F.explode_outer(cut).alias("_c")).filter(F.col("_c").isNotNull())
    return rows.select(F.col(id_col), F.col("_c.seg").cast("int").alias("seg"),
                       (F.col("_c.s0") + 1).cast("int").alias("start_line"),
                       (F.col("_c.e0") + 1).cast("int").alias("end_line"),
                       F.col("_c.text").alias("text"))
