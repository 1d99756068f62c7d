"""Row bands: rows apart by runs of blank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLANK_RUN


def split_bands(rows: DataFrame, keys: list[str], row: str = "row", blank_run: int = BLANK_RUN) -> DataFrame:
    """Number the bands of rows that hold something; ``blank_run`` missing rows part two bands."""
    if blank_run < 1:
        raise ValueError("blank_run must be at least 1")
    order = Window.partitionBy(*keys).orderBy(row)
    before = F.lag(row).over(order)
    starts = F.when(before.isNull() | (F.col(row) - before - 1 >= blank_run), 1).otherwise(0)
    return rows.withColumn("_starts", starts).withColumn("band_no", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_starts")


def band_extents(rows: DataFrame, keys: list[str], row: str = "row", blank_run: int = BLANK_RUN) -> DataFrame:
    """(keys, band_no, start_row, end_row)."""
    return split_bands(rows, keys, row, blank_run).groupBy(*keys, "band_no").agg(F.min(row).alias("start_row"), F.max(row).alias("end_row"))


def contiguous_runs(cells: DataFrame, keys: list[str], col: str = "col") -> DataFrame:
    """Runs of neighbouring numbers: (keys, left_col, right_col, width)."""
    order = Window.partitionBy(*keys).orderBy(col)
    return (
        cells.select(*keys, col)
        .distinct()
        .withColumn("_run", F.col(col) - F.row_number().over(order))
        .groupBy(*keys, "_run")
        .agg(F.min(col).alias("left_col"), F.max(col).alias("right_col"), F.count("*").cast("int").alias("width"))
        .drop("_run")
    )


def longest_run(cells: DataFrame, keys: list[str], col: str = "col") -> DataFrame:
    """The widest run, the left-most of equals, and whether cells lie outside it after a gap.

    (keys, left_col, right_col, gapped); a run of one cell beside others is a
    header narrowed by a merge, which callers leave unresolved.
    """
    runs = contiguous_runs(cells, keys, col)
    return runs.groupBy(*keys).agg(
        F.max_by(F.struct("left_col", "right_col"), F.struct("width", (-F.col("left_col")).alias("n"))).alias("b"),
        (F.count("*") > 1).alias("gapped"),
    ).select(*keys, "b.left_col", "b.right_col", "gapped")
