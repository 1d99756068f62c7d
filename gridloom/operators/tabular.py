"""Which sheets are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .header import wide_axis_rows


def density(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, columns, rows, filled, density) over the populated rows and columns of a sample."""
    seen = sample.groupBy(*keys).agg(F.countDistinct("col").alias("columns"), F.countDistinct("row").alias("rows"), F.count("*").alias("filled"))
    return seen.withColumn("density", F.col("filled") / (F.col("columns") * F.col("rows")))


def wide_sparse(sample: DataFrame, keys: list[str]) -> DataFrame:
    """keys of samples with enough columns, a dense row and a time axis in column 1 below it."""
    extents = sample.groupBy(*keys).agg(F.max("row").alias("n"), F.countDistinct("col").alias("width"))
    rows = wide_axis_rows(sample, extents.filter(F.col("width") >= C.WIDE_LEAST_COLUMNS), keys)
    return rows.filter(F.col("dense") & (F.col("axis_below") >= C.WIDE_AXIS_ROWS)).select(*keys).distinct()


def tabular(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, density, is_tabular)."""
    wide = wide_sparse(sample, keys).withColumn("_wide", F.lit(True))
    d = density(sample, keys).join(wide, keys, "left")
    dense = (F.col("density") >= C.SAMPLE_DENSITY) | F.coalesce("_wide", F.lit(False))
    return d.select(*keys, "columns", "rows", "filled", "density", ((F.col("columns") > C.SAMPLE_LEAST_COLUMNS) & dense).alias("is_tabular"))
