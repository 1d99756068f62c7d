"""Merged ranges: overlap with bands, header levels, vertical anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positioned(merges: DataFrame, keys: list[str]) -> DataFrame:
    """Merges with their position in sheet order."""
    return merges.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("min_row", "min_col", "max_row", "max_col")))


def overlapping(merges: DataFrame, bands: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Merges by the bands whose rows they touch; ``bands``: keys, start_row, end_row, kept columns."""
    return merges.join(bands.select(*keys, "start_row", "end_row", *kept), keys).filter((F.col("max_row") >= F.col("start_row")) & (F.col("min_row") <= F.col("end_row")))


def classified(merges: DataFrame, header: str = "header_row") -> DataFrame:
    """kind header where a merge starts at the header row or above, else body."""
    return merges.withColumn("kind", F.when(F.col(header).isNotNull() & (F.col("min_row") <= F.col(header)), "header").otherwise("body"))


def header_levels(covered: DataFrame, keys: list[str], header: str = "header_row") -> DataFrame:
    """First row of the run of merge-covered rows that ends right above the header.

    ``covered``: (keys, header_row, row) of rows above the header that header
    merges cover; (keys, header_row, top_row), none where no run is adjacent.
    """
    down = Window.partitionBy(*keys, header).orderBy(F.desc("row"))
    runs = covered.select(*keys, header, "row").distinct().withColumn("_run", F.col("row") + F.row_number().over(down))
    return runs.filter(F.col("_run") == F.col(header)).groupBy(*keys, header).agg(F.min("row").alias("top_row"))


def vertical_anchors(merges: DataFrame, headers: DataFrame, keys: list[str], col: str = "min_col") -> DataFrame:
    """(keys, col, anchor_row): where a header cell's name stands in a merge from above; the lowest anchor wins."""
    hit = merges.join(headers, keys).filter((F.col("min_row") < F.col("header_row")) & (F.col("max_row") >= F.col("header_row")))
    return hit.groupBy(*keys, F.col(col).alias("col")).agg(F.max("min_row").alias("anchor_row"))


def level_labels(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, label) of header levels: a merge's label stands over all its columns, on its first row only.

    ``cells``: (keys, row, col, label) of the levels; merges: (keys, min_row,
    min_col, max_row, max_col).  A label doesn't run on past its merge's edge.
    """
    covered = merges.select(*keys, "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), "max_col")
    covered = covered.select(*keys, "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    anchor = cells.select(*keys, F.col("row").alias("min_row"), F.col("col").alias("min_col"), "label")
    spread = covered.filter("row = min_row").join(anchor, [*keys, "min_row", "min_col"]).select(*keys, "row", "col", "label")
    return cells.select(*keys, "row", "col", "label").join(covered.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_anti").union(spread)


def filled_header(real: DataFrame, merges: DataFrame, keys: list[str], header: str = "header_row") -> DataFrame:
    """(keys, col) of a header's filled cells, with those that a merge over the header row covers."""
    over = merges.filter((F.col("min_row") <= F.col(header)) & (F.col("max_row") >= F.col(header)))
    return real.select(*keys, "col").union(over.select(*keys, F.explode(F.sequence("min_col", "max_col")).alias("col")))


def anchored(anchors: DataFrame, bands: DataFrame, keys: list[str], anchor: str = "anchor") -> DataFrame:
    """Anchors with the band that holds them (null: none); ``applies`` marks the lowest of a band."""
    inside = (F.col(anchor) >= F.col("start_row")) & (F.col(anchor) <= F.col("end_row"))
    both = anchors.alias("a").join(bands.alias("b"), [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], inside], "left").select("a.*", "b.band_no")
    first = F.row_number().over(Window.partitionBy(*keys, "band_no").orderBy(anchor)) == 1
    return both.withColumn("applies", F.col("band_no").isNotNull() & first)


def folded_skips(skips: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """Skipped rows with those asked for and without those refused."""
    cols = [*keys, row]
    return skips.select(*cols).union(add.select(*cols)).distinct().join(remove.select(*cols).distinct(), cols, "left_anti")
