"""Scan of a block's body below its header, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLANK_RUN


def scan_body(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Data region and skipped rows of each block.

    ``rows``: one row per physical row (keys, row, cls, merged, label), cls B
    (blank within the span), S (subtotal, total or thin) or D (data); merged:
    the row lies in a merge of several body rows.  Two blanks in a row end the
    body.  (keys, data_start, data_end, skip_rows, skip_labels, clamped,
    unreliable); blocks without any live row give no row.
    """
    order = Window.partitionBy(*keys).orderBy("row")
    group = Window.partitionBy(*keys)
    blank = F.col("cls") == "B"
    twice = blank
    for i in range(1, BLANK_RUN):
        twice = twice & F.coalesce(F.lag(blank, i).over(order), F.lit(False))
    r = F.col("row")
    live = rows.withColumn("_twice", twice).withColumn("_stop", F.min(F.when(F.col("_twice"), r)).over(group))
    live = live.filter(F.col("_stop").isNull() | (r <= F.col("_stop") - BLANK_RUN))
    data, flat = F.col("cls") == "D", (F.col("cls") == "D") & ~F.col("merged")
    live = live.withColumn("_solid", F.max(F.when(~blank, r)).over(group)).withColumn("_flat", F.max(F.when(flat, r)).over(group))
    grouped = data & F.col("merged")
    agg = live.groupBy(*keys).agg(
        F.min(F.when(data, r)).alias("data_start"),
        F.max(F.when(data, r)).alias("_end"),
        F.max("_flat").alias("_flat"),
        F.count(F.when(grouped & (r < F.col("_flat")), 1)).alias("_before"),
        F.count(F.when(grouped & (r > F.col("_flat")), 1)).alias("_after"),
        F.count(F.when(F.col("cls") == "S", 1)).alias("_thin"),
        F.array_sort(F.collect_list(F.when((F.col("cls") == "S") | (blank & (r < F.col("_solid"))), r))).alias("_skips"),
        F.array_sort(F.collect_list(F.when(F.col("cls") == "S", F.struct(r.alias("row"), F.col("label").alias("label"))))).alias("_labels"),
    )
    clamped = F.col("_flat").isNotNull() & (F.col("_before") == 0) & (F.col("_after") > 0)
    lost = F.col("data_start").isNull() & (F.col("_thin") > 0)
    return agg.select(
        *keys,
        "data_start",
        F.when(clamped, F.col("_flat")).otherwise(F.col("_end")).alias("data_end"),
        F.when(lost, F.slice("_skips", 1, 0)).otherwise(F.col("_skips")).alias("skip_rows"),
        F.when(lost, F.slice("_labels", 1, 0)).otherwise(F.col("_labels")).alias("skip_labels"),
        clamped.alias("clamped"),
        lost.alias("unreliable"),
    )
