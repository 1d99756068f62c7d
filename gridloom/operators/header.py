"""Header candidates: scores and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import cells as X


def score_rows(cells: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, score) of every sampled row.

    ``cells``: (keys, row, col, cat, len) of the sample, rows numbered from 1;
    ``extents``: (keys, n, width), the sample's rows and the columns that count.
    Ties for the main category below a cell go to the one met first.
    """
    look = C.HEADER_LOOKAHEAD
    base = extents.filter("n > 0 and width > 0")
    up = F.col("_up") > 0
    # each cell stands for itself and below the rows above it, so that no join of cells is needed
    both = (
        cells.select(*keys, "col", "cat", "len", F.col("row").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(look))).alias("_up"))
        .withColumn("row", F.col("_at") - F.col("_up"))
        .filter("row >= 1")
        .groupBy(*keys, "row", "col", F.col("cat").alias("_cat"))
        .agg(F.count(F.when(up, 1)).alias("c"), F.min(F.when(up, F.col("_at"))).alias("first"), F.sum(F.when(up, F.col("len"))).alias("total"), F.max(F.when(~up, F.struct("cat", "len"))).alias("own"))
        .groupBy(*keys, "row", "col")
        .agg(
            (F.max("c") / F.nullif(F.sum("c"), F.lit(0))).alias("cons"),
            F.max_by("_cat", F.when(F.col("c") > 0, F.struct("c", (-F.col("first")).alias("f")))).alias("main"),
            (F.sum("total") / F.nullif(F.sum("c"), F.lit(0))).alias("mean"),
            F.max("own").alias("own"),
        )
        .select(*keys, "row", "col", "cons", "main", "mean", F.col("own.cat").alias("cat"), F.col("own.len").alias("len"))
        .join(base, keys)
        .filter(F.col("col") <= F.col("width"))
    )
    differs = F.when(F.col("cat").eqNullSafe(F.col("main")), 0.0).otherwise(1.0)
    long_ = F.coalesce(F.col("len"), F.lit(0)).cast("double")
    apart = F.when(F.col("main").isNull(), F.when(F.col("cat").isNull(), 0.0).otherwise(1.0)).otherwise((differs + F.abs(long_ - F.col("mean")) / F.greatest(long_, F.col("mean"), F.lit(1.0))) / 2)
    parts = both.groupBy(*keys, "row").agg(F.count(F.when(F.col("cat") == "string", 1)).alias("texts"), F.coalesce(F.sum("cons"), F.lit(0.0)).alias("cons"), F.sum(apart).alias("apart"))
    rows = base.select(*keys, "n", "width", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("row"))
    under = F.least(F.lit(look), F.col("n") - F.col("row"))
    score = (
        C.WEIGHT_TEXT * F.coalesce("texts", F.lit(0)) / F.col("width")
        + C.WEIGHT_CONSISTENT * F.coalesce("cons", F.lit(0.0)) / F.col("width") * under / F.lit(float(look))
        + F.when(under == 0, 0.0).otherwise(C.WEIGHT_DISTINCT * F.coalesce("apart", F.lit(0.0)) / F.col("width"))
    )
    return rows.join(parts, [*keys, "row"], "left").select(*keys, "row", F.least(F.lit(1.0), score).alias("score"))


def timeseries_bonus(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, bonus) of rows that name a time axis and series codes over dated numbers.

    ``cells``: (keys, row, col, kind, s) of the sample.
    """
    look = C.HEADER_LOOKAHEAD
    first = cells.groupBy(*keys, "row").agg(F.min_by(F.struct("col", "kind", "s"), "col").alias("f")).filter((F.col("f.kind") == "string") & X.axis_label_bonus(F.col("f.s"))).select(*keys, F.col("row").alias("cand"), F.col("f.col").alias("axis"))
    paired = first.join(cells, keys).filter((F.col("row") >= F.col("cand")) & (F.col("row") <= F.col("cand") + look) & (F.col("col") >= F.col("axis")))
    here, right = F.col("row") == F.col("cand"), F.col("col") > F.col("axis")
    on = lambda c: F.count(F.when(c, 1))
    kind, s = F.col("kind"), F.col("s")
    seen = paired.groupBy(*keys, "cand").agg(
        on(here & right).alias("labels"),
        on(here & right & (kind == "string") & X.code_like(s)).alias("codes"),
        on(~here & ~right).alias("values"),
        on(~here & ~right & X.axis_value_bonus(kind, s)).alias("dates"),
        on(~here & right).alias("measures"),
        on(~here & right & X.numeric_measure(kind, s)).alias("numeric"),
    )
    ok = (
        (F.col("labels") >= C.CODE_LEAST_LABELS)
        & (F.col("codes") >= C.CODE_RATIO * F.col("labels"))
        & (F.col("values") >= C.AXIS_LEAST_VALUES)
        & (F.col("dates") >= C.AXIS_RATIO * F.col("values"))
        & (F.col("numeric") >= C.MEASURE_RATIO * F.col("measures"))
    )
    return seen.filter(ok).select(*keys, F.col("cand").alias("row"), F.lit(C.TIMESERIES_BONUS).alias("bonus"))


def wide_axis_rows(cells: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, dense, axis_below, axis_next, label, blank): evidence of wide sheets with a time axis in column 1."""
    per = cells.groupBy(*keys, "row").agg(F.countDistinct("col").alias("filled"), F.max(F.when(F.col("col") == 1, X.axis_value_gate(F.col("kind"), F.col("s"), F.col("l"), F.col("d")))).alias("axis"), F.max(F.when(F.col("col") == 1, F.struct("kind", "s"))).alias("first"))
    rows = extents.select(*keys, "width", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("row")).join(per, [*keys, "row"], "left")
    order = Window.partitionBy(*keys).orderBy("row")
    axis = F.coalesce(F.col("axis"), F.lit(False))
    return rows.withColumn("_axis", axis.cast("int")).select(
        *keys,
        "row",
        (F.coalesce("filled", F.lit(0)) >= C.WIDE_DENSE_RATIO * F.col("width")).alias("dense"),
        F.coalesce(F.sum("_axis").over(order.rowsBetween(1, C.WIDE_LOOKAHEAD)), F.lit(0)).alias("axis_below"),
        (F.coalesce(F.lead("_axis").over(order), F.lit(0)) == 1).alias("axis_next"),
        F.coalesce((F.col("first.kind") == "string") & X.axis_label_gate(F.col("first.s")), F.lit(False)).alias("label"),
        F.col("first").isNull().alias("blank"),
        "width",
    )


def pick_header(scores: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row, confidence): the wide time-series row if there is one, else the best score, first of equals."""
    forced = wide.filter((F.col("width") >= C.WIDE_LEAST_COLUMNS) & F.col("dense") & (F.col("axis_below") >= C.WIDE_AXIS_ROWS) & (F.col("label") | (F.col("blank") & F.col("axis_next")))).groupBy(*keys).agg(F.min("row").alias("forced"))
    best = scores.groupBy(*keys).agg(F.max_by("row", F.struct("score", (-F.col("row")).alias("r"))).alias("best"))
    chosen = best.join(forced, keys, "left").select(*keys, F.coalesce("forced", "best").alias("row"))
    return chosen.join(scores, [*keys, "row"]).select(*keys, F.col("row").alias("header_row"), F.col("score").alias("confidence"))
