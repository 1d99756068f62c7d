"""Samples and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import cells as X


def even_sample(rows: DataFrame, keys: list[str], order: list[str], size: int = C.TYPE_SAMPLE_ROWS) -> DataFrame:
    """Every floor(i * n / s)-th row of each group, s = min(size, n); no randomness."""
    group = Window.partitionBy(*keys)
    k = (F.row_number().over(group.orderBy(*order)) - 1).cast("long")
    ranked = rows.withColumn("_k", k).withColumn("_n", F.count("*").over(group))
    s = F.least(F.lit(size).cast("long"), F.col("_n"))
    hit = F.expr(f"((_k * least({size}L, _n) + _n - 1) div _n) * _n") < (F.col("_k") + 1) * s
    return ranked.filter(hit).drop("_k", "_n")


def null_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, null_ratio) in one pass over the table."""
    columns = columns or df.columns
    counted = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("nulls")) for c in columns]))
    return counted.select("_n", items.alias("x")).select("x.column", F.col("_n").alias("rows"), "x.nulls", F.when(F.col("_n") > 0, F.round(F.col("x.nulls") / F.col("_n"), 4)).otherwise(0.0).alias("null_ratio"))


def inferred_type(filled: Column, dates: Column, numbers: Column, strings: Column, number_texts: Column) -> Column:
    """Type of a column from counts over its sample."""
    least = filled * F.lit(C.TYPE_SUCCESS)
    return (
        F.when(filled == 0, "text")
        .when(dates >= least, "date")
        .when(numbers + number_texts >= least, F.when(strings == filled, "numeric_text").otherwise("number"))
        .when(strings == filled, "text")
        .otherwise("mixed")
    )


def profile_columns(cells: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """(keys, col, inferred_type, null_ratio, has_formula, uncached) over sampled rows.

    ``rows`` holds (keys, sampled), the number of sampled rows of each group,
    which is the base of the null ratio.
    """
    kind, s = F.col("kind"), F.col("s")
    on = lambda c: F.count(F.when(c, 1))
    value = kind.isNotNull()
    counted = cells.groupBy(*keys, "col").agg(
        on(value).alias("filled"),
        on(kind.isin("date", "datetime")).alias("dates"),
        on(kind.isin("int", "float")).alias("numbers"),
        on(kind == "string").alias("strings"),
        on((kind == "string") & X.float_like(s)).alias("number_texts"),
        F.coalesce(F.bool_or(F.col("formula").isNotNull()), F.lit(False)).alias("has_formula"),
        F.coalesce(F.bool_and(F.when(F.col("formula").isNotNull(), kind.isNull())), F.lit(False)).alias("uncached"),
    )
    return counted.join(rows, keys).select(
        *keys,
        "col",
        inferred_type(*[F.col(c) for c in ("filled", "dates", "numbers", "strings", "number_texts")]).alias("inferred_type"),
        F.when(F.col("sampled") > 0, 1 - F.col("filled") / F.col("sampled")).otherwise(0.0).alias("null_ratio"),
        "has_formula",
        "uncached",
    )


def leading_key(observed: Column, populated: Column, top_kind: Column) -> Column:
    """A blank-headed column is a key if it is nearly always filled, with one kind of value."""
    return (observed > 0) & (populated > 0) & (populated / observed >= C.TYPE_SUCCESS) & (top_kind / populated >= C.TYPE_SUCCESS)


def value_kind(kind: Column, s: Column) -> Column:
    return F.when(kind.isin("date", "datetime", "time") | ((kind == "string") & X.axis_text_rows(s)), "date").when(kind.isin("int", "float"), "number").when(kind == "string", "text").otherwise("other")
