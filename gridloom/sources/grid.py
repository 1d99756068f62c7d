"""Tables as grids: a parquet (or any) table becomes the cell relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_SCHEMA = "file string, sheet_idx int, sheet string, row int, col int, kind string, s string, l bigint, d double, b boolean, ts timestamp_ntz, formula string, has_cache boolean"


def _cell(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    text = number = real = flag = time = F.lit(None)
    if isinstance(kind, T.BooleanType):
        label, flag = "bool", c
    elif isinstance(kind, T.IntegralType):
        label, number = "int", c.cast("long")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        label, real = "float", c.cast("double")
    elif isinstance(kind, T.DateType):
        label, time = "date", c.cast("timestamp_ntz")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        label, time = "datetime", c.cast("timestamp_ntz")
    else:
        label, text = "string", c.cast("string")
    filled = c.isNotNull() if label != "string" else c.isNotNull() & (text != "")
    return F.when(filled, F.struct(F.lit(label).alias("kind"), text.cast("string").alias("s"), number.cast("long").alias("l"), real.cast("double").alias("d"), flag.cast("boolean").alias("b"), time.cast("timestamp_ntz").alias("ts")))


def cells_of(df: DataFrame, keys: list[str], row: str, columns: list[str]) -> DataFrame:
    """(keys, row, col, kind, s, l, d, b, ts): one row per non-empty cell, columns numbered from 1."""
    types = {f.name: f.dataType for f in df.schema}
    items = F.array(*[F.struct(F.lit(i).alias("col"), _cell(c, types[c]).alias("v")) for i, c in enumerate(columns, 1)])
    out = df.select(*keys, F.col(row).cast("int").alias("row"), F.explode(items).alias("x")).filter("x.v IS NOT NULL")
    return out.select(*keys, "row", "x.col", "x.v.kind", "x.v.s", "x.v.l", "x.v.d", "x.v.b", "x.v.ts", F.lit(None).cast("string").alias("formula"))
