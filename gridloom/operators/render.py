"""Rows as Markdown and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as X


def _of(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str, kind: T.DataType) -> Column:
    c = _of(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return X.iso_timestamp(c)
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def markdown_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): each row as a table line."""
    items = [X.markdown_cell(as_text(f.name, f.dataType)) for f in df.schema]
    return df.select(*keys, F.concat(F.lit("| "), F.concat_ws(" | ", *items), F.lit(" |")).alias("line"))


def json_lines(df: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """(keys, record): each row's fields, all by default, as an object in order; missing values are kept as null."""

    def value(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType, T.DayTimeIntervalType)):
            return as_text(f.name, f.dataType)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(_of(f.name)), _of(f.name))
        return _of(f.name)

    named = [df.schema[n] for n in (df.columns if fields is None else fields)]
    record = F.to_json(F.struct(*[value(f).alias(f.name) for f in named]), {"ignoreNullFields": "false"}) if named else F.lit("{}")
    return df.select(*[_of(k) for k in keys], record.alias("record"))


def markdown_table(df: DataFrame, order: list[str], max_rows: int = 20, fields: list[str] | None = None) -> DataFrame:
    """(n, line): a table's header, separator, first rows and, where rows are left out, a footer with their number."""
    fields = df.columns if fields is None else fields
    keys = [_of(k) for k in order]
    cells = [X.markdown_cell(as_text(n, df.schema[n].dataType)) for n in fields]
    row = F.row_number().over(Window.orderBy(*keys))  # of at most ``max_rows`` rows
    body = df.orderBy(*keys).limit(max_rows).select((row.cast("long") + 1).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    cell = lambda x: x.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").replace("\r", " ")
    head = [(0, "| " + " | ".join(map(cell, fields)) + " |"), (1, "| " + " | ".join("---" for _ in fields) + " |")]
    top = df.sparkSession.createDataFrame(head, "n long, line string")
    left = df.agg((F.count("*") - max_rows).alias("left")).filter("left > 0").select((F.lit(max_rows) + 2).cast("long").alias("n"), F.concat(F.lit("… "), F.col("left"), F.lit(" more rows")).alias("line"))
    return top.union(body).union(left)


def json_table(df: DataFrame, order: list[str], max_rows: int | None = None) -> DataFrame:
    """One row (row_count, records): the number of all rows, and the first ones as a JSON array."""
    numbered = json_lines(df, order)
    if max_rows is not None:
        numbered = numbered.orderBy(*order).limit(max_rows)
    records = numbered.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "record"))), lambda x: x["record"]), ","), F.lit("]")).alias("records"))
    return df.agg(F.count("*").alias("row_count")).crossJoin(records)  # one row each
