"""Predicates and scalar rules over cells, as column expressions.

A cell is (kind, s, l, d, b, ts): kind is one of string, int, float, bool,
date, datetime, time; one payload is set.  Empty cells have no row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def category(kind: str | Column = "kind") -> Column:
    """string, number, date or other; times count as dates here."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "string", "string").when(k.isin("int", "float"), "number").when(k.isin("date", "datetime", "time"), "date").otherwise("other")


def clean_label(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(text), r"^:+|:+$", "")))


def axis_label_gate(text: Column) -> Column:
    return clean_label(text).isin(*C.AXIS_LABELS_GATE)


def axis_label_bonus(text: Column) -> Column:
    return F.lower(strip(text)).isin(*C.AXIS_LABELS_BONUS)


def axis_label_rows(text: Column) -> Column:
    label = F.lower(strip(text))
    token = F.arrays_overlap(F.split(label, "[^a-z0-9]+"), F.array(*map(F.lit, C.AXIS_TOKENS_ROWS)))
    return token | reduce(lambda a, b: a | b, [label.contains(p) for p in C.AXIS_PARTS_ROWS])


def _year(l: Column, d: Column) -> Column:  # noqa: E741
    return F.coalesce(l.between(1000, 9999), F.lit(False)) | F.coalesce((d == F.floor(d)) & d.between(1000, 9999), F.lit(False))


def axis_value_gate(kind: Column, s: Column, l: Column, d: Column) -> Column:  # noqa: E741
    return kind.isin("date", "datetime", "time") | (kind.isin("int", "float") & _year(l, d)) | ((kind == "string") & F.coalesce(clean_label(s).rlike(C.GATE_VALUE), F.lit(False)))


def axis_value_bonus(kind: Column, s: Column) -> Column:
    return kind.isin("date", "datetime") | ((kind == "string") & F.coalesce(strip(s).rlike(C.BONUS_VALUE), F.lit(False)))


def axis_text_rows(s: Column) -> Column:
    return F.coalesce(strip(s).rlike("(?i)" + C.ROW_VALUE), F.lit(False))


def axis_value_rows(kind: Column, s: Column, l: Column, d: Column) -> Column:  # noqa: E741
    return kind.isin("date", "datetime", "time") | (kind.isin("int", "float") & _year(l, d)) | ((kind == "string") & axis_text_rows(s))


def axis_value_strict(kind: Column, s: Column) -> Column:
    """Proof of an axis under a blank header: bare years are none."""
    return kind.isin("date", "datetime", "time") | ((kind == "string") & axis_text_rows(s))


def code_like(text: Column) -> Column:
    """A compact series code: short, no white space, two separators or more, a letter."""
    t = strip(text)
    separators = F.length(F.regexp_replace(t, "[^:_./-]", ""))
    return F.coalesce((F.length(t) <= C.CODE_MAX_LENGTH) & t.rlike(C.CODE_LABEL) & (separators >= 2) & t.rlike(r"\p{L}"), F.lit(False))


def float_like(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(C.FLOAT_TEXT), F.lit(False))


def numeric_measure(kind: Column, s: Column) -> Column:
    return kind.isin("int", "float") | ((kind == "string") & (F.coalesce(strip(s) == "", F.lit(False)) | float_like(s)))


def keyword_hit(label: Column, keywords: tuple[str, ...] = C.SKIP_KEYWORDS) -> Column:
    """One-letter keywords must be the label, longer ones begin it, whatever the case."""
    if not keywords:
        return F.lit(False)
    quoted = [re.escape(k.lower()) + ("$" if len(k) == 1 else "") for k in keywords]
    return F.coalesce(F.lower(strip(label)).rlike("^(" + "|".join(quoted) + ")"), F.lit(False))


def thin_row(filled: Column, width: Column) -> Column:
    """A row too empty for data: below the least density, or one lone cell in three columns or more."""
    return (filled / width < C.LOW_DENSITY) | ((filled == 1) & (width >= 3))


def wide_rescue(filled: Column, width: Column, axis_value: Column) -> Column:
    """Sparse rows of wide tables stay data where their first column holds a point in time."""
    return (width >= C.WIDE_LEAST_COLUMNS) & (filled > 0) & F.coalesce(axis_value, F.lit(False))


def axis_rescue(axis_value: Column, strict_value: Column, head_axis: Column, head_filled: Column) -> Column:
    """Thin rows stay data under a header that names a time axis, or under a blank one if their value proves it."""
    no = lambda x: F.coalesce(x, F.lit(False))
    return no(axis_value) & (no(head_axis) | (head_filled.isNull() & no(strict_value)))


def value_length(kind: Column, s: Column, l: Column, d: Column) -> Column:  # noqa: E741
    """Characters of a value as text."""
    return F.when(kind == "string", F.length(s)).when(kind == "int", F.length(l.cast("string"))).when(kind == "float", F.length(F.regexp_replace(d.cast("string"), "E", "e+"))).when(kind == "bool", F.lit(5)).when(kind == "date", F.lit(19)).when(kind == "datetime", F.lit(19)).otherwise(F.lit(8))


def column_letters(n: Column) -> Column:
    """A column's letters from its number, for up to three letters."""
    letter = lambda x: F.char((x + 65).cast("int"))
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def a1_span(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), F.concat(column_letters(left), F.lit(":"), column_letters(right)))


def base0(row: Column) -> Column:
    """A row counted from 0; rows are numbered from 1, anything less is an error."""
    return F.when(row >= 1, row - 1).otherwise(F.when(row.isNotNull(), F.raise_error(F.concat(F.lit("rows are numbered from 1: "), row.cast("string"))).cast("int")))


def row_count(start: Column, end: Column) -> Column:
    """Rows of a region, null where it is unresolved."""
    return F.greatest(end - start + 1, F.lit(0))


def table_span(left: Column, right: Column, max_col: Column) -> tuple[Column, Column]:
    """Columns of a table: all where a bound is missing, at least one."""
    lo = F.coalesce(left, F.lit(1))
    return lo, F.greatest(F.coalesce(right, max_col), lo)


def flatten_levels(levels: Column) -> Column:
    """One name from header levels: missing, empty and unnamed ones are left out."""
    return F.array_join(F.filter(levels, lambda x: x.isNotNull() & (x != "") & ~x.rlike(C.UNNAMED)), " / ")


def markdown_cell(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), "\r\n|\n|\r", " "), F.lit(""))


def iso_timestamp(ts: Column) -> Column:
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)))
