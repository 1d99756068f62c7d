"""Tables of one workbook, loaded as DataFrames from its cells."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptWorkbookError, InspectorError
from ..functions import cells as X
from ..operators import merges as M
from ..operators import names
from ..options import InspectionOptions
from ..results import ROW, ColumnInfo, ReadPlan, SheetResultEntry, TableResult, WorkbookResult
from ..sources import xlsx
from .inspection import BLOCK, Inspection, inspect_relations

DTYPES = {"numeric_text": "string", "text": "string", "date": "datetime64[ns]", "mixed": "object"}
HEADERLESS_NOTE = "headerless table: no types inferred"
ASSUMED_NOTE = "no header found: the first row is taken as header; check it or give a header row"


class Workbooks:
    """Cells, sheets and merges of the workbooks at a path or glob, held for the many uses an inspection makes of them.

    Closing lets go of them, once or more often; a closed one can't be read.
    """

    def __init__(self, spark: SparkSession, path: str, strict: bool = True):
        self._records = xlsx.read_workbooks(spark, _checked(path, strict), strict).persist()

    def relations(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self._records is None:
            raise RuntimeError("the workbooks are closed")
        return xlsx.relations(self._records)

    def close(self) -> None:
        held, self._records = self._records, None
        if held is not None:
            held.unpersist()

    def __enter__(self) -> Workbooks:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _checked(path: str, strict: bool) -> str:
    """The path as Spark takes it; local files are looked at first, for errors that say more."""
    if "://" in path:
        return path
    found = glob.glob(path) if any(c in path for c in "*?[") else [path]
    for p in found or [path]:
        if not os.path.exists(p):
            raise CorruptWorkbookError(f"no such file: {p}")
        if strict and os.path.isfile(p):
            with open(p, "rb") as f:
                xlsx.check_container(f.read(8), p)
    if strict and len(found) == 1 and os.path.isfile(found[0]):
        import zipfile

        if not zipfile.is_zipfile(found[0]):
            raise CorruptWorkbookError(f"not a workbook: {path}")
    return os.path.abspath(path)


def inspect(spark: SparkSession, path: str, options: InspectionOptions | None = None, strict: bool = True) -> Inspection:
    """Relations of the tables in all workbooks at a path or glob."""
    books = Workbooks(spark, path, strict)
    found = inspect_relations(*books.relations(), options)
    found.close = books.close
    return found


def _text() -> Column:
    d = F.col("d")
    number = F.when(d == F.floor(d), F.concat(d.cast("long").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))
    return F.coalesce("s", F.col("l").cast("string"), number, F.col("b").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _column(c: int, kind: str, integral: bool, na: tuple[str, ...]) -> Column:
    at = F.col("col") == c
    pick = lambda x: F.max(F.when(at, x))
    if kind == "number":
        number = F.coalesce(F.col("l").cast("double"), F.col("d"), F.expr("try_cast(replace(s, '_', '') AS double)"))
        return pick(F.col("l")) if integral else pick(number)
    if kind == "date":
        return pick(F.coalesce(F.col("ts"), F.expr("try_cast(s AS timestamp_ntz)")))
    text = pick(_text())
    return F.when(~text.isin(*na), text) if na else text


def load_table(cells: DataFrame, block, columns: list[tuple[int, str, bool]], labels: list[str], na: tuple[str, ...]) -> DataFrame:
    """The table's rows, their sheet row in ``ROW``; ``columns``: (column, type, whole numbers only).

    Rows without any value are rows too, unless the block skips them.
    """
    there = cells.sparkSession.range(block["data_start"], max(block["data_start"], block["data_end"] + 1)).select(F.col("id").cast("int").alias("row"))
    if block["skip_rows"]:
        there = there.filter(~F.col("row").isin(*block["skip_rows"]))
    rows = cells.filter((F.col("file") == block["file"]) & (F.col("sheet_idx") == block["sheet_idx"]) & F.col("row").between(block["data_start"], block["data_end"]))
    lo, hi = columns[0][0], columns[-1][0]
    wide = rows.filter(F.col("col").between(lo, hi)).groupBy("row").agg(*[_column(c, kind, whole, na).alias(f"c{c}") for c, kind, whole in columns])
    return there.join(wide, "row", "left").select(F.col("row").alias(ROW), *[F.col(f"c{c}").alias(n) for (c, _, _), n in zip(columns, labels)])


def load_dataframe(spark: SparkSession, path: str, plan: ReadPlan, options: InspectionOptions | None = None) -> DataFrame:
    """The table that a read plan describes, in sheet order."""
    na = (options or InspectionOptions()).na_values
    cells, sheets, merged = Workbooks(spark, path).relations()
    sheet = sheets.filter(F.col("sheet") == plan.sheet_name).first()
    if sheet is None:
        raise InspectorError(f"no sheet {plan.sheet_name!r} in {path}")
    skipped = set(plan.skiprows)
    heads = plan.header if isinstance(plan.header, list) else [] if plan.header is None else [next(r for r in range(sheet["max_row"] + plan.header + 1) if r - sum(x < r for x in skipped) == plan.header and r not in skipped)]
    first = heads[-1] + 1 if heads else next(r for r in range(len(skipped) + 1) if r not in skipped)
    last = sheet["max_row"] - 1 if plan.nrows is None else min(first + plan.nrows, sheet["max_row"]) - 1
    lo, hi = (1, sheet["max_col"]) if plan.usecols is None else [xlsx.place(x + "1")[1] for x in plan.usecols.split(":")]
    span = range(lo, hi + 1)
    here = cells.filter((F.col("sheet_idx") == sheet["sheet_idx"]) & F.col("col").between(lo, hi))
    head = here.filter(F.col("row").isin(*[h + 1 for h in heads] or [0])).select("row", "col", X.strip(_text()).alias("label"))
    if len(heads) > 1:  # labels of the upper levels stand over all columns of their merges
        over = merged.filter((F.col("sheet_idx") == sheet["sheet_idx"]) & (F.col("min_row") <= heads[-1] + 1))
        head = M.level_labels(head, over, [])
    text = {(r["row"], r["col"]): r["label"] for r in head.collect()}
    labels = [" / ".join(x for x in (text.get((h + 1, c)) for h in heads) if x) or None for c in span]
    block = {"file": sheet["file"], "sheet_idx": sheet["sheet_idx"], "data_start": first + 1, "data_end": last + 1, "skip_rows": sorted(r + 1 for r in skipped if first <= r <= last)}
    given = {"datetime64[ns]": "date", "string": "text", "object": "text"}
    types = _value_types(here.filter(F.col("row").between(first + 1, last + 1)), ["col"], na)
    seen = {r["col"]: r for r in types.collect()}
    typed = [_fitting(c, given.get(plan.dtype_map.get(str(c - lo)), "number" if c in seen and set(seen[c]["kinds"]) <= {"int", "float"} else "text"), seen.get(c)) for c in span]
    return load_table(cells, block, typed, names.column_names(labels, plan.header is None), na).orderBy(ROW).drop(ROW)


def _value_types(cells: DataFrame, keys: list[str], na: tuple[str, ...]) -> DataFrame:
    """(keys, kinds, worded, undated) over all rows: kinds of values, and whether a text is no number, and no date."""
    text = (F.col("kind") == "string") & ~F.col("s").isin(*na, "")
    return cells.filter("kind IS NOT NULL").groupBy(*keys).agg(
        F.collect_set("kind").alias("kinds"),
        F.coalesce(F.bool_or(text & F.expr("try_cast(replace(s, '_', '') AS double)").isNull()), F.lit(False)).alias("worded"),
        F.coalesce(F.bool_or(text & F.expr("try_cast(s AS timestamp_ntz)").isNull()), F.lit(False)).alias("undated"),
    )


def _fitting(c: int, kind: str, seen) -> tuple[int, str, bool]:
    """(column, a type that all its values have, whole numbers only): a column of several types is text, so that no value is lost."""
    kinds = set(seen["kinds"]) if seen is not None else set()
    if kind == "number" and (kinds - {"int", "float", "string"} or (seen is not None and seen["worded"])):
        kind = "mixed"
    if kind == "date" and (kinds - {"date", "datetime", "string"} or (seen is not None and seen["undated"])):
        kind = "mixed"
    return c, kind, kinds == {"int"}


def _labels(block, span: range, head: dict, merges: list) -> list[str | None]:
    """Labels of a table's columns: of one header row, or of all its levels joined."""
    rows = range(block["top_row"], block["header_row"] + 1)

    def at(r: int, c: int) -> str | None:
        for m in merges:
            if m["min_row"] <= r <= m["max_row"] and m["min_col"] <= c <= m["max_col"]:
                return head.get((m["min_row"], m["min_col"])) if r == m["min_row"] or len(rows) == 1 else None
        return head.get((r, c))

    if len(rows) == 1:
        return [head.get((block["header_row"], c)) for c in span]
    return [" / ".join(x for x in (at(r, c) for r in rows) if x) or None for c in span]


def extract(spark: SparkSession, path: str, options: InspectionOptions | None = None) -> WorkbookResult:
    """All tables of one workbook."""
    options = options or InspectionOptions()
    found = inspect(spark, path, options)
    blocks = found.blocks
    taken = [r.asDict(True) for r in blocks.orderBy("sheet_idx", "band_no").collect()]  # one row a band of one workbook
    sheets = found.sheets.orderBy("sheet_idx").collect()
    columns: dict[tuple, list] = {}
    for r in found.columns.orderBy("sheet_idx", "band_no", "col").collect():
        columns.setdefault((r["sheet_idx"], r["band_no"]), []).append(r)
    warnings = [r["message"] for r in found.warnings.orderBy("sheet_idx", "band_no", "seq").collect()]
    merges = M.positioned(found.merges, ["file", "sheet_idx"]).orderBy("sheet_idx", "position").collect()
    loose = blocks.filter("is_table OR (n_bands = 1 AND NOT is_table)")
    kinds: dict[tuple, object] = {}
    spans = loose.select(*BLOCK, F.coalesce("data_start", "start_row").alias("lo"), F.coalesce("data_end", "end_row").alias("hi"), "skip_rows", "header_row")
    body = found.cells.join(spans, ["file", "sheet_idx"]).filter("kind IS NOT NULL AND row BETWEEN lo AND hi AND NOT array_contains(skip_rows, row) AND (header_row IS NOT NULL OR row >= lo)")
    for r in _value_types(body, ["sheet_idx", "band_no", "col"], options.na_values).collect():
        kinds[(r["sheet_idx"], r["band_no"], r["col"])] = r
    heads = found.cells.join(loose.select(*BLOCK, F.coalesce("top_row", "start_row").alias("lo"), F.coalesce("header_row", "start_row").alias("hi")), ["file", "sheet_idx"]).filter("row BETWEEN lo AND hi").select("sheet_idx", "row", "col", X.strip(_text()).alias("t")).collect()
    head = {}
    for r in heads:
        head.setdefault(r["sheet_idx"], {})[(r["row"], r["col"])] = r["t"]
    entries = []
    for s in sheets:
        own = [b for b in taken if b["sheet_idx"] == s["sheet_idx"]]
        tables = [b for b in own if b["is_table"]]
        if s["is_tabular"] and not tables and len(own) == 1:  # nothing found in the only band: its first row is the header
            b = dict(own[0])
            if b["end_row"] > b["start_row"] or b["header_row"] is not None:
                b |= {"header_row": b["start_row"], "top_row": b["start_row"], "data_start": b["start_row"] + 1, "data_end": b["end_row"], "assumed": True, "table_no": 1}
                tables = [b]
        if not s["is_tabular"] or not tables:
            entries.append(SheetResultEntry(s["sheet"], s["is_visible"], [], True, "non-tabular" if not s["is_tabular"] else "no-table-detected"))
            continue
        mine = [m for m in merges if m["sheet_idx"] == s["sheet_idx"]]
        made = [guarded(warnings, f"sheet {s['sheet']!r}, table {i}", _table, found, s, b, columns.get((b["sheet_idx"], b["band_no"]), []), kinds, head.get(s["sheet_idx"], {}), mine, options, i, warnings) for i, b in enumerate(tables, 1)]
        entries.append(SheetResultEntry(s["sheet"], s["is_visible"], [t for t in made if t is not None]))
    return WorkbookResult(os.path.abspath(path) if "://" not in path else path, entries, warnings, found.close)


def guarded(warnings: list[str], what: str, step, *args):
    """What a step returns; its failure is a warning and None, but for errors that end an inspection."""
    try:
        return step(*args)
    except InspectorError:
        raise
    except Exception as e:
        warnings.append(f"{what}: {type(e).__name__}: {e}")
        return None


def _table(found: Inspection, s, b: dict, profiled: list, kinds: dict, head: dict, merges: list, options: InspectionOptions, number: int, warnings: list[str]) -> TableResult:
    lo, hi = b["left_col"] or 1, b["right_col"] or s["max_col"]
    usecols = None if b["left_col"] is None or (lo == 1 and hi == s["max_col"]) else f"{_letters(lo)}:{_letters(hi)}"
    if usecols and b["top_row"] is not None and not b["headerless"] and b["top_row"] < b["header_row"]:
        # a header of several levels can't go with a choice of columns
        warnings.append(f"sheet {s['sheet']!r}: header of several levels within columns {usecols}: only its last row {b['header_row']} is taken")
        b = b | {"top_row": b["header_row"], "leaf": True}
    span = range(lo, hi + 1)
    info = {r["col"]: r for r in profiled}
    bare = bool(b["headerless"])
    band = [m for m in merges if m["max_row"] >= b["start_row"] and m["min_row"] <= b["end_row"]]
    labels = [None] * len(span) if bare else _labels(b, span, head, band)
    unique = names.column_names(labels, bare)
    typed, force = [], options.of(s["sheet"]).dtype_force
    for c in span:
        seen = kinds.get((b["sheet_idx"], b["band_no"], c))
        k = set(seen["kinds"]) if seen is not None else set()
        kind = info[c]["inferred_type"] if c in info else "number" if k and k <= {"int", "float"} else "date" if k and k <= {"date", "datetime"} else "text"
        kind = {"string": "text", "str": "text", "object": "mixed"}.get(force.get(str(c - lo)), kind)
        typed.append(_fitting(c, kind, seen))
    notes = [f"body merge {m['range']} -> forward-fill top-left value" for m in band if b["header_row"] is None or m["min_row"] > b["header_row"]]
    notes += [f"formula column {info[c]['index']} ({info[c]['name']!r}): no cached results" for c in span if c in info and info[c]["read_hint"] == "as_formula"]
    notes += [f"column {c - lo} ({unique[c - lo]!r}): values of several types, loaded as text" for c, kind, _ in typed if kind == "mixed" and c in info and info[c]["inferred_type"] in ("number", "date")]
    skip_labels = {x["row"]: x["label"] for x in b["skip_labels"] or []}
    notes += [f"excluded subtotal/separator row at sheet row {r}" + (f" ({skip_labels[r]})" if skip_labels.get(r) else "") for r in b["skip_rows"] if b["data_start"] and r >= b["data_start"]]
    top = b["top_row"]
    if not bare and not b.get("leaf") and b["provenance"] == "heuristic" and top and top > b["start_row"]:
        rows = f"sheet row {b['start_row']}" if top - 1 == b["start_row"] else f"sheet rows {b['start_row']}-{top - 1}"
        notes.append(f"rows above detected header not loaded: {rows} (header at row {top}); use a header_row override if these are data rows")
    if bare:
        notes.append(HEADERLESS_NOTE)
    if b.get("assumed"):
        notes.append(ASSUMED_NOTE)
    if len(span) == 1 and b["n_bands"] > 1:
        notes.append("a band of one column: check that it is a table")
    if b["data_start"] is None:
        b = b | {"data_start": (b["header_row"] or 0) + 1, "data_end": (b["header_row"] or 0)}
    df = load_table(found.cells, b, typed, unique, options.na_values)
    many = not bare and top is not None and top < b["header_row"]
    first = b["data_start"] if bare else (top if many else b["header_row"])
    skips = list(range(0, 0 if many else first - 1)) + [r - 1 for r in b["skip_rows"] if r >= b["data_start"]]
    plan = ReadPlan(
        s["sheet"],
        None if bare else [r - 1 for r in range(top, b["header_row"] + 1)] if many else 0,
        usecols,
        sorted(set(skips)),
        max(b["data_end"] - b["data_start"] + 1, 0),
        {str(c - lo): DTYPES[k] for c, k in ((c, info[c]["inferred_type"] if c in info else k) for c, k, _ in typed) if k in DTYPES and not bare and not (c in info and info[c]["read_hint"] == "as_formula")} | force,
        notes,
    )
    cols = [ColumnInfo(c - lo, info[c]["name"] if c in info else None, info[c]["inferred_type"] if c in info else "unknown", info[c]["null_ratio"] if c in info else 0.0, bool(c in info and info[c]["has_formula"]), info[c]["read_hint"] if c in info else "as_value") for c in span]
    return TableResult(f"{s['sheet']}!T{number}", b["header_row"] if not bare else None, b["confidence"], b["provenance"], cols if not bare else [], df, plan, notes)


def _letters(n: int) -> str:
    from ..sources.xlsx_writer import letters

    return letters(n)
