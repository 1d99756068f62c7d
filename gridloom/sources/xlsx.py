"""Workbooks as relations.

Files are read by Spark's ``binaryFile`` source, so they may lie in any store
Spark knows, and parsed with the standard library, one workbook after another
in each task: cells with values, formulas and cached results in one pass, and
merged ranges and sheet states beside them.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptWorkbookError, EncryptedWorkbookError

# Container and package names of the format.
OLE2_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 36, 50, 51, 52, 53, 54, 57, 58}
TIME_FORMATS = {18, 19, 20, 21, 32, 33, 34, 35, 45, 46, 47, 55, 56}

PARTS = "rec string, file string, sheet_idx int, sheet string, row int, col int, kind string, s string, l bigint, d double, b boolean, ts timestamp_ntz, formula string, has_cache boolean, is_visible boolean, max_row int, max_col int, error string"
CELLS = ["file", "sheet_idx", "sheet", "row", "col", "kind", "s", "l", "d", "b", "ts", "formula", "has_cache"]
_ARROW = pa.schema([("rec", pa.string()), ("file", pa.string()), ("sheet_idx", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("s", pa.string()), ("l", pa.int64()), ("d", pa.float64()), ("b", pa.bool_()), ("ts", pa.timestamp("us")), ("formula", pa.string()), ("has_cache", pa.bool_()), ("is_visible", pa.bool_()), ("max_row", pa.int32()), ("max_col", pa.int32()), ("error", pa.string())])
_NAMES = _ARROW.names
BATCH_ROWS = 20_000


def check_container(head: bytes, name: str) -> None:
    """Raise the error that a file's first bytes call for."""
    if head.startswith(OLE2_MAGIC):
        raise EncryptedWorkbookError(f"encrypted or legacy workbook: {name}")
    if not head.startswith(b"PK"):
        raise CorruptWorkbookError(f"not a workbook: {name}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def place(ref: str) -> tuple[int, int]:
    """(row, column) of an A1 reference, from 1."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref)
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    for _, e in ET.iterparse(z.open("xl/sharedStrings.xml")):
        if _local(e.tag) == "si":
            out.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
            e.clear()
    return out


def _formats(z: zipfile.ZipFile) -> list[str | None]:
    """date, time or None for each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.parse(z.open("xl/styles.xml")).getroot()
    own = {}
    for e in root.iter():
        if _local(e.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()
            own[int(e.get("numFmtId"))] = "date" if re.search("[yd]", code) else "time" if re.search("[hs]", code) else None
    out = []
    for e in root.iter():
        if _local(e.tag) == "cellXfs":
            for x in e:
                n = int(x.get("numFmtId", "0"))
                out.append(own.get(n, "date" if n in DATE_FORMATS else "time" if n in TIME_FORMATS else None))
    return out


def _value(kind: str, text: str | None, style: str | None, epoch: dt.datetime, strings: list[str]) -> dict:
    if text is None or text == "":
        return {}
    if kind == "s":
        text = strings[int(text)]
    if kind in ("s", "str", "inlineStr", "e"):
        return {"kind": "string", "s": text} if text != "" else {}
    if kind == "b":
        return {"kind": "bool", "b": text == "1"}
    if kind == "d":
        return {"kind": "datetime", "ts": dt.datetime.fromisoformat(text)}
    if style:
        n = float(text)
        if style == "time" and n < 1:
            return {"kind": "time", "ts": epoch + dt.timedelta(days=n)}
        return {"kind": "datetime", "ts": epoch + dt.timedelta(microseconds=round(n * 86_400_000) * 1000)}
    if re.fullmatch(r"[+-]?[0-9]+", text) and abs(int(text)) < 1 << 63:
        return {"kind": "int", "l": int(text)}
    return {"kind": "float", "d": float(text)}


def parse(name: str, content: bytes) -> Iterator[dict]:
    """Records of one workbook: its cells, merges and sheets."""
    check_container(content[:8], name)
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        book = ET.parse(z.open("xl/workbook.xml")).getroot()
        links = {e.get("Id"): e.get("Target") for e in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        strings, formats = _shared(z), _formats(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, EOFError) as e:
        raise CorruptWorkbookError(f"not a workbook: {name}: {e}") from e
    late = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    for i, sheet in enumerate(e for e in book.iter() if _local(e.tag) == "sheet"):
        title = sheet.get("name")
        base = {"file": name, "sheet_idx": i, "sheet": title}
        target = links[sheet.get(_REL)].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        rows = cols = at_row = 0
        try:
            for _, e in ET.iterparse(z.open(target)):
                tag = _local(e.tag)
                if tag == "row":
                    at_row = int(e.get("r", at_row + 1))
                    at_col = 0
                    for c in e:
                        at_col = place(c.get("r"))[1] if c.get("r") else at_col + 1
                        text = formula = None
                        for x in c.iter():
                            t = _local(x.tag)
                            if t == "v":
                                text = x.text
                            elif t == "f":
                                formula = "=" + (x.text or "")
                            elif t == "t" and c.get("t") == "inlineStr":
                                text = (text or "") + (x.text or "")
                        style = formats[int(c.get("s", "0"))] if formats and int(c.get("s", "0")) < len(formats) else None
                        v = _value(c.get("t", "n"), text, style, epoch, strings)
                        rows, cols = max(rows, at_row), max(cols, at_col)
                        if v or formula:
                            yield base | {"rec": "cell", "row": at_row, "col": at_col, "formula": formula, "has_cache": bool(v)} | v
                    e.clear()
                elif tag == "mergeCell":
                    a, _, b = e.get("ref").partition(":")
                    (r0, c0), (r1, c1) = place(a), place(b or a)
                    yield base | {"rec": "merge", "row": r0, "col": c0, "max_row": r1, "max_col": c1, "s": e.get("ref")}
        except (zipfile.BadZipFile, ET.ParseError, EOFError, KeyError) as e:
            raise CorruptWorkbookError(f"not a workbook: {name}: {e}") from e
        yield base | {"rec": "sheet", "is_visible": sheet.get("state", "visible") == "visible", "max_row": max(rows, 1), "max_col": max(cols, 1), "b": rows > 0}


def read_workbooks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Tagged records (``rec``: cell, merge, sheet, error) of all workbooks at a path or glob.

    ``strict``: a file that can't be opened ends the job; else it gives an
    error record and the others go on.
    """
    return parsed(spark.read.format("binaryFile").load(path), strict)


def parsed(files: DataFrame, strict: bool = True) -> DataFrame:
    """Records of files given as (path, content)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held = []
                try:
                    for r in parse(name, content):
                        held.append(r)
                        if len(held) >= BATCH_ROWS:
                            yield _batch(held)
                            held = []
                except (CorruptWorkbookError, EncryptedWorkbookError) as e:
                    if strict:
                        raise
                    held.append({"rec": "error", "file": name, "error": f"{type(e).__name__}: {e}"})
                if held:
                    yield _batch(held)

    return files.select("path", "content").mapInArrow(run, PARTS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW.field(n).type) for n in _NAMES], schema=_ARROW)


def relations(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, sheets, merges) of tagged records, which should be persisted or written."""
    cells = records.filter("rec = 'cell'").select(*CELLS)
    sheets = records.filter("rec = 'sheet'").select("file", "sheet_idx", "sheet", "is_visible", "max_row", "max_col", F.col("b").alias("used_range_trusted"))
    merges = records.filter("rec = 'merge'").select("file", "sheet_idx", F.col("s").alias("range"), F.col("row").alias("min_row"), F.col("col").alias("min_col"), "max_row", "max_col")
    return cells, sheets, merges
