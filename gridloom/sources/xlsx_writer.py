"""A small workbook writer on the standard library: values, formulas, merges, sheet states."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


@dataclass
class Formula:
    text: str
    cached: object = None


@dataclass
class Sheet:
    name: str
    rows: dict[int, list] = field(default_factory=dict)
    merges: list[str] = field(default_factory=list)
    state: str = "visible"
    first_col: int = 1


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, Formula):
        cached = "" if v.cached is None else f"<v>{v.cached}</v>"
        return f'<c r="{ref}"><f>{escape(v.text.lstrip("="))}</f>{cached}</c>'
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, (dt.date, dt.datetime)):
        at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        days = (at - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook_bytes(sheets: list[Sheet]) -> bytes:
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s.name)} sheetId="{i}" r:id="rId{i}" state="{s.state}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{_NS}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    for i, s in enumerate(sheets, 1):
        rows = "".join(f'<row r="{r}">' + "".join(_cell(f"{letters(s.first_col + k)}{r}", v) for k, v in enumerate(vs)) + "</row>" for r, vs in sorted(s.rows.items()))
        merged = f'<mergeCells count="{len(s.merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in s.merges) + "</mergeCells>" if s.merges else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_NS}"><sheetData>{rows}</sheetData>{merged}</worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>\n' + text)
    return out.getvalue()
