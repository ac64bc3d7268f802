"""Workbooks (XLSX) with the standard library: sheets as tables with header discovery, and writing."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

# Limits of an upload.
MOST_BYTES, MOST_MEMBERS, MOST_EXPANDED = 20 << 20, 1000, 100 << 20
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _checked(data: bytes) -> zipfile.ZipFile:
    if len(data) > MOST_BYTES:
        raise ValueError("the workbook is too large")
    archive = zipfile.ZipFile(io.BytesIO(data))
    members = archive.infolist()
    if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_EXPANDED:
        raise ValueError("the workbook expands too far")
    return archive


def sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """Cell texts of a sheet by row; missing cells are None."""
    archive = _checked(data)
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in x.iter(f"{_M}t")) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_M}si")]
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    link = next((s.get(f"{_R}id") for s in book.iter(f"{_M}sheet") if s.get("name") == sheet), None)
    if link is None:
        raise ValueError(f"the workbook has no sheet {sheet}")
    rels = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == link).lstrip("/").removeprefix("xl/")
    out: list[list[str | None]] = []
    for row in ElementTree.fromstring(archive.read(f"xl/{target}")).iter(f"{_M}row"):
        cells: list[str | None] = []
        for c in row.findall(f"{_M}c"):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            place = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
            cells += [None] * (place + 1 - len(cells))
            value = c.find(f"{_M}v")
            if c.get("t") == "inlineStr":
                cells[place] = "".join(t.text or "" for t in c.iter(f"{_M}t"))
            elif value is not None:
                cells[place] = shared[int(value.text)] if c.get("t") == "s" else value.text
        out.append(cells)
    return out


def records(rows: list[list[str | None]], required: set[str]) -> list[dict[str, str | None]]:
    """Rows below the first row that has all required headers, by header (lower case, blanks as `_`); blank rows are left out."""
    name = lambda x: (x or "").strip().lower().replace(" ", "_")
    for k, row in enumerate(rows):
        headers = [name(x) for x in row]
        if required <= set(headers):
            body = [{h: (r[i] if i < len(r) else None) for i, h in enumerate(headers) if h} for r in rows[k + 1 :]]
            return [r for r in body if any((v or "").strip() for v in r.values())]
    raise ValueError(f"no row has the headers {', '.join(sorted(required))}")


def read_sheet(spark: SparkSession, data: bytes, sheet: str, columns: list[str]) -> DataFrame:
    """A governed sheet as text columns; workbooks are small by the limits above and parsed on the driver."""
    found = records(sheet_rows(data, sheet), set(columns))
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in found], ", ".join(f"`{c}` string" for c in columns))


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of text cells; texts that a spreadsheet would take for a formula are marked as text."""
    safe = lambda v: "" if v is None else f"'{v}" if isinstance(v, str) and v[:1] in tuple("=+-@") else str(v)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        pack = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_M[1:-1]}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(safe(v))}</t></is></c>' for v in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{_M[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
