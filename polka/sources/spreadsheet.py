"""OOXML and ODS sheets with the standard library, container checks, and a small OOXML writer."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polka.sources.delimited import FileError, checked

MAX_INFLATED, MAX_MEMBERS, MAX_RATIO, RATIO_FROM = 75 * 2**20, 10_000, 200, 2**20
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def zip_problem(data: bytes, members: int = MAX_MEMBERS, inflated: int = MAX_INFLATED, ratio: int | None = None) -> str | None:
    """Why an archive is refused, from its directory alone: nothing is unpacked."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        return "not an archive"
    if len(infos) > members:
        return "too many members"
    total = 0
    for i in infos:
        if i.flag_bits & 1:
            return "encrypted"
        total += i.file_size
        if total > inflated:
            return "too large unpacked"
        if ratio and i.file_size > RATIO_FROM and i.file_size > ratio * max(1, i.compress_size):
            return "compression ratio"
    return None


def container_problem(data: bytes, suffix: str) -> str | None:
    """Why a workbook's container does not fit its suffix; NULL if it does."""
    if suffix in (".xls", ".xlt"):
        return None if data.startswith(OLE) or data[:2] == b"\x09\x08" else "format"
    if problem := zip_problem(data):
        return "format" if problem == "not an archive" else problem
    names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    if suffix == ".ods":
        z = zipfile.ZipFile(io.BytesIO(data))
        good = {"mimetype", "content.xml"} <= names and z.read("mimetype").startswith(b"application/vnd.oasis.opendocument.spreadsheet")
    else:
        good = "[Content_Types].xml" in names and ("xl/workbook.bin" if suffix == ".xlsb" else "xl/workbook.xml") in names
    return None if good else "format"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text, cached values."""
    z = zipfile.ZipFile(io.BytesIO(data))
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    out = []
    for row in ET.fromstring(z.read(sheet)).iter(f"{ns}row"):
        cells: list[str | None] = []
        for k, c in enumerate(row.iter(f"{ns}c")):
            at = _column(c.get("r")) if c.get("r") else k
            cells += [None] * (at + 1 - len(cells))
            v = c.find(f"{ns}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append(cells)
    return out


def ods_rows(data: bytes) -> list[list[str | None]]:
    t = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    out = []
    for row in next(root.iter(f"{t}table")).iter(f"{t}table-row"):
        cells: list[str | None] = []
        for c in row.iter(f"{t}table-cell"):
            text = "\n".join("".join(p.itertext()) for p in c) or None
            n = int(c.get(f"{t}number-columns-repeated", "1"))
            cells += [text] * (n if text else min(n, 100))
        out.append(cells)
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as text columns with ``row_idx``; the first row is the header.

    XLS, XLT and XLSB are recognised and refused: their binary formats are not read.
    """
    suffix = path[path.rfind(".") :].lower()
    row = spark.read.format("binaryFile").load(path).select("content").first()
    data = bytes(row["content"])
    if problem := container_problem(data, suffix):
        raise FileError(problem)
    if suffix in (".xls", ".xlt", ".xlsb"):
        raise FileError("binary workbook")
    rows = ods_rows(data) if suffix == ".ods" else xlsx_rows(data)
    rows = [r for r in rows if any(r)]
    if len(rows) < 2:
        raise FileError("no rows")
    width = max(map(len, rows))
    names, seen = [], {}
    for i in range(width):
        n = (rows[0][i] if i < len(rows[0]) else None) or f"__unnamed_{i}"
        seen[n] = seen.get(n, -1) + 1
        names.append(n if not seen[n] else f"{n}.{seen[n]}")
    body = [(k, *[(r[i] or None) if i < len(r) else None for i in range(width)]) for k, r in enumerate(rows[1:])]
    schema = "row_idx bigint, " + ", ".join(f"c{i} string" for i in range(width))
    return checked(spark.createDataFrame(body, schema).toDF("row_idx", *names))


def _letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of text and number cells; None is an empty cell."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{_letters(k)}{r}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) else f'<c r="{_letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
                    for k, v in enumerate(row) if v is not None)
                body.append(f'<row r="{r}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def report_workbook(report: DataFrame, lines: DataFrame, title: str, meta: str, max_rows: int = 100_000) -> bytes:
    """The report as a workbook: title, meta, header in row 4, data from row 5; a second sheet of figures.

    A workbook is one file in one process; a report of over ``max_rows`` rows is refused, not
    cut. Larger ones are written with ``report.write``.
    """
    rows = report.take(max_rows + 1)
    if len(rows) > max_rows:
        raise FileError("report too large for a workbook")
    detail = [[title], [meta], [], list(report.columns), *[list(r) for r in rows]]
    return workbook({"Report": detail, "Summary": [[r["label"], r["value"]] for r in lines.collect()]})  # 13 lines


def zip_members(files: DataFrame) -> DataFrame:
    """``path, member, size, packed`` of every archive in ``binaryFile`` rows, and ``problem`` per archive."""
    import pandas as pd

    def run(it):
        for df in it:
            rows = []
            for path, data in zip(df["path"], df["content"], strict=True):
                problem = zip_problem(bytes(data), members=500, ratio=MAX_RATIO)
                infos = [] if problem else zipfile.ZipFile(io.BytesIO(bytes(data))).infolist()
                rows += [(path, i.filename, i.file_size, i.compress_size, None) for i in infos if not i.is_dir()]
                if problem:
                    rows.append((path, None, None, None, problem))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "packed", "problem"]).astype({"size": "Int64", "packed": "Int64"})

    return files.select("path", F.col("content")).mapInPandas(run, "path string, member string, size bigint, packed bigint, problem string")
