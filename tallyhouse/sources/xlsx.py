"""A Spark data source of XLSX sheets: all cells as text, nothing inferred.

``spark.dataSource.register(XlsxDataSource)``, then
``spark.read.format("xlsx").schema(...).option("path", ...).load()``. Paths
with several files (comma-separated) give a partition each. The schema's names
have to be the header, in order. Option ``sheet_name`` finds a sheet by the
workbook's relations, ``sheet`` by its part. Formulas, repeated cells, rows out
of order and document types are refused; a missing cell is an empty text.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELL = re.compile(r"([A-Z]+)([0-9]+)\Z")


class SheetError(ValueError):
    """A sheet that breaks its contract."""


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def text_of(node) -> str:
    """All text runs of a shared or inline string, phonetic hints left out."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == MAIN + "t" else child.findall(MAIN + "t") if child.tag == MAIN + "r" else []))


def checked(raw: bytes) -> bytes:
    if b"<!DOCTYPE" in raw[:4096]:
        raise SheetError("a document type is not allowed")
    return raw


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(checked(book.read("xl/sharedStrings.xml")))
    return [text_of(si) for si in root.findall(MAIN + "si")]


def sheet_member(book: zipfile.ZipFile, name: str) -> str:
    """The part of the archive that holds the sheet of a name, by the workbook's own relations."""
    sheets = ElementTree.fromstring(checked(book.read("xl/workbook.xml"))).findall(f"{MAIN}sheets/{MAIN}sheet")
    found = [s.get(f"{LINKS}id") for s in sheets if s.get("name") == name]
    if len(found) != 1:
        raise SheetError(f"{len(found)} sheets of the name {name!r}")
    targets = {r.get("Id"): r for r in ElementTree.fromstring(checked(book.read("xl/_rels/workbook.xml.rels")))}
    link = targets.get(found[0])
    if link is None or not (link.get("Type") or "").endswith("/worksheet") or link.get("TargetMode") not in (None, "Internal"):
        raise SheetError(f"{name!r} is no sheet of this workbook")
    target = link.get("Target") or ""
    member = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    if member not in book.namelist():
        raise SheetError(f"{member} is missing")
    return member


def sheet_rows(path: str, sheet: str = "xl/worksheets/sheet1.xml", name: str | None = None):
    """(row number, {column number: text}) of a sheet, streamed; name: look the sheet up in the workbook."""
    with zipfile.ZipFile(path) as book:
        strings = shared_strings(book)
        with book.open(sheet_member(book, name) if name else sheet) as f:
            checked(f.peek(4096))
            rows, last = None, 0
            for event, node in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    if node.tag == MAIN + "sheetData":
                        rows = node
                    continue
                if node.tag != MAIN + "row":
                    continue
                number = int(node.get("r") or 0)
                if number <= last:
                    raise SheetError(f"row {number} after row {last}")
                last = number
                yield number, row_cells(node, strings)
                if rows is not None:  # a cleared row would still hang on its parent
                    rows.clear()


def row_cells(node, strings: list[str]) -> dict[int, str]:
    cells: dict[int, str] = {}
    for c in node.findall(MAIN + "c"):
        m = CELL.match(c.get("r") or "")
        if not m:
            raise SheetError("a cell without a reference")
        if c.find(MAIN + "f") is not None:
            raise SheetError(f"a formula in {m[0]}")
        at = column_number(m[1])
        if at in cells:
            raise SheetError(f"repeated cell {m[0]}")
        kind, v = c.get("t"), c.find(MAIN + "v")
        if kind == "inlineStr":
            inline = c.find(MAIN + "is")
            cells[at] = text_of(inline) if inline is not None else ""
        else:
            raw = (v.text or "") if v is not None else ""
            if kind == "s" and not (raw.isascii() and raw.isdigit() and int(raw) < len(strings)):
                raise SheetError(f"no shared text {raw!r} for {m[0]}")
            cells[at] = strings[int(raw)] if kind == "s" else raw
    return cells


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.paths = [p for p in (options.get("path") or "").split(",") if p]
        self.sheet = options.get("sheet") or "xl/worksheets/sheet1.xml"
        self.named = options.get("sheet_name")
        self.expected = int(options["rows"]) if options.get("rows") else None

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        rows = sheet_rows(partition.value.removeprefix("file:"), self.sheet, self.named)
        header = next(rows, (0, {}))[1]
        names = [header.get(i, "") for i in range(1, max(header, default=0) + 1)]
        if names != self.names or len(set(names)) != len(names) or not all(n.strip() for n in names):
            raise SheetError(f"the header of {partition.value} is not the declared one")
        n = 0
        for _, cells in rows:
            if cells and max(cells) > len(names):
                raise SheetError("a cell beyond the header")
            n += 1
            yield tuple(cells.get(i, "") for i in range(1, len(names) + 1))
        if self.expected is not None and n != self.expected:
            raise SheetError(f"{n} rows, not {self.expected}")


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        raise SheetError("an XLSX source needs a declared schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(schema, dict(self.options))
