"""A batch data source for XLSX workbooks: zip and XML read and written in streams, one partition per sheet.

Options: ``path`` (a workbook, or a folder of them, reachable from the executors), ``sheet`` (all by default). Rows are
(file, sheet, row, cells); cells are text by column letter, so long or zero-led digit runs keep their digits. Written tables
make a workbook for each task in the folder ``path``; ``rowsPerSheet`` bounds a sheet.
"""

from __future__ import annotations

import glob
import os
import re
import tempfile
import time
import uuid
import zipfile
from array import array
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import NumericType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Uncompressed bytes that a workbook may have.
MOST_BYTES = 2 << 30
#: Rows that a sheet can hold.
MOST_ROWS = 1_048_576
#: Seconds after which an attempt that nothing writes to is taken for lost.
DEAD = 7 * 24 * 3600
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str, part: str) -> None:
        super().__init__(0)
        self.path, self.sheet, self.part = path, sheet, part


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook."""
    with zipfile.ZipFile(path) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError(f"{path} is larger than {MOST_BYTES} bytes when expanded")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), "xl/" + targets[s.get(_REL)].removeprefix("/xl/")) for s in book.iter(_MAIN + "sheet")]


class SharedStrings:
    """The shared strings of a workbook in a file that vanishes when closed, read by offset; in memory are 8 bytes for each
    string and the last ``KEPT`` ones that were read."""

    KEPT = 4096

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.file = tempfile.TemporaryFile(prefix="ledgerline-strings-")  # noqa: SIM115
        self.ends = array("q", [0])
        self.kept: dict[int, str] = {}
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for e in _elements(f, "si"):
                    data = "".join(t.text or "" for t in e.iter(_MAIN + "t")).encode()
                    self.file.write(data)
                    self.ends.append(self.ends[-1] + len(data))

    def __getitem__(self, i: int) -> str:
        found = self.kept.get(i)
        if found is None:
            if not 0 <= i < len(self.ends) - 1:
                raise IndexError(f"no shared string {i}")
            self.file.seek(self.ends[i])
            found = self.file.read(self.ends[i + 1] - self.ends[i]).decode()
            if len(self.kept) >= self.KEPT:
                del self.kept[next(iter(self.kept))]
            self.kept[i] = found
        return found

    def close(self) -> None:
        self.file.close()


def _elements(f, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, one at a time: what was given is taken out of its parent."""
    open_: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(f, events=("start", "end")):
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if e.tag == _MAIN + name:
            yield e
            if open_:
                open_[-1].clear()


def _cell(e: ElementTree.Element, shared: SharedStrings) -> str:
    kind, value = e.get("t"), e.findtext(_MAIN + "v") or ""
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return "".join(t.text or "" for t in e.iter(_MAIN + "t"))
    if kind in ("str", "b", "e"):
        return value
    return re.sub(r"\.0+$", "", value)


def rows(path: str, part: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, cells by column) of a sheet, one row in memory at a time."""
    with zipfile.ZipFile(path) as z, closing(SharedStrings(z)) as shared, z.open(part) as f:
        for e in _elements(f, "row"):
            cells = {re.sub(r"\d+", "", c.get("r", "")): _cell(c, shared) for c in e.iter(_MAIN + "c")}
            yield int(e.get("r", 0)), {k: v for k, v in cells.items() if v != ""}


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> list[SheetPartition]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".xlsx")) if os.path.isdir(self.path) else [self.path]
        return [SheetPartition(f, name, part) for f in files for name, part in sheets(f) if self.sheet in (None, name)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        for number, cells in rows(partition.path, partition.part):
            yield partition.path, partition.sheet, number, cells


@dataclass
class Written(WriterCommitMessage):
    """The workbook of a task, under the name of its attempt."""

    attempt: str
    rows: int


class XlsxWriter(DataSourceWriter):
    """A workbook for each task, rows streamed to its sheets. Text stays text (identifiers keep their zeros and nothing becomes a
    formula), numbers are numbers. Workbooks get their names, which carry the write's id, when the whole write is committed: an
    append adds to what is there, an overwrite then removes all that was there before, and workbooks of lost attempts go."""

    def __init__(self, options: dict[str, str], schema, overwrite: bool) -> None:
        self.path, self.most, self.overwrite = options["path"], int(options.get("rowspersheet", MOST_ROWS)), overwrite
        self.columns = [(f.name, isinstance(f.dataType, NumericType)) for f in schema.fields]
        self.id = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        attempt = os.path.join(self.path, f"_{self.id}-{uuid.uuid4().hex}.part")
        try:
            return Written(attempt, self._fill(attempt, iterator))
        except BaseException:
            self._remove([attempt])
            raise

    def _fill(self, path: str, iterator: Iterator) -> int:
        head = [(name, False) for name, _ in self.columns]
        n, sheets = 0, 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            rest = iter(iterator)
            row = next(rest, None)
            while row is not None or not sheets:
                sheets += 1
                with z.open(f"xl/worksheets/sheet{sheets}.xml", "w") as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{_line(1, [h for h, _ in head], head)}'.encode())
                    at = 1
                    while row is not None and at < self.most:
                        at += 1
                        f.write(_line(at, row, self.columns).encode())
                        n += 1
                        row = next(rest, None)
                    f.write(b"</sheetData></worksheet>")
            _frame(z, [f"rows{i}" for i in range(1, sheets + 1)])
        return n

    def commit(self, messages: list) -> None:
        before = glob.glob(os.path.join(glob.escape(self.path), "*.xlsx"))
        for i, m in enumerate(m for m in messages if m is not None):
            os.replace(m.attempt, os.path.join(self.path, f"part-{i:05d}-{self.id}.xlsx"))
        # an overwrite clears the folder; what killed writes left goes when it is older than any write takes
        self._remove([*before, *self._attempts("_*.part")] if self.overwrite else [*self._attempts(f"_{self.id}-*.part"), *self._dead()])

    def abort(self, messages: list) -> None:
        self._remove(self._attempts(f"_{self.id}-*.part"))

    def _attempts(self, pattern: str) -> list[str]:
        return glob.glob(os.path.join(glob.escape(self.path), pattern))

    def _dead(self) -> list[str]:
        return [p for p in self._attempts("_*.part") if os.path.getmtime(p) < time.time() - DEAD]

    @staticmethod
    def _remove(paths: list[str]) -> None:
        for path in paths:
            if os.path.exists(path):
                os.remove(path)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "file string, sheet string, row int, cells map<string,string>"

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def _column(i: int) -> str:
    return (_column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def _line(number: int, values, columns: list[tuple[str, bool]]) -> str:
    """A row of cells; what is null has none, and characters that XML forbids are left out."""
    cells = []
    for i, (v, (_, numeric)) in enumerate(zip(values, columns, strict=True)):
        if v is None or v == "":
            continue
        at = f'<c r="{_column(i)}{number}"'
        cells.append(f"{at}><v>{v}</v></c>" if numeric else f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", str(v)))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _frame(z: zipfile.ZipFile, names: list[str]) -> None:
    """The parts of a workbook beside its sheets."""
    main, office = _MAIN[1:-1], _REL[1 : _REL.index("}")]
    z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>')
    z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")


def write_workbook(path: str, tables: dict[str, list[list[str]]]) -> None:
    """A small workbook of text cells, a sheet per table, written whole and then moved into place."""
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        _frame(z, list(tables))
        for i, lines in enumerate(tables.values(), 1):
            rows_ = (_line(r, cells, [("", False)] * len(cells)) for r, cells in enumerate(lines, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(rows_)}</sheetData></worksheet>')
    os.replace(part, path)
