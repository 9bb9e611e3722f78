"""Spreadsheet workbooks (.xlsx) as a Spark data source, one partition a sheet.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").load("lines.xlsx")

A workbook is a zip of XML files. Each sheet is read by a task of its own as a
stream of rows; only the table of shared strings is held. The first row of a sheet
names its columns; sheets are joined by name. All values come as strings: numbers
as written in the file, whole ones without a fraction, cells in a date format as
timestamps, true and false for booleans; empty and error cells are null. The
sheet's name is ``SourceSheet``. The path must be readable on every machine.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from glob import glob
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SHEET = "SourceSheet"
#: Built-in number formats that show a date or a time. Fixed values.
DATES = {*range(14, 23), *range(45, 48)}


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _rows_of(stream, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of one name, each taken out of the tree once it has been used."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _name(e.tag) == wanted:
            yield e
            if above:
                above[-1].remove(e)


def _column(ref: str) -> int:
    """A1 is 0, B1 is 1, AA1 is 26."""
    out = 0
    for c in ref:
        if not c.isalpha():
            break
        out = 26 * out + ord(c.upper()) - 64
    return out - 1


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic ones."""
    out = []
    for child in e:
        if _name(child.tag) == "t":
            out.append(child.text or "")
        elif _name(child.tag) == "r":
            out += [t.text or "" for t in child if _name(t.tag) == "t"]
    return "".join(out)


class Book:
    """What sheets share: their names and files, strings, date formats and the day that dates count from."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: dict[str, str] = {}
        self.start = datetime(1899, 12, 30)
        for e in book.iter():
            if _name(e.tag) == "sheet":
                target = links[next(v for k, v in e.attrib.items() if _name(k) == "id")]
                self.sheets[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            elif _name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true"):
                self.start = datetime(1904, 1, 1)
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {e.get("numFmtId"): e.get("formatCode", "") for e in styles.iter() if _name(e.tag) == "numFmt"}
            for group in styles:
                if _name(group.tag) == "cellXfs":
                    self.dates = [self._is_date(e.get("numFmtId", "0"), own) for e in group]
        self.has_strings = "xl/sharedStrings.xml" in names
        self._strings: list[str] | None = None

    @staticmethod
    def _is_date(number: str, own: dict[str, str]) -> bool:
        if number in own:  # letters of dates outside quotes, brackets and escapes
            return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[number]), re.I))
        return int(number) in DATES

    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if self.has_strings:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    self._strings = [_text(e) for e in _rows_of(f, "si")]
        return self._strings

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((_text(e) for e in cell if _name(e.tag) == "is"), None)
        raw = next((e.text for e in cell if _name(e.tag) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings()[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind != "n":
            return raw
        style = int(cell.get("s", "0"))
        if style < len(self.dates) and self.dates[style]:
            # A day's part to the millisecond: the file has it as a binary fraction.
            return str(self.start + timedelta(milliseconds=round(float(raw) * 86_400_000)))
        return raw[:-2] if re.fullmatch(r"-?\d+\.0", raw) else raw

    def rows(self, sheet: str) -> Iterator[dict[int, str]]:
        """Values of each row by place; places without a value are left out."""
        with self.zip.open(self.sheets[sheet]) as f:
            for row in _rows_of(f, "row"):
                out, at = {}, -1
                for cell in row:
                    if _name(cell.tag) == "c":
                        at = _column(cell.get("r")) if cell.get("r") else at + 1
                        if (value := self._value(cell)) is not None:
                            out[at] = value
                yield out

    def header(self, sheet: str) -> dict[int, str]:
        return next(self.rows(sheet), {})


class SheetPart(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], sheets: list[str] | None):
        self.names, self.paths, self.sheets = schema.fieldNames(), paths, sheets

    def partitions(self) -> list[SheetPart]:
        return [SheetPart(p, s) for p in self.paths for s in Book(p).sheets if self.sheets is None or s in self.sheets]

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        rows = Book(partition.path).rows(partition.sheet)
        place = {name: at for at, name in next(rows, {}).items()}
        where = [place.get(n) for n in self.names]
        for row in rows:
            if row:  # rows without any value are no lines
                yield tuple(partition.sheet if n == SHEET else None if at is None else row.get(at) for n, at in zip(self.names, where))


class Workbook(DataSource):
    """Options: ``path`` (a file, or a pattern of files) and ``sheets`` (names joined by ``|``; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        path = _local(self.options["path"])
        found = sorted(glob(path))
        if not found:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
        return found

    def _sheets(self) -> list[str] | None:
        return self.options["sheets"].split("|") if self.options.get("sheets") else None

    def schema(self) -> StructType:
        """The columns of all sheets, in the order in which they are first met, and SourceSheet."""
        names: dict[str, None] = {}
        for path in self._paths():
            book = Book(path)
            for sheet in book.sheets:
                if self._sheets() is None or sheet in self._sheets():
                    names |= dict.fromkeys(book.header(sheet).values())
        names.pop(SHEET, None)
        return StructType([StructField(n, StringType()) for n in [*names, SHEET]])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self._paths(), self._sheets())


def read_workbook(spark: SparkSession, path: str, *sheets: str) -> DataFrame:
    """All sheets of a workbook, or the named ones, as strings."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheets", "|".join(sheets)) if sheets else reader).load(path)
