"""Spreadsheets (.xlsx) as a data source: sheets are read from the archive's XML, a partition each."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the file format that show dates or times; fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Kinds of cells from the narrowest to the widest that holds it.
KINDS = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "string": T.StringType()}
Cell = bool | int | float | datetime | str | None


def _column(name: str) -> int:
    """The place of a cell from its name, A1 being in column 0."""
    n = 0
    for c in name:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Book:
    """An open archive: its sheets, shared texts and date formats. Rows are streamed."""

    def __init__(self, path: str) -> None:
        from pyarrow.fs import FileSystem

        store, name = FileSystem.from_uri(path if "://" in path else "file://" + path)
        self.file = store.open_input_file(name)
        self.zip = zipfile.ZipFile(self.file)
        self._texts: list[str] | None = None

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _xml(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else None

    def sheets(self) -> dict[str, str]:
        """The sheets' names in order, and where they stand in the archive."""
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        found = self._xml("xl/workbook.xml").iter(f"{MAIN}sheet")
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        return {s.get("name"): place(targets[s.get(RELATION)]) for s in found}

    def texts(self) -> list[str]:
        """Shared texts; runs of one text are put together, phonetic hints left out."""
        if self._texts is None:
            root = self._xml("xl/sharedStrings.xml")
            own = lambda si: "".join(t.text or "" for part in si if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))
            self._texts = [] if root is None else [own(si) for si in root.iter(f"{MAIN}si")]
        return self._texts

    def dated(self) -> list[bool]:
        """Whether a cell style shows a date."""
        root = self._xml("xl/styles.xml")
        if root is None:
            return []
        shown = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode")) for f in root.iter(f"{MAIN}numFmt")}
        own = {k for k, code in shown.items() if re.search(r"[ymdhs]", code, re.I) and "General" not in code}
        styles = root.find(f"{MAIN}cellXfs")
        return [] if styles is None else [int(x.get("numFmtId", 0)) in own | (DATE_FORMATS - shown.keys()) for x in styles]

    def rows(self, place: str) -> Iterator[list[Cell]]:
        """The cells of each row, empty ones null; rows that the file leaves out are left out."""
        book = self._xml("xl/workbook.xml").find(f"{MAIN}workbookPr")
        first = datetime(1904, 1, 1) if book is not None and book.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        dated, texts = self.dated(), self.texts()
        with self.zip.open(place) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[Cell] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(out)
                    out.extend([None] * (at + 1 - len(out)))
                    out[at] = self._cell(c, texts, dated, first)
                row.clear()
                yield out

    @staticmethod
    def _cell(c: ElementTree.Element, texts: list[str], dated: list[bool], first: datetime) -> Cell:
        kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or None
        if value is None or value == "" or kind == "e":
            return None
        if kind == "s":
            return texts[int(value)] or None
        if kind == "b":
            return value == "1"
        if kind == "d":
            return datetime.fromisoformat(value)
        if kind != "n":
            return value
        number, style = float(value), int(c.get("s", 0))
        if style < len(dated) and dated[style]:
            return first + timedelta(milliseconds=round(number * 86_400_000))
        return int(number) if number.is_integer() and abs(number) < 2**53 else number


def _kind(x: Cell) -> str:
    if isinstance(x, datetime):
        return "date" if x == datetime(x.year, x.month, x.day) else "timestamp"
    return {bool: "boolean", int: "long", float: "double"}.get(type(x), "string")


def _wider(a: str | None, b: str) -> str:
    """The kind that holds both: numbers with numbers, dates with times, else texts."""
    if a is None or a == b:
        return b
    pair = {a, b}
    return "double" if pair == {"long", "double"} else "timestamp" if pair == {"date", "timestamp"} else "string"


def _told(x: Cell, kind: str):
    if x is None:
        return None
    if kind == "double":
        return float(x)
    if kind == "date":
        return x.date()
    return str(x) if kind == "string" and not isinstance(x, str) else x


def _names(header: list[Cell], width: int) -> list[str]:
    """Column names: a column without one is named by its place, a repeated name gets its number."""
    out: list[str] = []
    for i in range(width):
        base = str(header[i]).strip() if i < len(header) and header[i] is not None else ""
        base, name, n = base or f"column_{i + 1}", base or f"column_{i + 1}", 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


class Sheet(InputPartition):
    def __init__(self, place: str) -> None:
        self.place = place


class Sheets(DataSource):
    """Options: path; sheet (a name; by default the first, "*" for all that share the first one's header)."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def _places(self, book: Book) -> list[str]:
        sheets, want = book.sheets(), self.options.get("sheet")
        if want == "*":
            return list(sheets.values())
        if want is not None and want not in sheets:
            raise ValueError(f"no sheet {want!r}; there are {', '.join(sheets)}")
        return [sheets[want]] if want is not None else list(sheets.values())[:1]

    def schema(self) -> T.StructType:
        """Names from the first row, types from all others; the format bounds a sheet to 1,048,576 rows, which are streamed."""
        with Book(self.options["path"]) as book:
            header, kinds = None, []
            for place in self._places(book):
                rows = book.rows(place)
                head = next(rows, [])
                if header is not None and head != header:
                    raise ValueError("the sheets have other headers")
                header = head
                kinds.extend([None] * (len(head) - len(kinds)))
                for row in rows:
                    kinds.extend([None] * (len(row) - len(kinds)))
                    for i, x in enumerate(row):
                        if x is not None:
                            kinds[i] = _wider(kinds[i], _kind(x))
        return T.StructType([T.StructField(n, KINDS[k or "string"]) for n, k in zip(_names(header or [], len(kinds)), kinds, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        with Book(self.options["path"]) as book:
            places = self._places(book)
        names = {t: k for k, t in KINDS.items()}
        return _Reader(self.options["path"], places, [names[f.dataType] for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, path: str, places: list[str], kinds: list[str]) -> None:
        self.path, self.places, self.kinds = path, places, kinds

    def partitions(self) -> list[InputPartition]:
        return [Sheet(p) for p in self.places]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with Book(self.path) as book:
            rows = book.rows(partition.place)
            next(rows, None)
            for row in rows:
                row.extend([None] * (len(self.kinds) - len(row)))
                if any(x is not None for x in row):
                    yield tuple(map(_told, row, self.kinds))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet as a table: the first row names the columns; rows without a value are left out.

    Formulas give their stored values, errors and empty texts are null. Whole numbers are longs, a column
    of numbers and fractions doubles, of dates and times timestamps, any other mixture texts.
    """
    spark.dataSource.register(Sheets)
    reader = spark.read.format("spreadsheet").option("path", path)
    return (reader if sheet is None else reader.option("sheet", sheet)).load()
