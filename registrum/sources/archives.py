"""Archives and spreadsheets as a Spark data source: a partition for each member or sheet, opened where it is read and inflated as it is read.

spark.dataSource.register(ArchiveSource); spark.read.format("archive").option("content", "lines").load(path)

Options: path (a file, a folder, or a pattern over the files of a folder; a plain path or a URI of a store that Arrow opens), content: `lines` (of the
members of zip files: path, member, at, line), `cells` (of spreadsheet files: path, member, row, cells) or `inner` (cells of the spreadsheets inside
zip files), member (a regular expression that a member's whole name must match; all members), first (only the first such member), sheet (a number
from 0; all sheets), encoding (utf-8; bytes that are no text become U+FFFD).

A task holds one batch of rows, and of a spreadsheet its shared strings; neither an archive nor a member has to fit in memory, and archives may be
larger than a Spark value. Rows of a partition come in the order of the file. A lost task reads its member again from its start.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows, and bytes of text, that are handed on at once.
ROWS, BYTES = 10_000, 8 << 20

SCHEMAS = {"lines": "path string, member string, at long, line string", "cells": "path string, member string, row long, cells array<string>"}
SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEET = re.compile(r"xl/worksheets/sheet(\d+)\.xml")


class Member(InputPartition):
    """One member of an archive, or one sheet (by its name inside) of a spreadsheet; inner: the spreadsheet's name inside its archive."""

    def __init__(self, path: str, member: str, inner: str | None = None):
        self.path, self.member, self.inner = path, member, inner


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The files that a path names, as paths of the same form."""
    store, plain = opened(path)
    base = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    info = store.get_file_info(plain)
    if info.type == fs.FileType.File:
        return [path]
    folder, pattern = (plain, "*") if info.type == fs.FileType.Directory else posixpath.split(plain)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=False))
    return sorted(base + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def batches(rows: Iterator[tuple[int, object, int]], path: str, member: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of numbered rows (number, value, size), bounded in rows and bytes."""
    numbers, values, size = [], [], 0
    for number, value, more in rows:
        numbers.append(number)
        values.append(value)
        size += more
        if len(values) == ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array([member] * len(values)), pa.array(numbers, pa.int64()), pa.array(values, schema.field(3).type)], schema=schema)
            numbers, values, size = [], [], 0
    if values:
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array([member] * len(values)), pa.array(numbers, pa.int64()), pa.array(values, schema.field(3).type)], schema=schema)


def sheets(book: zipfile.ZipFile, number: int | None = None) -> list[str]:
    """Names of a book's sheets, by their number."""
    names = sorted((n for n in book.namelist() if SHEET.fullmatch(n)), key=lambda n: int(SHEET.fullmatch(n)[1]))
    return names if number is None else names[number : number + 1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The shared strings of a book."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out, top = [], None
    with book.open("xl/sharedStrings.xml") as content:
        for event, node in ElementTree.iterparse(content, ("start", "end")):
            top = node if top is None else top
            if event == "end" and node.tag == f"{SPACE}si":
                out.append("".join(t.text or "" for t in node.iter(f"{SPACE}t")))
                top.clear()
    return out


def cells(book: zipfile.ZipFile, name: str) -> Iterator[list[str]]:
    """Rows of a sheet as they are parsed: shared and inline strings, gaps as blanks."""
    shared, around = _texts(book), None
    with book.open(name) as content:
        for event, node in ElementTree.iterparse(content, ("start", "end")):
            if event == "start":
                around = node if node.tag == f"{SPACE}sheetData" else around
            elif node.tag == f"{SPACE}row":
                yield _row(node, shared)
                around.clear()  # rows that are read are not kept


def _row(row: ElementTree.Element, shared: list[str]) -> list[str]:
    out: list[str] = []
    for cell in row.iter(f"{SPACE}c"):
        column = 0
        for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
            column = 26 * column + ord(letter) - 64
        out += [""] * (column - 1 - len(out))
        value = cell.findtext(f"{SPACE}v") or ""
        if cell.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(f"{SPACE}t"))
        out.append(shared[int(value)] if cell.get("t") == "s" and value else value)
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.content = options.get("content", "lines")

    def partitions(self) -> list[Member]:
        o, out = self.options, []
        wanted, sheet = re.compile(o.get("member", ".*" if self.content == "lines" else r".*\.(?i:xlsx)")), int(o["sheet"]) if "sheet" in o else None
        for path in files(o["path"]):
            store, plain = opened(path)
            with store.open_input_file(plain) as file, zipfile.ZipFile(file) as z:
                if self.content == "cells":
                    out += [Member(path, name) for name in sheets(z, sheet)]
                    continue
                names = [n for n in z.namelist() if not n.endswith("/") and wanted.fullmatch(n)]
                for name in names[:1] if o.get("first", "false").lower() == "true" else names:
                    if self.content == "lines":
                        out.append(Member(path, name))
                        continue
                    with z.open(name) as book, zipfile.ZipFile(book) as inner:
                        out += [Member(path, s, name) for s in sheets(inner, sheet)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member at all
            return
        kind = pa.string() if self.content == "lines" else pa.list_(pa.string())
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("at" if self.content == "lines" else "row", pa.int64()), ("line" if self.content == "lines" else "cells", kind)])
        store, plain = opened(partition.path)
        with store.open_input_file(plain) as file, zipfile.ZipFile(file) as z:
            if self.content == "lines":
                with z.open(partition.member) as raw:
                    text = io.TextIOWrapper(raw, encoding=self.options.get("encoding", "utf-8"), errors="replace", newline="\n")
                    lines = ((k, line.rstrip("\r\n"), len(line)) for k, line in enumerate(text))
                    yield from batches(lines, partition.path, partition.member, schema)
            elif partition.inner is None:
                yield from self._cells(z, partition, schema)
            else:
                with z.open(partition.inner) as raw, zipfile.ZipFile(raw) as book:
                    yield from self._cells(book, partition, schema)

    def _cells(self, book: zipfile.ZipFile, partition: Member, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = ((k, row, sum(map(len, row))) for k, row in enumerate(cells(book, partition.member)))
        yield from batches(rows, partition.path, partition.member if partition.inner is None else f"{partition.inner}/{partition.member}", schema)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMAS["lines" if self.options.get("content", "lines") == "lines" else "cells"]

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def archive(spark: SparkSession, path: str, content: str = "lines", **options: str) -> DataFrame:
    """The source over a path."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(content=content, **options).load(path)
