"""Workbooks (.xlsx) as cells relations: a Python data source over the zipped XML, one partition per sheet."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "book string, sheet string, r int, c int, kind string, v string"
DATES = {*range(14, 23), *range(45, 48)}
_registry: dict[str, re.Pattern] = {"xlsx_cells": re.compile(r"\.xls[xm]$", re.IGNORECASE)}


def choose_format(path: str) -> str:
    """The data source for a path, by its ending."""
    for name, pattern in _registry.items():
        if pattern.search(path):
            return name
    raise ValueError(f"no source for {path}")


def sheet_files(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + links[s.get(LINK)].lstrip("/").removeprefix("xl/")) for s in root.iter(f"{MAIN}sheet")]


def position(name: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", name).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(digits) - 1, col - 1


def number(text: str, is_date: bool, epoch_1904: bool) -> tuple[str, str]:
    """Whole numbers are long, others double; dates count days from the book's epoch, times of day lie on day 0."""
    x = float(text)
    if is_date:
        day = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30 if x >= 61 else 31)
        at = day + timedelta(days=x)
        return ("time", at.time().isoformat()) if x < 1 else ("timestamp", at.isoformat(" "))
    return ("long", str(int(x))) if x.is_integer() else ("double", repr(x))


def read_sheet(path: str, name: str) -> Iterator[tuple]:
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)}
            xfs = styles.find(f"{MAIN}cellXfs")
            dated = [int(x.get("numFmtId", 0)) in DATES | own for x in xfs] if xfs is not None else []
        old = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        epoch_1904 = old is not None and old.get("date1904") in ("1", "true")
        with book.open(dict(sheet_files(book))[name]) as stream:
            for _, cell in ElementTree.iterparse(stream):
                if cell.tag != f"{MAIN}c":
                    continue
                t, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
                r, c = position(cell.get("r"))
                if t == "inlineStr":
                    yield path, name, r, c, "string", "".join(x.text or "" for x in cell.iter(f"{MAIN}t"))
                elif v is not None and v.text is not None:
                    if t == "s":
                        yield path, name, r, c, "string", shared[int(v.text)]
                    elif t == "b":
                        yield path, name, r, c, "boolean", "true" if v.text == "1" else "false"
                    elif t == "e":
                        yield path, name, r, c, "double", "NaN"
                    elif t == "str":
                        yield path, name, r, c, "string", v.text
                    else:
                        style = int(cell.get("s", 0))
                        yield path, name, r, c, *number(v.text, style < len(dated) and dated[style], epoch_1904)
                cell.clear()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"].removeprefix("file://"), options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as book:
            names = [n for n, _ in sheet_files(book)]
        if self.sheet is not None:
            names = [self.sheet] if self.sheet in names else [names[int(self.sheet)]]
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_sheet(self.path, partition.value)


class WorkbookSource(DataSource):
    """Options: path, and sheet by name or place; without it all sheets."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def open_book(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format(choose_format(path)).option("path", path)
    return (reader if sheet is None else reader.option("sheet", str(sheet))).load()


class Books:
    """Opened sheets by book and sheet, each cached once; a context that lets go of them at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.open = spark, {}

    def fetch(self, path: str, sheet: str | int | None = 0) -> DataFrame:
        key = (path, sheet)
        if key not in self.open:
            self.open[key] = open_book(self.spark, path, sheet).cache()
        return self.open[key]

    def close(self) -> None:
        for df in self.open.values():
            df.unpersist()
        self.open.clear()

    def __enter__(self) -> Books:
        return self

    def __exit__(self, *_) -> None:
        self.close()
