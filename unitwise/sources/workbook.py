"""Workbook files to the long cell table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise import schema
from unitwise.session import ship_package

# Built-in number formats that show a day.
_BUILTIN_DATES = {14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}
_UNREADABLE = "unreadable"
_FILE_CELLS = "path string, sheet string, row long, col int, ctype string, text string, num double, num_fmt string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name):
    return [c for c in node if _local(c.tag) == name]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _number_text(v: float) -> str:
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def _cells_of(path: str, content: bytes) -> Iterator[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    xml = lambda n: ElementTree.fromstring(book.read(n))
    shared = ([_text(si) for si in xml("xl/sharedStrings.xml")]
              if "xl/sharedStrings.xml" in names else [])
    formats: list[str | None] = []
    if "xl/styles.xml" in names:
        style = xml("xl/styles.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode")
                  for part in _children(style, "numFmts") for f in part}
        for part in _children(style, "cellXfs"):
            ids = [int(x.get("numFmtId", "0")) for x in part]
            formats = [custom.get(i, _BUILTIN_DATES.get(i)) for i in ids]
    rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    sheets = next(iter(_children(xml("xl/workbook.xml"), "sheets")), [])
    for s in sheets:
        rid = next(v for k, v in s.attrib.items() if _local(k) == "id")
        target = rels[rid].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        with book.open(target) as stream:
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) == "c":
                    cell = _one_cell(node, shared, formats)
                    if cell is not None:
                        yield (path, s.get("name"), *cell)
                elif _local(node.tag) == "row":
                    node.clear()


def _one_cell(node, shared, formats):
    m = re.match(r"([A-Z]+)(\d+)", node.get("r", ""))
    if not m:
        return None
    col = 0
    for ch in m.group(1):
        col = col * 26 + ord(ch) - 64
    row, col = int(m.group(2)) - 1, col - 1
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return row, col, "s", _text(node), None, None
    value = next((v.text for v in _children(node, "v")), None)
    if value is None:
        return None
    if kind == "s":
        return row, col, "s", shared[int(value)], None, None
    if kind == "n":
        num = float(value)
        style = int(node.get("s", "0"))
        fmt = formats[style] if style < len(formats) else None
        return row, col, "n", _number_text(num), num, fmt
    if kind == "b":
        return row, col, "b", "true" if value == "1" else "false", None, None
    return row, col, "s", value, None, None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [p.split()[0] for p in _FILE_CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            try:
                for cell in _cells_of(path, bytes(content)):
                    rows.append(cell)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names).astype({"num": "float64"})
                        rows = []
            except Exception as e:  # any damage of a file is reported as a row, the others are read
                rows.append((path, None, None, None, _UNREADABLE, f"{type(e).__name__}: {e}", None, None))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"num": "float64"})


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xXmM]")
        .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInPandas(_read, _FILE_CELLS)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all workbooks under a path; a file is the unit of work.

    Files are read by Spark as binary rows, one decoded at a time and emitted in
    pieces, so memory follows the largest single file. A damaged file gives the cells
    before the damage and is listed by :func:`unreadable_files`.
    """
    return _decoded(spark, path).filter(F.col("ctype") != _UNREADABLE).withColumn("doc_id", F.xxhash64("path"))


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, message) of the workbooks that cannot be read to their end."""
    return _decoded(spark, path).filter(F.col("ctype") == _UNREADABLE).select("path", F.col("text").alias("message"))


def read_flat_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cells flattened beforehand, from parquet, csv or json."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(schema.CELLS)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)
