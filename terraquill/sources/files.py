"""Readers and writers of the file formats that campaign data comes in.

Delimited files are Spark's own scans. Archives, workbooks and GeoPackages are opened inside tasks, one file to a task, from ``binaryFile``
rows: the driver never opens a path, so inputs may live in any store that Spark reads.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "source string, row long, cells map<string,string>"
RINGS = "array<array<struct<x:double,y:double>>>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class NotSupported(ValueError):
    """A format that no reader takes."""


def read_csv(spark: SparkSession, path: str, tolerant: bool = False, strings: bool = False) -> DataFrame:
    """A delimited file with a header; ``tolerant`` drops malformed lines, ``strings`` infers no types."""
    mode = "DROPMALFORMED" if tolerant else "PERMISSIVE"
    return spark.read.csv(path, header=True, inferSchema=not strings, mode=mode)


def read_tables(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All tables of workbooks, archives and delimited files under a path (a glob may be), as strings: the union of their
    columns and ``source``, the file or sheet. ``columns`` saves the pass that finds the headers."""
    rows = table_rows(spark, path)
    names = columns or sorted(r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect())
    return rows.select("source", "row", *(F.col("cells")[n].alias(n) for n in names))


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_parse_files, CELLS)


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            name = path.rsplit("/", 1)[-1]
            for source, rows in tables_of(name, content):
                header, *body = rows or [[]]
                names = [h.strip() for h in header]
                cells = [{n: v for n, v in zip(names, r) if n and v is not None and v != ""} for r in body]
                kept = [(k, c) for k, c in enumerate(cells, 1) if c]
                yield pd.DataFrame({"source": source, "row": [k for k, _ in kept], "cells": [c for _, c in kept]})


def tables_of(name: str, content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(source, rows) for each table in a file; archives are entered."""
    kind = name.rsplit(".", 1)[-1].lower()
    stem = re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1])
    if kind == "csv":
        yield stem, list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))
    elif kind == "xlsx":
        for sheet, rows in workbook_sheets(content):
            yield f"{stem}/{sheet}", rows
    elif kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in sorted(z.namelist()):
                if member.lower().endswith((".csv", ".xlsx", ".zip")) and not member.startswith("__MACOSX"):
                    yield from tables_of(member, z.read(member))


def workbook_sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Sheets of an OOXML workbook as rows of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            data = z.read(target if target.startswith("xl/") else f"xl/{target}")
            rows = []
            for row in ElementTree.fromstring(data).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    column = _column_number(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [""] * (column - len(cells))
                    cells.append(_cell_text(c, shared))
                rows.append(cells)
            yield sheet.get("name"), rows


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _cell_text(c: ElementTree.Element, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    v = c.find(f"{_MAIN}v")
    if v is None or v.text is None:
        return ""
    return shared[int(v.text)] if c.get("t") == "s" else v.text


# --- spatial -------------------------------------------------------------------------------------------------


def wkb_rings(blob: bytes) -> list[list[dict]]:
    """Rings of a WKB polygon or multipolygon (a point is one ring of one corner); a GeoPackage header is skipped."""
    if blob[:2] == b"GP":
        blob = blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]

    def read(at: int) -> tuple[list[list[dict]], int]:
        order = "<" if blob[at] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", blob, at + 1)[0]
        dims = 2 + (kind & 0x80000000 > 0) + (kind // 1000 % 10 in (1, 2, 3)) + (kind // 1000 % 10 == 3)
        at += 9 if kind & 0x20000000 else 5
        base = (kind & 0x0FFFFFFF) % 1000

        def corner(at: int) -> dict:
            x, y = struct.unpack_from(f"{order}2d", blob, at)
            return {"x": x, "y": y}

        if base == 1:
            return [[corner(at)]], at + 8 * dims
        n = struct.unpack_from(f"{order}I", blob, at)[0]
        at += 4
        rings: list[list[dict]] = []
        for _ in range(n):
            if base == 3:
                m = struct.unpack_from(f"{order}I", blob, at)[0]
                rings.append([corner(at + 4 + 8 * dims * k) for k in range(m)])
                at += 4 + 8 * dims * m
            else:
                part, at = read(at)
                rings += part
        return rings, at

    return read(0)[0]


def polygon_wkb(ring: list[dict]) -> bytes:
    flat = [v for p in ring for v in (p["x"], p["y"])]
    return struct.pack(f"<BIII{len(flat)}d", 1, 3, 1, len(ring), *flat)


def decode_wkb(blob: Column) -> Column:
    """Rings of WKB geometries."""

    def decode(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else wkb_rings(bytes(b)) for b in s])

    return F.pandas_udf(decode, RINGS)(blob)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Rows of a GeoPackage layer (the first by default): row, cells (attributes as text) and geometry (WKB with its header)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                layers = dict(db.execute("select table_name, column_name from gpkg_geometry_columns order by rowid"))
                if not layers or (layer and layer not in layers):
                    raise NotSupported(f"no layer {layer or ''} among {', '.join(layers)}")
                name = layer or next(iter(layers))
                geometry = layers[name]
                rows = db.execute('select * from "' + name.replace('"', '""') + '"')
                names = [c[0] for c in rows.description]
                k = 0
                while part := rows.fetchmany(5000):
                    yield pd.DataFrame(
                        {
                            "row": range(k + 1, k + 1 + len(part)),
                            "cells": [{n: str(v) for n, v in zip(names, r) if n != geometry and v is not None} for r in part],
                            "geometry": [r[names.index(geometry)] for r in part],
                        }
                    )
                    k += len(part)

    return files.mapInPandas(scan, "row long, cells map<string,string>, geometry binary")


def write_csv(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """A folder of delimited files without nested columns; ``partition``: one folder for each value (a list by LGA, say)."""
    flat = df.select(*(f.name for f in df.schema if f.dataType.simpleString().split("<")[0] not in ("array", "struct", "map", "binary")))
    writer = flat.write.mode("overwrite").option("header", "true")
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def output_name(base: str, suffix: str, extension: str, day: datetime.date | None = None) -> str:
    return f"{base}_{suffix}_{(day or datetime.date.today()):%Y%m%d}.{extension}"


def read_dataset(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table by its extension: csv, parquet, xlsx or zip (as text, one sheet if named), gpkg."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("xlsx", "zip"):
        df = read_tables(spark, path, columns)
        return df.where(F.col("source").endswith(f"/{sheet}")) if sheet else df
    if kind == "gpkg":
        return read_geopackage(spark, path)
    raise NotSupported(f"no reader for .{kind}")
