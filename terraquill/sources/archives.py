"""Ward plans in archives, what an archive holds, GeoPackages as rows, and tables of a database.

Files are opened inside tasks, one file to a task; the driver sees counts only.
"""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill.roles import DataError
from terraquill.sources.files import polygon_wkb, tables_of

#: Places of the columns in a ward plan (fixed values).
PLAN_COLUMNS = {
    "lga": 3, "ward": 5, "take_off_point": 6, "settlement_guid": 7, "settlement": 8, "habitation": 9, "accessibility": 10,
    "category": 11, "population": 12, "longitude": 13, "latitude": 14, "team": 15, "days": 16,
}
PLAN_NUMBERS = ("population", "longitude", "latitude")
SPECIAL_HEADER = ("Special Place", "Type")
#: The application id of GeoPackage files (fixed value).
GEOPACKAGE_ID = 0x47504B47


def read_database(spark: SparkSession, url: str, table: str, where: dict[str, list | str] | None = None, **options: str) -> DataFrame:
    """Rows of a database table whose columns have one of the given values; the condition is pushed to the database. No row is an error.
    ``options`` go to the JDBC reader (driver, user, partitionColumn, lowerBound, upperBound, numPartitions, ...)."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return matching(df, where or {}, table)


def matching(df: DataFrame, where: dict[str, list | str], name: str = "the table") -> DataFrame:
    """Rows whose columns have one of the given values; no row is an error that names what was asked for."""
    values = {c: v if isinstance(v, list) else [v] for c, v in where.items()}
    out = reduce(lambda d, x: d.where(F.col(x[0]).isin(x[1])), values.items(), df)
    if out.isEmpty():
        asked = "; ".join(f"{c}: {', '.join(map(str, v))}" for c, v in values.items())
        raise DataError(f"no records in {name} for {asked or 'any value'}")
    return out


def lga_of_file(path: Column) -> Column:
    """The LGA that a plan's file name ends with, after the last long dash."""
    last = F.element_at(F.split(path, "—"), -1)
    return F.replace(F.regexp_replace(F.trim(last), r"\.zip$", ""), F.lit(".csv"), F.lit(""))


def plan_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source, row, cells): the rows of all tables in files under a path, headers included (row 0), cells trimmed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                for n, (_, rows) in enumerate(tables_of(name.rsplit("/", 1)[-1], content)):
                    cells = [[c.strip() for c in r] for r in rows]
                    yield pd.DataFrame({"source": [f"{name}#{n}"] * len(cells), "row": range(len(cells)), "cells": cells})

    return files.mapInPandas(parse, "source string, row long, cells array<string>")


def ward_plans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settlements and special places of ward plans, each of them two stacked tables in one file. ``rows``: see ``plan_rows``.

    Settlements end before the first row that has nothing in its first cell and beyond its second, or else before the header of the
    special places; blank rows go. Special places have the LGA and ward of their file's first settlement, and go with a file that has none. A number
    that is none counts as 0. Files meet their marks by a join: no file is gathered.
    """
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    blank_after = lambda k: ~F.exists(F.slice("cells", k + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.coalesce(c, F.lit("")) != "")
    body = rows.where("row > 0")
    header = (cell(0) == SPECIAL_HEADER[0]) & (cell(1) == SPECIAL_HEADER[1])
    gap = (cell(0) == "") & blank_after(2)
    marks = body.where(header | gap).groupBy("source").agg(F.min(F.when(header, F.col("row"))).alias("_special"), F.min(F.when(gap, F.col("row"))).alias("_gap"))
    marked = body.join(marks, "source", "left")
    end = F.least("_special", "_gap")  # nulls don't count
    upper = marked.where((end.isNull() | (F.col("row") < end)) & ~blank_after(0))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    named = {c: number(cell(k)) if c in PLAN_NUMBERS else cell(k) for c, k in PLAN_COLUMNS.items()}
    settlements = upper.select("source", "row", *(v.alias(c) for c, v in named.items()))
    first = settlements.groupBy("source").agg(F.min_by(F.struct("lga", "ward"), "row").alias("_c"))
    lower = marked.where((F.col("row") > F.col("_special")) & (cell(0) != "")).select("source", "row", cell(0).alias("special_place"), cell(1).alias("type"))
    special = lower.join(first, "source").select("source", "row", "_c.lga", "_c.ward", "special_place", "type")
    return settlements, special


def archive_contents(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, files, records): what each nested archive, or each flat file, under a path holds. An archive that can't be read
    has no records; header and blank rows don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def count(name: str, content: bytes) -> tuple[int, int]:
        tables = [rows for _, rows in tables_of(name, content)]
        return len(tables), sum(max(sum(any(c.strip() for c in r) for r in rows) - 1, 0) for rows in tables)

    def nested(name: str, content: bytes) -> tuple[str, int, int]:
        stem = name.rsplit("/", 1)[-1]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inner = [m for m in z.namelist() if m.lower().endswith((".csv", ".xlsx"))]
                return stem[:-4], len(inner), sum(count(m, z.read(m))[1] for m in inner)
        except zipfile.BadZipFile:
            return stem[:-4], 0, 0

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[tuple[str, int, int]] = []
            for name, content in zip((p.rsplit("/", 1)[-1] for p in b["path"]), b["content"]):
                if not name.lower().endswith(".zip"):
                    found.append((name, 1, count(name, content)[1]))
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.lower().endswith(".zip"):
                            found.append(nested(m, z.read(m)))
                        elif m.lower().endswith((".csv", ".xlsx")):
                            found.append((m.rsplit("/", 1)[-1], 1, count(m, z.read(m))[1]))
            yield pd.DataFrame(found, columns=["dataset", "files", "records"])

    return files.mapInPandas(scan, "dataset string, files long, records long")


def geopackage(layer: str, columns: list[str], rows: list[tuple], rings: list[list[dict]], epsg: int = 4326) -> bytes:
    """A GeoPackage of one polygon layer, its attributes as text."""
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    db = sqlite3.connect(":memory:")
    db.execute(f"pragma application_id = {GEOPACKAGE_ID}")
    db.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text)")
    db.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{epsg}", epsg, epsg))
    db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
    db.execute("insert into gpkg_contents values (?, 'features', ?, ?)", (layer, layer, epsg))
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, epsg))
    db.execute(f"create table {quoted(layer)} (fid integer primary key, geom blob{''.join(f', {quoted(c)} text' for c in columns)})")
    blobs = (None if r is None else b"GP\x00\x01" + struct.pack("<i", epsg) + polygon_wkb(r) for r in rings)
    db.executemany(f"insert into {quoted(layer)} values ({', '.join('?' * (len(columns) + 2))})", ((k, g, *v) for k, (g, v) in enumerate(zip(blobs, rows), 1)))
    db.commit()
    return db.serialize()


def geopackages(df: DataFrame, by: str, ring: str, layer: str, rows: int = 100_000, epsg: int = 4326) -> DataFrame:
    """(name, part, content): files for each value of a column, of about ``rows`` rows each, so that no task holds a larger one."""
    columns = [c for c in df.columns if c != ring]
    sizes = df.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    slot = F.pmod(F.xxhash64(*columns), F.col("_parts"))
    text = df.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).select(
        F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("_name"), slot.alias("_part"), F.col(ring).alias("_ring"), *(F.col(c).cast("string").alias(f"a_{c}") for c in columns)
    )

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        values = g[[f"a_{c}" for c in columns]].astype(object)
        values = list(values.where(values.notna(), None).itertuples(index=False, name=None))
        content = geopackage(layer, columns, values, list(g["_ring"]), epsg)
        return pd.DataFrame({"name": [key[0]], "part": [key[1]], "content": [content]})

    return text.groupBy("_name", "_part").applyInPandas(build, "name string, part long, content binary")
