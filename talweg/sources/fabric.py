"""Reach tables in dBASE and GeoPackage files as Spark data sources, and the facade that picks one by its extension."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: name in the file, name and type in Spark.
FIELDS = [("COMID", "comid", "long"), ("lengthkm", "lengthkm", "double"), ("slope", "slope", "double"), ("NextDownID", "nextdownid", "long"), ("up1", "up1", "long"), ("up2", "up2", "long"), ("up3", "up3", "long"), ("up4", "up4", "long")]
SCHEMA = ", ".join(f"{n} {t}" for _, n, t in FIELDS)


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _ranges(n: int, size: int, start: int = 0) -> list[Rows]:
    return [Rows(a, min(a + size, n + start)) for a in range(start, n + start, size)] or [Rows(start, start)]


def _value(raw, kind: str, name: str):
    """A null or empty number is null for a double and an error for an id."""
    text = raw.decode("ascii", "replace").strip("\x00 *") if isinstance(raw, bytes) else raw
    if text in (None, ""):
        if kind == "long":
            raise ValueError(f"{name} is null")
        return None
    return int(float(text)) if kind == "long" else float(text)


class DbfReader(DataSourceReader):
    """Fixed-width records, so a file splits anywhere."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        with open(path, "rb") as f:
            head = f.read(32)
            self.n, self.start, self.width = struct.unpack("<IHH", head[4:12])
            at, self.fields = 1, {}
            while (d := f.read(32))[0] != 0x0D:
                name = d[:11].split(b"\x00")[0].decode("ascii")
                self.fields[name.lower()] = (at, d[16])
                at += d[16]
        lost = [n for n, _, _ in FIELDS if n.lower() not in self.fields]
        if lost:
            raise ValueError(f"{path} lacks {lost}")

    def partitions(self) -> list[Rows]:
        return _ranges(self.n, self.size)

    def read(self, part: Rows) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(self.start + part.first * self.width)
            for _ in range(part.last - part.first):
                r = f.read(self.width)
                if r[:1] != b"*":
                    yield tuple(_value(r[a : a + w], t, n) for n, _, t in FIELDS for a, w in [self.fields[n.lower()]])


class DbfSource(DataSource):
    """spark.read.format("talweg_dbf").load(path); option ``rows`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "talweg_dbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(self.options["path"], int(self.options.get("rows", 250_000)))


def feature_layer(path: str, layer: str | None = None) -> str:
    """The one feature layer of a GeoPackage, or the one named; anything else is an error."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
    if layer is not None:
        if layer not in names:
            raise ValueError(f"{path} has no layer {layer}, only {names}")
        return layer
    if len(names) != 1:
        raise ValueError(f"{path} has the layers {names}; name one")
    return names[0]


class GpkgReader(DataSourceReader):
    """Reads the eight columns only, never the geometry, by ranges of row ids."""

    def __init__(self, path: str, layer: str | None, size: int):
        self.path, self.size = path, size
        self.layer = feature_layer(path, layer)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            self.low, self.high = c.execute(f'SELECT coalesce(min(ROWID), 0), coalesce(max(ROWID), -1) FROM "{self.layer}"').fetchone()

    def partitions(self) -> list[Rows]:
        return _ranges(self.high - self.low + 1, self.size, self.low)

    def read(self, part: Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            cols = ", ".join(f'"{n}"' for n, _, _ in FIELDS)
            for r in c.execute(f'SELECT {cols} FROM "{self.layer}" WHERE ROWID >= ? AND ROWID < ? ORDER BY ROWID', (part.first, part.last)):
                yield tuple(_value(x, t, n) for x, (n, _, t) in zip(r, FIELDS))


class GpkgSource(DataSource):
    """spark.read.format("talweg_gpkg").load(path); options ``layer`` and ``rows`` per partition."""

    @classmethod
    def name(cls) -> str:
        return "talweg_gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GpkgReader(self.options["path"], self.options.get("layer"), int(self.options.get("rows", 250_000)))


def read_fabric(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A reach table by its extension: .dbf, .shp (its .dbf), .gpkg or Parquet."""
    kind = Path(path).suffix.lower()
    if kind in (".dbf", ".shp"):
        spark.dataSource.register(DbfSource)
        return spark.read.format("talweg_dbf").load(str(Path(path).with_suffix(".dbf")))
    if kind == ".gpkg":
        spark.dataSource.register(GpkgSource)
        reader = spark.read.format("talweg_gpkg")
        return (reader.option("layer", layer) if layer else reader).load(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def _rows(df: DataFrame) -> Iterator[tuple]:
    """The eight columns row by row, a partition at a time on the driver: these files are written by one process."""
    for r in df.select(*[n for _, n, _ in FIELDS]).toLocalIterator():
        yield tuple(r)


def write_dbf(df: DataFrame, path: str, width: int = 24) -> None:
    """A reach table as a dBASE file on a local or mounted path; a null double is left blank."""
    n = df.count()
    head = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, n, 32 + 32 * len(FIELDS) + 1, 1 + width * len(FIELDS))
    with open(path, "wb") as f:
        f.write(head)
        for name, _, _ in FIELDS:
            f.write(name.encode("ascii").ljust(11, b"\x00") + b"N" + b"\x00" * 4 + bytes([width]) + b"\x00" * 15)
        f.write(b"\x0d")
        for r in _rows(df):
            f.write(b" " + b"".join(("" if x is None else repr(x)).rjust(width).encode("ascii") for x in r))
        f.write(b"\x1a")


def write_gpkg(df: DataFrame, path: str, layer: str) -> None:
    """A reach table as a layer of a GeoPackage, without geometry; other layers of the file stay."""
    types = {"long": "INTEGER", "double": "REAL"}
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT, data_type TEXT)")
        c.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (layer,))
        c.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, ' + ", ".join(f'"{n}" {types[t]}' for n, _, t in FIELDS) + ")")
        c.executemany(f'INSERT INTO "{layer}" VALUES (NULL, NULL, {", ".join("?" * len(FIELDS))})', _rows(df))
