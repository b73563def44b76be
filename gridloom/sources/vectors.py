"""Polygon sources: tables of rectangles, GeoJSON, GeoPackage and ESRI shapefiles.

Files are parsed by tasks, never by the driver: GeoPackage tables by ranges of row numbers, shapefiles by ranges of records,
GeoJSON with one feature in a line by parts of the file and any other GeoJSON as a whole.  The driver learns
the names and types of the attributes only.
"""

from __future__ import annotations

import errno
import json
import os
import re
import sqlite3
import struct
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.operators.rasterize import Shapes, footprint
from gridloom.plans.geometry import Area, MapProjection
from gridloom.plans.layer import Data, Layer, session

Rings = list[list[tuple[float, float]]]
SCHEMA = "array<array<struct<x:double,y:double>>>"


def burn_type(value: object) -> DataType:
    """The smallest type for a fixed value: Byte if it fits, else whole types by sign and size, Float64 for fractions."""
    if isinstance(value, (bool, np.bool_)):
        return DataType.Byte
    if isinstance(value, (int, np.integer)):
        names = ("UInt8", "UInt16", "UInt32", "UInt64") if value >= 0 else ("Int8", "Int16", "Int32", "Int64")
        for n in names:
            low, high = DataType[n].limits
            if low <= value <= high:
                return DataType[n]
        raise ValueError(f"{value} fits no pixel type")
    if isinstance(value, (float, np.floating)):
        return DataType.Float64
    raise ValueError(f"{value!r} can't be burnt")


# ----------------------------------------------------------------------------------------------------- file formats
def _flat(geometry: dict | None) -> Rings:
    if not geometry:
        return []
    kind, c = geometry["type"], geometry.get("coordinates")
    if kind == "Polygon":
        return [[tuple(p[:2]) for p in ring] for ring in c]
    if kind == "MultiPolygon":
        return [[tuple(p[:2]) for p in ring] for polygon in c for ring in polygon]
    if kind == "GeometryCollection":
        return [r for g in geometry["geometries"] for r in _flat(g)]
    return []


def _wkb(data: bytes, at: int = 0) -> tuple[Rings, int]:
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 10000 // 1000 if kind < 10000 else 0]
    base, rings = (kind & 0xFFFF) % 1000, []
    n = struct.unpack_from(order + "I", data, at)[0] if base >= 2 else 0
    at += 4 if base >= 2 else 8 * dims
    for _ in range(n):
        if base == 3:
            m = struct.unpack_from(order + "I", data, at)[0]
            values = struct.unpack_from(f"{order}{m * dims}d", data, at + 4)
            rings.append([(values[i * dims], values[i * dims + 1]) for i in range(m)])
            at += 4 + 8 * m * dims
        elif base in (4, 5, 6, 7):
            more, at = _wkb(data, at)
            rings += more
        else:
            at += 8 * dims
    return rings, at


Feature = tuple[int, dict, Rings]  # number, attributes, rings
#: Features, or bytes of a file, that one task parses at least.
PART_ROWS, PART_BYTES = 10_000, 32 << 20


def _parts(size: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the parts that a size is cut into."""
    n = max(1, min(-(-size // least), session().sparkContext.defaultParallelism * 4))
    cuts = [size * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _geojson_head(path: str) -> tuple[list[tuple[int, int]], str]:
    with open(path, encoding="utf-8", errors="replace") as f:
        head = f.read(4096)
    found = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]+)"', head, re.S)
    name = found.group(1) if found else "EPSG:4326"
    name = "EPSG:4326" if "CRS84" in name else name.replace("urn:ogc:def:crs:", "").replace("::", ":")
    lines = [x.strip().rstrip(",") for x in head.split("\n")]
    whole = [x for x in lines[:-1] if x.startswith("{") and x.endswith("}") and '"Feature"' in x]
    size = os.path.getsize(path)
    return (_parts(size, PART_BYTES) if whole else [(0, -1)]), name


def _geojson(path: str, first: int, end: int) -> Iterator[Feature]:
    """The features that start between two places of a file with a feature in each line, numbered by their places; all for end -1."""
    if end < 0:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        for i, x in enumerate(d["features"] if d.get("type") == "FeatureCollection" else [d]):
            yield i, x.get("properties") or {}, _flat(x.get("geometry"))
        return
    with open(path, "rb") as f:
        f.seek(max(first - 1, 0))
        if first:
            f.readline()
        while (at := f.tell()) < end and (line := f.readline()):
            text = line.strip().rstrip(b",")
            if text.startswith(b"{") and text.endswith(b"}"):
                x = json.loads(text)
                if x.get("type") == "Feature":
                    yield at, x.get("properties") or {}, _flat(x.get("geometry"))


def _geopackage_head(path: str) -> tuple[list[tuple[int, int]], str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        table, _, srs = con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchone()
        org, code = con.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone() or ("EPSG", srs)
        low, top = con.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    low, top = low or 0, top or 0
    return [(low + a, low + b) for a, b in _parts(top - low + 1, PART_ROWS)], f"{org.upper()}:{code}" if code > 0 else "EPSG:4326"


def _geopackage(path: str, first: int, end: int) -> Iterator[Feature]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        table, column = con.execute("select table_name, column_name from gpkg_geometry_columns").fetchone()
        cursor = con.execute(f'select rowid, * from "{table}" where rowid >= ? and rowid < ? order by rowid', (first, end))
        names = [c[0] for c in cursor.description][1:]
        for row in cursor:
            d = dict(zip(names, row[1:], strict=True))
            blob = d.pop(column)
            size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
            yield row[0], d, _wkb(blob, 8 + size)[0] if blob and not blob[3] >> 4 & 1 else []


def _shapefile_head(path: str) -> tuple[list[tuple[int, int]], str]:
    base = Path(path).with_suffix("")
    prj, index = base.with_suffix(".prj"), base.with_suffix(".shx")
    parts = _parts((index.stat().st_size - 100) // 8, PART_ROWS) if index.exists() else [(0, -1)]
    return parts, prj.read_text() if prj.exists() else "EPSG:4326"


def _shapefile(path: str, first: int, end: int) -> Iterator[Feature]:
    """Records ``first`` to ``end`` by the index; all in the order of the file where there is none (end -1)."""
    base = Path(path).with_suffix("")
    with open(path, "rb") as f:
        if end < 0:
            starts, at = [], 100
            while at < os.path.getsize(path):
                starts.append(at)
                f.seek(at + 4)
                at += 8 + 2 * struct.unpack(">i", f.read(4))[0]
        else:
            with open(base.with_suffix(".shx"), "rb") as index:
                index.seek(100 + 8 * first)
                starts = [2 * struct.unpack_from(">i", index.read(8))[0] for _ in range(first, end)]
        fields, head, width, count = _dbf_head(base.with_suffix(".dbf"))
        table = open(base.with_suffix(".dbf"), "rb") if fields else None
        try:
            for k, at in enumerate(starts, first):
                f.seek(at + 4)
                data = f.read(2 * struct.unpack(">i", f.read(4))[0])
                rings: Rings = []
                if struct.unpack_from("<i", data)[0] in (5, 15, 25):
                    parts, points = struct.unpack_from("<2i", data, 36)
                    cuts = [*struct.unpack_from(f"<{parts}i", data, 44), points]
                    xy = np.frombuffer(data, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
                    rings = [[tuple(p) for p in xy[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
                row: dict = {}
                if table and k < count:
                    table.seek(head + k * width + 1)
                    record, pos = table.read(width - 1), 0
                    for name, kind, size, decimals in fields:
                        text = record[pos : pos + size].decode("utf-8", "replace").strip()
                        pos += size
                        row[name] = (None if not text.strip("*") else float(text) if kind == "F" or decimals else int(text)) if kind in "NF" else text
                yield k, row, rings
        finally:
            if table:
                table.close()


def _dbf_head(path: Path) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """Fields (name, kind, size, decimals), place of the first record, its width, number of records."""
    if not path.exists():
        return [], 0, 0, 0
    with open(path, "rb") as f:
        count, head, width = struct.unpack_from("<IHH", f.read(32), 4)
        d = f.read(head - 32)
    return [(d[i : i + 11].split(b"\0")[0].decode(), chr(d[i + 11]), d[i + 16], d[i + 17]) for i in range(0, len(d) - 31, 32) if d[i] != 0x0D], head, width, count


_FORMATS = {".gpkg": (_geopackage_head, _geopackage), ".shp": (_shapefile_head, _shapefile)}
_PARSED = "priority bigint, kinds map<string,string>, attributes map<string,string>, rings " + SCHEMA


def _kind_of(value: object) -> str:
    return "i" if isinstance(value, int) and not isinstance(value, bool) else "f" if isinstance(value, float) else "s"


def _features(filename) -> tuple[DataFrame, str, dict[str, DataType]]:
    """(priority, attributes ..., rings), name of the coordinate system, types of the numeric attributes."""
    path = str(filename)
    if not os.path.exists(path):
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path)
    head, read = _FORMATS.get(Path(path).suffix.lower(), (_geojson_head, _geojson))
    parts, crs_name = head(path)
    spark = session()
    ranges = spark.createDataFrame(parts, "first bigint, stop bigint").repartition(len(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in zip(batch.column("first").to_pylist(), batch.column("stop").to_pylist(), strict=True):
                every = read(path, first, stop)
                while some := list(islice(every, 1000)):
                    known = [{k: v for k, v in attributes.items() if v is not None} for _, attributes, _ in some]
                    text = lambda v: v if isinstance(v, str) else json.dumps(v)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n for n, _, _ in some], pa.int64()),
                            pa.array([[(k, _kind_of(v)) for k, v in a.items()] for a in known], pa.map_(pa.string(), pa.string())),
                            pa.array([[(k, text(v)) for k, v in a.items()] for a in known], pa.map_(pa.string(), pa.string())),
                            pa.array([[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for *_, rings in some], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))),
                        ],
                        ["priority", "kinds", "attributes", "rings"],
                    )

    parsed = ranges.mapInArrow(run, _PARSED)
    each = parsed.select("priority", F.explode("kinds").alias("name", "kind"))
    found = each.groupBy("name").agg(F.collect_set("kind").alias("kinds"), F.min("priority").alias("first")).orderBy("first", "name").collect()
    types = {r["name"]: "bigint" if set(r["kinds"]) == {"i"} else "string" if "s" in r["kinds"] else "double" for r in found}
    kinds = {n: DataType.Int64 if t == "bigint" else DataType.Float64 for n, t in types.items() if t != "string"}
    values = [F.col("attributes")[n].cast(t).alias(n) for n, t in types.items()]
    return parsed.select("priority", *values, "rings"), crs_name, kinds


# ---------------------------------------------------------------------------------------------------------- layers
class DeferredShapes(Data):
    """Features that have no lattice yet: only their envelope is known until they are put on one."""

    def __init__(self, features: DataFrame, area: Area, datatype: DataType, name: str):
        super().__init__(area, datatype, None, name)
        self.features = features

    def as_projection(self, projection: MapProjection, method=None) -> Shapes:
        a = self._own
        return Shapes(self.features, footprint(a.left, a.top, a.right, a.bottom, projection), self.datatype, self.name)


def _burnt(features: DataFrame, kinds: dict[str, DataType], burn_value) -> tuple[DataFrame, DataType]:
    if isinstance(burn_value, str):
        if burn_value not in features.columns:
            raise KeyError(burn_value)
        if burn_value not in kinds:
            raise ValueError(f"{burn_value} is not a numeric attribute")
        return features.withColumn("burn", F.col(f"`{burn_value}`")), kinds[burn_value]
    return features.withColumn("burn", F.lit(burn_value)), burn_type(burn_value)


def _envelope(features: DataFrame) -> tuple[float, float, float, float]:
    p = features.select(F.explode("rings").alias("r")).select(F.explode("r").alias("p"))
    r = p.agg(F.min("p.x"), F.max("p.y"), F.max("p.x"), F.min("p.y")).first()
    if r[0] is None:
        raise ValueError("no feature has a geometry")
    return tuple(r)


def read_shape(filename, projection: MapProjection | tuple | None = None, where_filter: str | None = None, datatype: DataType | None = None, burn_value: int | float | str = 1) -> Data:
    """Polygons as a layer.  where_filter: an SQL condition on the attributes; burn_value: a number or an attribute."""
    features, own, kinds = _features(filename)
    if where_filter:
        features = features.filter(where_filter)
    features, kind = _burnt(features, kinds, burn_value)
    box = _envelope(features)
    if projection is None:
        left, top, right, bottom = np.floor(box[0]), np.ceil(box[1]), np.ceil(box[2]), np.floor(box[3])
        return DeferredShapes(features, Area(float(left), float(top), float(right), float(bottom)), datatype or kind, str(filename))
    if not isinstance(projection, MapProjection):
        projection = MapProjection(projection[0] or own, *projection[1])
    return Shapes(features, footprint(*box, projection), datatype or kind, str(filename))


def read_shape_like(filename, like: Layer, where_filter: str | None = None, datatype: DataType | None = None, burn_value: int | float | str = 1) -> Shapes:
    """Polygons on the lattice of another layer, of its type unless another is named."""
    if like.projection is None:
        raise ValueError("the layer to be like has no projection")
    features, _, kinds = _features(filename)
    if where_filter:
        features = features.filter(where_filter)
    features, _ = _burnt(features, kinds, burn_value)
    area = like.area
    return Shapes(features, footprint(*_envelope(features), like.projection, (area.left, area.top)), datatype or like.datatype, str(filename))


def rectangles(table: DataFrame, projection: MapProjection, burn: str | int | float = 1, priority: str = "priority", where_filter: str | None = None, area: Area | None = None, datatype: DataType | None = None) -> Shapes:
    """A layer of a table of rectangles (left, top, right, bottom in map units); the largest priority wins a pixel."""
    if where_filter:
        table = table.filter(where_filter)
    value = F.col(burn) if isinstance(burn, str) else F.lit(burn)
    features = table.select(F.col(priority).alias("priority"), value.alias("burn"), "left", "top", "right", "bottom")
    kind = datatype or (DataType.Int64 if isinstance(burn, str) else burn_type(burn))
    if area is None:
        north = F.max if projection.ystep < 0 else F.min
        south = F.min if projection.ystep < 0 else F.max
        r = features.agg(F.min("left"), north("top"), F.max("right"), south("bottom")).first()
        area = footprint(*r, projection)
    return Shapes(features, area, kind)
