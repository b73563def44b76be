"""Raster sources: tables, arrays, Parquet grids, GeoTIFF files, rows, constants and generated rasters."""

from __future__ import annotations

import errno
import json
import math
import os
import uuid
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.functions.pointwise import Value
from gridloom.operators.mosaic import Mosaic, MosaicEmpty
from gridloom.plans import crs
from gridloom.plans.geometry import Area, MapProjection, Window
from gridloom.plans.layer import Constant, Formula, Layer, PixelTable, RowLayer, TableLayer, session, within
from gridloom.sources import sinks, tiff

#: A folder with a Parquet grid keeps its description in this text file; readers of Parquet skip such names.
DESCRIPTION = "_grid"


class InvalidRasterBand(Exception):
    """The file has no such band."""

    def __init__(self, band: int):
        super().__init__(f"no band {band}")
        self.band = band


# --------------------------------------------------------------------------------------------- from what Spark has
def from_table(rows: DataFrame, bands: str | Sequence[str], window: Window, projection: MapProjection, dense: bool = False, nodata: float | None = None, ignore_nodata: bool = False, offset: tuple[float, float] = (0.0, 0.0), datatypes: Sequence[DataType] | None = None, key=None) -> TableLayer | list[TableLayer]:
    """Layers of a DataFrame with y, x (lattice cells, one row each) and band columns.

    dense promises a row for every pixel of the window, so that it needs no grid beside it.
    """
    names = [bands] if isinstance(bands, str) else list(bands)
    area = Area.of_window(window, projection, offset)
    table = PixelTable(rows, dense, key)
    by_spark = {"tinyint": DataType.Int8, "smallint": DataType.Int16, "int": DataType.Int32, "bigint": DataType.Int64, "float": DataType.Float32, "double": DataType.Float64}
    kinds = datatypes or [by_spark.get(rows.schema[n].dataType.simpleString(), DataType.Float64) for n in names]
    out = [TableLayer(table, n, area, k, nodata, ignore_nodata) for n, k in zip(names, kinds, strict=True)]
    return out[0] if isinstance(bands, str) else out


def from_array(values, origin: tuple[float, float], projection: MapProjection | tuple[str, tuple[float, float]] | None, nodata: float | None = None, name: str = "") -> TableLayer:
    """A layer of a 2-D array whose top-left corner is at ``origin`` (x, y)."""
    if projection is None:
        raise ValueError("an array needs a projection")
    if not isinstance(projection, MapProjection):
        projection = MapProjection(projection[0], *projection[1])
    data = np.asarray(values)
    if data.ndim != 2:
        raise ValueError("an array must have two dimensions")
    kind = DataType.of_array(data)
    height, width = data.shape
    area = Area(origin[0], origin[1], origin[0] + width * projection.xstep, origin[1] + height * projection.ystep, projection)
    w = area.window
    y, x = np.mgrid[w.yoff : w.yend, w.xoff : w.xend]
    v = data.astype(np.float64 if kind.is_float else np.int64)
    rows = session().createDataFrame(pa.table({"y": y.ravel(), "x": x.ravel(), "v": v.ravel()}))
    return TableLayer(PixelTable(rows, True), "v", area, kind, nodata, name=name)


def constant(value: float) -> Constant:
    """A layer that is everywhere."""
    return Constant(value)


# ----------------------------------------------------------------------------------------------------- from files
class FilePixels(PixelTable):
    """The pixels of a GeoTIFF file: only the blocks that a window meets are read, only the bands that are asked for decoded."""

    def __init__(self, path: str, info: tiff.Info, y0: int, x0: int):
        self.path, self.info, self.origin = path, info, (y0, x0)
        self.dense, self.key = not info.sparse, ("tiff", path, os.stat(path).st_mtime_ns, os.path.getsize(path))

    @property
    def rows(self) -> DataFrame:
        return tiff.pixels(self.path, self.info, *self.origin)

    def kind(self, band: str) -> str:
        return "f" if self.info.datatype.is_float else "i"

    def within(self, w: Window, bands: Sequence[str]) -> DataFrame:
        return tiff.pixels(self.path, self.info, *self.origin, w, [int(b[1:]) for b in bands])


class FileLayer(TableLayer):
    """A band of a file.  It is pickled by its name, so it can go to other processes."""

    def __init__(self, table: PixelTable, band: str, area: Area, datatype: DataType, nodata: float | None, ignore_nodata: bool, name: str, source: tuple):
        super().__init__(table, band, area, datatype, nodata, ignore_nodata, name)
        self.source = source

    def __reduce__(self):
        return read_raster, self.source

    @property
    def scan_key(self) -> tuple | None:
        """Layers with equal keys can be read in one scan, if they are dense and don't meet."""
        if not self.dense:
            return None
        what = self.table.info.datatype if isinstance(self.table, FilePixels) else self.table.rows.schema.simpleString()
        return type(self.table), what, self.band, self._nodata, self.masked

    @staticmethod
    def scan(layers: Sequence[FileLayer], w: Window) -> DataFrame:
        """The pixels of layers of one scan_key, with the column of their band."""
        first = layers[0]
        if isinstance(first.table, FilePixels):
            return tiff.scan([(t.path, t.info, *t.origin) for t in (layer.table for layer in layers)], w, [int(first.band[1:])])
        return within(session().read.schema(first.table.rows.schema).parquet(*(layer.source[0] for layer in layers)), w)


def _open(filename, band: int, ignore_nodata: bool) -> FileLayer:
    path = str(filename)
    if os.path.isdir(path) or path.endswith(".parquet") or "://" in path:
        return _read_grid(path, band, ignore_nodata)
    if not os.path.exists(path):
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path)
    info = tiff.describe(path)
    if not 1 <= band <= info.bands:
        raise InvalidRasterBand(band)
    left, xstep, _, top, _, ystep = info.transform
    p = MapProjection(info.projection or "EPSG:4326", xstep, ystep)
    area = Area(left, top, left + info.width * xstep, top + info.height * ystep, p)
    w = area.window
    name = info.descriptions[band - 1] or path
    return FileLayer(FilePixels(path, info, w.yoff, w.xoff), f"b{band}", area, info.datatype, info.nodata, ignore_nodata, name, (path, band, ignore_nodata))


def _grid_description(path: str) -> dict:
    try:
        text = session().read.text(f"{path}/{DESCRIPTION}").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path) from e
        raise
    return json.loads("".join(r["value"] for r in text))


def _read_grid(path: str, band: int, ignore_nodata: bool) -> FileLayer:
    d = _grid_description(path)
    if not 1 <= band <= len(d["bands"]):
        raise InvalidRasterBand(band)
    area = Area(*d["area"], MapProjection(*d["projection"]))
    table = PixelTable(session().read.parquet(path), d["dense"], ("grid", path))
    b = d["bands"][band - 1]
    return FileLayer(table, b["name"], area, DataType(b["datatype"]), d["nodata"], ignore_nodata, b["label"] or path, (path, band, ignore_nodata))


def empty_raster(filename, area: Area, datatype: DataType, bands: int = 1, nodata: float | None = None) -> FileLayer:
    """A new GeoTIFF file without pixels, to save layers into; it reads as its nodata value, or 0.

    Without a nodata value, 0 is what isn't there.
    """
    if area.projection is None:
        raise ValueError("an empty raster needs an area with a projection")
    path = Path(filename).absolute()
    path.parent.mkdir(parents=True, exist_ok=True)
    w = area.window
    rows = max(1, min(sinks.STRIP, w.ysize, sinks.STRIP_PIXELS // w.xsize))
    tiff.write(str(path), {}, w.xsize, w.ysize, bands, rows, datatype, area.geo_transform, area.projection.name, nodata, [None] * bands)
    return read_raster(path)


def empty_raster_like(layer: Layer, filename, area: Area | None = None, datatype: DataType | None = None, bands: int = 1, nodata: float | None = None) -> FileLayer:
    """A new GeoTIFF file of a layer's area, type and nodata value, where others aren't given."""
    return empty_raster(filename, area or layer.area, datatype or layer.datatype, bands, layer.nodata if nodata is None else nodata)


def replace_band(layer: Layer, destination: Layer, band: int = 1, and_sum: bool = False, callback=None) -> float | None:
    """Write a layer as one band of a file that is there already; the file's area and type win, other bands stay.

    The file is written anew beside the old one, which it replaces at the end.
    """
    if not isinstance(destination, FileLayer):
        raise TypeError("the destination must be a layer that was read from a file")
    path = destination.source[0]
    is_file = isinstance(destination.table, FilePixels)
    count = destination.table.info.bands if is_file else len(_grid_description(path)["bands"])
    if not 1 <= band <= count:
        raise InvalidRasterBand(band)
    old = [read_raster(path, i + 1, True) for i in range(count)]
    labels = [None if x.name == path else x.name for x in old]
    new = layer.as_area(destination.area).as_type(destination.datatype)
    bands = [new if i + 1 == band else x for i, x in enumerate(old)]
    total = new.sum() if and_sum else None
    if is_file:
        sinks.to_geotiff(path, bands, labels, nodata=destination.nodata, callback=callback)
        return total
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    sinks.bands_to_parquet(bands, beside, labels, destination.nodata)
    spark = session()
    new_path, old_path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    files = old_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old_path, True)
    if not files.rename(new_path, old_path):
        raise OSError(f"{beside} can't be moved to {path}")
    return total


def read_raster(filename, band: int = 1, ignore_nodata: bool = False) -> TableLayer:
    """One band of a GeoTIFF file or of a Parquet grid.  Pixels equal to its nodata value are NaN."""
    return _open(filename, band, ignore_nodata)


def read_raster_like(filename, like: Layer, method=None, band: int = 1, ignore_nodata: bool = False) -> Layer:
    """A raster on the lattice of another layer."""
    if like.projection is None:
        raise ValueError("the layer to be like has no projection")
    return read_raster(filename, band, ignore_nodata).as_projection(like.projection, method)


def read_rasters(filenames: Sequence, tiled: bool = False) -> Mosaic:
    """Many rasters as one; where they overlap the first counts.  tiled changes nothing: the plan is the same."""
    if isinstance(filenames, (str, Path)):
        raise TypeError("read_rasters takes a list of names")
    return Mosaic([read_raster(f) for f in filenames])


def rasters_in(folder, matching: str = "*.tif", name: str = "") -> Mosaic:
    """The mosaic of the files of a folder."""
    found = sorted(Path(folder).glob(matching))
    if not found:
        raise MosaicEmpty(f"nothing in {folder} matches {matching}")
    return Mosaic([read_raster(f) for f in found], name)


# ---------------------------------------------------------------------------------------------------------- rows
def narrow(layer: TableLayer) -> RowLayer:
    """A raster one pixel wide as a layer for the full width of the globe, joined by row alone."""
    if layer.area.window.xsize != 1:
        raise ValueError("a narrow raster is one pixel wide")
    p, own = layer.projection, layer.area
    half = round(360 / abs(p.xstep)) / 2 * abs(p.xstep) if crs.lookup(p.name).unit == "degree" else None
    area = own if half is None else Area(-half, own.top, half, own.bottom, p)
    rows = layer.table.rows.select("y", layer.value.alias("v"))
    return RowLayer(rows, area, layer.datatype, None, layer.name)


def read_narrow_raster(filename, band: int = 1, ignore_nodata: bool = False) -> RowLayer:
    return narrow(read_raster(filename, band, ignore_nodata))


def is_uniform_rows(layer: Layer, tolerance: float = 0.0) -> bool:
    """Whether each row of pixels has one value."""
    spread = layer.frame().groupBy("y").agg((F.max("v") - F.min("v")).alias("d"))
    return spread.filter((F.col("d") > tolerance) | F.isnan(F.col("d").cast("double"))).isEmpty()


def narrowed(layer: Layer) -> RowLayer:
    """The first column of a raster whose rows are uniform, standing for its full width."""
    rows = layer.frame().groupBy("y").agg(F.min_by("v", "x").alias("v"))
    return RowLayer(rows, layer.area, layer.datatype)


# ----------------------------------------------------------------------------------------------------- generated
def _band_area(lat: Column) -> Column:
    """Area of the ellipsoid from the equator to a latitude in degrees."""
    e = math.sqrt(crs.E2)
    s = F.sin(F.radians(lat))
    down, up = F.lit(1.0) - e * s, F.lit(1.0) + e * s
    return math.pi * crs.B**2 * (F.ln(up / down) / (2 * e) + s / (up * down))


def area_raster(projection: MapProjection) -> Formula:
    """Square metres of each pixel: of the ellipsoid's band for longitude and latitude, else the step's product."""
    xs, ys = projection.xstep, projection.ystep
    if crs.lookup(projection.name).kind == "geographic":
        window = Window(math.floor(-180 / xs), math.floor(90 / ys), math.ceil(360 / xs), math.ceil(180 / abs(ys)))

        def pixel(y: Column, _: Column) -> Value:
            upper, lower = (y * ys).cast("double"), ((y + 1) * ys).cast("double")
            return Value(F.abs((_band_area(upper) - _band_area(lower)) * (xs / 360)), "f")

    else:
        x, y = crs.from_lonlat(projection.name, [-180, 0, 180, -180, 180, 0, 0], [0, 0, 0, 0, 0, 90, -90])
        x0, x1, y0, y1 = np.nanmin(x), np.nanmax(x), np.nanmin(y[np.isfinite(y)]), np.nanmax(y[np.isfinite(y)])
        if crs.lookup(projection.name).kind == "utm":
            x0, x1, y0, y1 = 166_000, 834_000, 0, 9_400_000
        if crs.lookup(projection.name).kind == "equal azimuth":
            x, y = crs.from_lonlat(projection.name, [-35.58, 44.83, -35.58, 44.83, 10], [24.6, 24.6, 84.73, 84.73, 84.73])
            x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        top, bottom = (y1, y0) if ys < 0 else (y0, y1)
        first, last = math.floor(x0 / xs), math.ceil(x1 / xs)
        upper, lower = math.floor(top / ys), math.ceil(bottom / ys)
        window = Window(first, upper, last - first, lower - upper)

        def pixel(y: Column, _: Column) -> Value:
            return Value(F.lit(abs(xs * ys)), "f")

    return Formula(pixel, Area.of_window(window, projection), DataType.Float32, "area", ("area", projection.name, xs, ys))


def h3_tile(cell_id: str, projection: MapProjection) -> Formula:
    """1 where a pixel's top-left corner lies in an H3 cell, else 0.  Needs the h3 package."""
    try:
        import h3
    except ModuleNotFoundError as e:
        raise NotImplementedError("h3_tile needs the h3 package, which isn't installed") from e
    import pandas as pd

    if not h3.is_valid_cell(cell_id):
        raise ValueError(f"{cell_id!r} is no H3 cell")
    corners = h3.cell_to_boundary(cell_id)
    lats, lngs = [c[0] for c in corners], [c[1] for c in corners]
    if max(lats) > 88 or min(lats) < -88:
        raise NotImplementedError("cells at the poles")
    west, east = (-180.0, 180.0) if max(lngs) - min(lngs) > 180 else (min(lngs), max(lngs))
    area = Area(west, max(lats), east, min(lats)).project_like(projection)
    if crs.lookup(projection.name).kind != "geographic":
        x, y = crs.from_lonlat(projection.name, np.array(lngs), np.array(lats))
        area = Area(float(x.min()), float(y.max()), float(x.max()), float(y.min())).project_like(projection)
    name, xs, ys, resolution = projection.name, projection.xstep, projection.ystep, h3.get_resolution(cell_id)

    @F.pandas_udf("long")
    def inside(y: pd.Series, x: pd.Series) -> pd.Series:
        lng, lat = crs.to_lonlat(name, x.to_numpy() * xs, y.to_numpy() * ys)
        return pd.Series([int(h3.latlng_to_cell(a, b, resolution) == cell_id) for a, b in zip(lat, lng, strict=True)])

    return Formula(lambda y, x: Value(inside(y, x).cast("double"), "f"), area, DataType.Float64, cell_id, ("h3", cell_id, name, xs, ys))
