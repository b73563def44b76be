"""Sinks: Parquet grids and GeoTIFF files."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.functions.pointwise import Value
from gridloom.plans.geometry import Window
from gridloom.plans.layer import MISMATCH, Layer, find_union, lower, session
from gridloom.sources import tiff

#: Most rows and most pixels of a strip of a GeoTIFF file, which one task makes at a time.
STRIP, STRIP_PIXELS = 512, 4_000_000


def _stored(value: Value, datatype: DataType, nodata: float | None) -> Column:
    """The pixel as its declared type; NaN becomes the nodata value."""
    v = value.number
    if nodata is not None and value.kind == "f":
        v = F.when(F.isnan(v), F.lit(float(nodata))).otherwise(v)
    return datatype.converted(v, value.kind == "f")


def aligned(bands: Sequence[Layer], names: Sequence[str], nodata: float | None = None) -> tuple[DataFrame, Window]:
    """(y, x, one column for each band) over the box round all bands, 0 where a band has no data."""
    if any(b.projection != bands[0].projection for b in bands):
        raise ValueError(MISMATCH)
    if any(b.datatype is not bands[0].datatype for b in bands):
        raise TypeError("all bands must have the same type")
    w = find_union(bands).window
    rows, whole = lower(_Together(bands), w)
    values = [_stored(Value(whole.column[i], whole.kind[i]), band.datatype, nodata).alias(names[i]) for i, band in enumerate(bands)]
    return rows.select("y", "x", *values), w


class _Together(Layer):
    """Several layers lowered as one, so that they share scans and joins."""

    def __init__(self, bands: Sequence[Layer]):
        self.children, self.params = tuple(bands), {}
        self.op = type("Op", (), {"kernel": staticmethod(lambda *v: Value([x.column for x in v], [x.kind for x in v])), "name": "together"})


def to_parquet(layer: Layer, path: str, nodata: float | None = None, and_sum: bool = False, sparse: bool = False) -> float | None:
    """Write a layer as a Parquet grid, sorted by row so that a window's bounds prune files and row groups."""
    return bands_to_parquet([layer], path, None, nodata, sparse, and_sum)


def bands_to_parquet(bands: Sequence[Layer], path: str, labels: Sequence[str] | None = None, nodata: float | None = None, sparse: bool = False, and_sum: bool = False) -> float | None:
    if sparse and nodata is None:
        raise ValueError("a sparse grid needs a nodata value")
    names = [f"b{i + 1}" for i in range(len(bands))]
    rows, w = aligned(bands, names, nodata)
    if sparse:
        rows = rows.filter(F.lit(False) if not names else ~F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda v: v == float(nodata)))
    rows = rows.repartitionByRange("y").sortWithinPartitions("y", "x")
    total = Observation()
    if and_sum:  # after the shuffle: its sampling reads what comes before a second time
        first = F.col(names[0]).cast("double")
        rows = rows.observe(total, F.sum(first if nodata is None else F.when(first == float(nodata), F.lit(math.nan)).otherwise(first)).alias("sum"))
    rows.write.mode("overwrite").parquet(path)
    area, p = find_union(bands), bands[0].projection
    text = json.dumps({
        "projection": [p.name, p.xstep, p.ystep], "area": [area.left, area.top, area.right, area.bottom], "nodata": nodata, "dense": not sparse,
        "bands": [{"name": n, "label": None if labels is None else labels[i], "datatype": bands[i].datatype.value} for i, n in enumerate(names)],
    })
    session().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_grid")
    return (total.get["sum"] or 0.0) if and_sum else None


def to_geotiff(filename, bands: Sequence[Layer], labels: Sequence[str] | None = None, parallelism=None, nodata: float | None = None, sparse: bool = False, and_sum: bool = False, callback: Callable[[float], None] | None = None) -> float | None:
    """Write layers as the bands of one GeoTIFF file.

    Tasks make and deflate strips of 512 rows into a folder beside the target and tell their sizes; the driver writes the
    frame of a file there, into which tasks copy the strips, each at its place; that file takes the target's place at the end.
    No pixel passes through the driver, and a task that is run again does the same again.  The folder must be one that all
    executors share.  parallelism is Spark's own affair.
    """
    if not bands:
        raise ValueError("no bands")
    if labels is not None and len(labels) != len(bands):
        raise ValueError("one label for each band")
    if sparse and nodata is None:
        raise ValueError("a sparse file needs a nodata value")
    names = [f"b{i + 1}" for i in range(len(bands))]
    rows, w = aligned(bands, names, nodata)
    datatype, kind = bands[0].datatype, bands[0].datatype.numpy
    strip = max(1, min(STRIP, w.ysize, STRIP_PIXELS // w.xsize))
    per = -(-w.ysize // strip)
    empty = None if nodata is None else float(nodata)

    target = Path(filename).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    folder = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    folder.mkdir()

    def pack(table: pa.Table) -> pa.Table:
        number = table["strip"][0].as_py()
        height = min(strip, w.ysize - number * strip)
        y, x = table["y"].to_numpy() - w.yoff - number * strip, table["x"].to_numpy() - w.xoff
        sizes, sums = [], []
        for i, n in enumerate(names):
            data = np.full((height, w.xsize), nodata if sparse else 0).astype(kind)
            column = table[n].cast(pa.int64()) if pa.types.is_decimal(table.schema.field(n).type) else table[n]
            data[y, x] = column.to_numpy().astype(kind)
            skip = sparse and bool(np.all(data == empty) if not math.isnan(empty) else np.all(np.isnan(data)))
            wide = data.astype(np.float64)
            sums.append(float(np.where(wide == empty, np.nan, wide).sum()) if empty is not None else float(wide.sum()))
            packed = b"" if skip else zlib.compress(data.tobytes(), 6)
            sizes.append(len(packed))
            if packed:
                part = folder / f"{number + per * i}.{uuid.uuid4().hex}"
                part.write_bytes(packed)
                os.replace(part, folder / str(number + per * i))
        return pa.table({"number": pa.array([number + per * i for i in range(len(names))], pa.int64()), "size": pa.array(sizes, pa.int64()), "total": pa.array(sums)})

    packed = rows.withColumn("strip", F.floor((F.col("y") - w.yoff) / strip).cast("int")).groupBy("strip").applyInArrow(pack, "number long, size long, total double")
    total, sizes = 0.0, {}
    try:
        if callback:
            callback(0.0)
        for done, r in enumerate(packed.toLocalIterator(), 1):
            total += r["total"] if r["number"] < per else 0.0
            if r["size"]:
                sizes[r["number"]] = r["size"]
            if callback:
                callback(min(done / (per * len(names) + 1), 1.0))
        area, whole = find_union(bands), folder / "whole"
        places = tiff.write(str(whole), sizes, w.xsize, w.ysize, len(bands), strip, datatype, area.geo_transform, area.projection.name, nodata, list(labels or [None] * len(bands)))
        if places:
            _fill(folder, whole, places)
        os.replace(whole, target)
        if callback:
            callback(1.0)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return total if and_sum else None


def _fill(folder: Path, whole: Path, places: dict[int, int]) -> None:
    """Tasks copy the strips of a folder to their places in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(whole, "r+b") as f:
            for batch in batches:
                for number, at in zip(batch.column("number").to_pylist(), batch.column("at").to_pylist(), strict=True):
                    f.seek(at)
                    f.write((folder / str(number)).read_bytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    spark = session()
    table = spark.createDataFrame(pa.table({"number": pa.array(list(places), pa.int64()), "at": pa.array(list(places.values()), pa.int64())}))
    table.repartition(max(1, min(len(places), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "n long").agg(F.sum("n")).first()


def layer_to_geotiff(layer: Layer, filename, and_sum: bool, callback, nodata: float | None, sparse: bool) -> float | None:
    return to_geotiff(filename, [layer], None, None, nodata, sparse, and_sum, callback)
