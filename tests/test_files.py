"""Files: what is read of them, who writes them, and saving into them."""

import json
import pickle
import struct

import numpy as np
import pytest

import gridloom as g
from gridloom import Area, DataType, MapProjection
from gridloom.operators.mosaic import _apart
from gridloom.plans.geometry import Window
from gridloom.sources import tiff, vectors

P = MapProjection("ESRI:54009", 1.0, -1.0)


def test_a_window_reads_its_blocks_alone(spark, tmp_path):
    values = np.arange(3000.0).reshape(1500, 2)
    g.to_geotiff(tmp_path / "a.tif", [g.from_array(values, (3, -2), P), g.from_array(values * 2, (3, -2), P)])
    info = tiff.describe(str(tmp_path / "a.tif"))
    assert info.bands == 2 and len(tiff.blocks(info, 2, 3, None, [1, 2])) == 3
    found = tiff.blocks(info, 2, 3, Window(3, 520, 2, 4), [2])
    assert [(n, len(offsets)) for n, offsets, _ in found] == [(1, 1)]
    assert not tiff.blocks(info, 2, 3, Window(50, 0, 2, 2), [1])
    plan = g.read_raster(tmp_path / "a.tif", 2).as_area(Area(3, -520, 5, -522, P)).frame()
    assert "b1" not in plan._jdf.queryExecution().analyzed().toString()
    assert g.read_raster(tmp_path / "a.tif", 2).read_array(0, 518, 2, 2).tolist() == (values * 2)[518:520].tolist()


def test_no_pixel_passes_through_the_driver(spark, tmp_path, monkeypatch):
    from gridloom.sources import sinks

    sizes = {}
    real = tiff.write
    monkeypatch.setattr(sinks.tiff, "write", lambda path, given, *rest: sizes.update(given) or real(path, given, *rest))
    values = np.arange(5200, dtype=np.int16).reshape(1300, 4)
    g.from_array(values, (0, 0), P).to_geotiff(tmp_path / "a.tif")
    assert sorted(sizes) == [0, 1, 2] and all(isinstance(n, int) for n in sizes.values())
    assert g.read_raster(tmp_path / "a.tif").array().tolist() == values.tolist()
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"]


@pytest.mark.parametrize("kind", ["int8", "uint8", "uint16", "int32", "uint32", "int64", "float32", "float64"])
def test_types_round_trip(spark, tmp_path, kind):
    values = np.array([[0, 1, 100], [7, 3, 2]], kind)
    g.from_array(values, (0, 0), P).save(tmp_path / "a.tif")
    back = g.read_raster(tmp_path / "a.tif")
    assert back.datatype is DataType(kind) and back.array().tolist() == values.tolist()


def test_save_into_files(spark, tmp_path):
    ones = g.from_array(np.ones((4, 4), np.uint8), (0, 0), P)
    wide = g.from_array(np.full((6, 6), 300), (1, -1), P)
    into = g.empty_raster_like(ones, tmp_path / "x" / "a.tif", bands=2)
    assert into.sum() == 0 and into.dimensions == (4, 4)
    assert ones.save(into, band=2, and_sum=True) == 16
    assert wide.save(g.read_raster(tmp_path / "x" / "a.tif"), and_sum=True) == 9 * (300 % 256)
    first, second = (g.read_raster(tmp_path / "x" / "a.tif", i) for i in (1, 2))
    assert first.dimensions == (4, 4) and first.datatype is DataType.UInt8
    assert first.array().tolist() == np.pad(np.full((3, 3), 44), ((1, 0), (1, 0))).tolist() and second.sum() == 16
    with pytest.raises(g.InvalidRasterBand):
        ones.save(first, band=3)
    with pytest.raises(TypeError):
        ones.save(ones)
    g.bands_to_parquet([ones, (ones * 2).as_type(DataType.Byte)], f"{tmp_path}/g.parquet", ["one", "two"])
    wide.save(g.read_raster(f"{tmp_path}/g.parquet"), band=2)
    assert g.read_raster(f"{tmp_path}/g.parquet", 2).sum() == 9 * 44 and g.read_raster(f"{tmp_path}/g.parquet").name == "one"


def test_layers_of_files_are_pickled(spark, tmp_path):
    a = g.from_array(np.arange(6).reshape(2, 3), (0, 0), P)
    a.save(tmp_path / "a.tif")
    layer = pickle.loads(pickle.dumps(g.read_raster(tmp_path / "a.tif") * 2 + g.constant(1)))
    assert layer.sum() == 36
    with pytest.raises(TypeError):
        pickle.dumps(a)


def test_mosaics_of_files_that_do_not_meet_are_one_scan_without_shuffle(spark, tmp_path):
    values = np.arange(64).reshape(8, 8)
    for i in range(4):
        y, x = divmod(i, 2)
        g.from_array(values[4 * y : 4 * y + 4, 4 * x : 4 * x + 4], (4 * x, -4 * y), P).save(tmp_path / f"{i}.tif")
    whole = g.read_rasters(sorted(tmp_path.glob("*.tif")))
    plan = whole.frame()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan
    assert whole.array().tolist() == values.tolist()
    assert _apart([Window(0, 0, 4, 4), Window(4, 0, 4, 4), Window(7, 3, 9, 1), Window(40, 0, 1, 1)]) == [True, False, False, True]


def test_geojson_by_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "PART_BYTES", 300)
    features = [{"type": "Feature", "properties": {"id": i, "name": f"n{i}", "share": i / 2}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]}} for i in range(40)]
    text = '{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}\n"
    (tmp_path / "a.geojson").write_text(text)
    assert len(vectors._geojson_head(str(tmp_path / "a.geojson"))[0]) > 1
    q = MapProjection("EPSG:4326", 1.0, -1.0)
    layer = g.read_shape(tmp_path / "a.geojson", q, burn_value="id")
    assert layer.array().tolist() == [list(range(40))] and layer.datatype is DataType.Int64
    assert g.read_shape(tmp_path / "a.geojson", q, "name = 'n7'", burn_value="share").sum() == 3.5


def test_shapefile(spark, tmp_path):
    rings = [[(0, 2), (2, 2), (2, 0), (0, 0), (0, 2)], [(3, 1), (4, 1), (4, 0), (3, 0), (3, 1)]]
    records = [struct.pack("<i4d2i", 5, 0, 0, 4, 4, 1, len(r)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings]
    shp, shx, at = bytearray(100), bytearray(100), 100
    for i, r in enumerate(records):
        shx += struct.pack(">2i", at // 2, len(r) // 2)
        shp += struct.pack(">2i", i + 1, len(r) // 2) + r
        at = len(shp)
    field = b"id_no".ljust(11, b"\0") + b"N" + bytes(4) + bytes([4, 0]) + bytes(14)
    dbf = struct.pack("<B3BIHH", 3, 24, 1, 1, 2, 32 + 32 + 1, 5) + bytes(20) + field + b"\r" + b"   42" + b"   43"
    for ending, data in ((".shp", shp), (".shx", shx), (".dbf", dbf)):
        (tmp_path / f"a{ending}").write_bytes(bytes(data))
    q = MapProjection("EPSG:4326", 1.0, -1.0)
    assert g.read_shape(tmp_path / "a.shp", q, burn_value="id_no").sum() == 4 * 42 + 43
    (tmp_path / "a.shx").unlink()
    assert g.read_shape(tmp_path / "a.shp", q, "id_no = 43").sum() == 1


def test_long_edges_and_many_bands(spark):
    from pyspark.sql import functions as F

    from gridloom.operators.rasterize import Shapes

    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(point(0, 0), point(300, 0), point(0, -300))
    features = spark.range(1).select(F.lit(1).alias("priority"), F.lit(1).alias("burn"), F.array(ring).alias("rings"))
    layer = Shapes(features, Area(0, 0, 300, -300, P), DataType.Byte)
    assert layer.sum() == 300 * 301 / 2
    assert layer.as_area(Area(10, -100, 20, -299, P)).sum() == sum(max(0, min(20, 300 - y) - 10) for y in range(100, 299))
