import json
import sqlite3
import struct

import numpy as np
import pytest

import gridloom as g
from gridloom import Area, DataType, MapProjection
from gridloom.operators.rasterize import touched
from gridloom.plans.layer import Expression, lower
from gridloom.sources.grids import is_uniform_rows, narrow, rasters_in

P = MapProjection("ESRI:54009", 1.0, -1.0)
A = np.array([[1, 2, 3, 4], [5, 6, 7, 8]])
B = A * 10


@pytest.fixture
def layers(spark):
    return g.from_array(A, (0, 0), P), g.from_array(B, (0, 0), P), g.from_array(np.where(A == 5, np.nan, A / 2), (0, 0), P)


CASES = {
    "add": lambda a, b, f: a + b, "sub": lambda a, b, f: a - b - f, "mul": lambda a, b, f: a * f, "truediv": lambda a, b, f: b / a, "floordiv": lambda a, b, f: b // -a,
    "mod": lambda a, b, f: b % -3, "modf": lambda a, b, f: (f - 2) % 1.5, "pow": lambda a, b, f: a**2, "radd": lambda a, b, f: 1 + f, "rsub": lambda a, b, f: 1 - f, "rpow": lambda a, b, f: 2.0**a,
    "eq": lambda a, b, f: f == a / 2, "ne": lambda a, b, f: f != a / 2, "lt": lambda a, b, f: f < 2, "le": lambda a, b, f: f <= 2, "gt": lambda a, b, f: f > 2, "ge": lambda a, b, f: f >= 2, "rgt": lambda a, b, f: 3 > f,
    "and": lambda a, b, f: a & 6, "or": lambda a, b, f: a | b, "lshift": lambda a, b, f: a << 3, "rshift": lambda a, b, f: b >> 1, "neg": lambda a, b, f: -f, "pos": lambda a, b, f: +f, "logic": lambda a, b, f: (a > 2) & (b < 70),
}


@pytest.mark.parametrize("name", list(CASES))
def test_operators_agree_with_numpy(layers, name):
    f = np.where(A == 5, np.nan, A / 2)
    with np.errstate(all="ignore"):
        expected = CASES[name](A, B, f)
    got = CASES[name](*layers)
    np.testing.assert_allclose(got.array(), expected.astype(float))
    assert got.dimensions == (4, 2)


FUNCTIONS = {
    "abs": (lambda m, x: m.abs(x), None), "floor": (lambda m, x: m.floor(x), None), "ceil": (lambda m, x: m.ceil(x), None), "round": (lambda m, x: m.round(x), None), "log": (lambda m, x: m.log(x), None),
    "log2": (lambda m, x: m.log2(x), None), "log10": (lambda m, x: m.log10(x), None), "exp": (lambda m, x: m.exp(x), None), "exp2": (lambda m, x: m.exp2(x), None), "isin": (lambda m, x: m.isin(x, [1, 2.5]), None),
    "clip": (lambda m, x: m.clip(x, -1, 2), None), "nan_to_num": (lambda m, x: m.nan_to_num(x, nan=7, posinf=8, neginf=9), None), "minimum": (lambda m, x: m.minimum(x, 1.5), None), "maximum": (lambda m, x: m.maximum(x, 1.5), None),
    "where": (lambda m, x: m.where(x > 1, x, -1), None), "logical_not": (lambda m, x: m.logical_not(x), None), "logical_xor": (lambda m, x: m.logical_xor(x, 1), None), "logical_and": (lambda m, x: m.logical_and(x, 0), None), "logical_or": (lambda m, x: m.logical_or(x, 0), None),
}


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_functions_agree_with_numpy(spark, name):
    x = np.array([[0.5, 1.5, 2.5, -0.5], [0.0, np.nan, np.inf, -np.inf]])
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(FUNCTIONS[name][0](g, g.from_array(x, (0, 0), P)).array(), np.asarray(FUNCTIONS[name][0](np, x), float))


def test_division_by_zero(spark):
    x = g.from_array(np.array([[1.0, -1.0, 0.0, np.nan]]), (0, 0), P)
    np.testing.assert_array_equal((x / 0).array(), [[np.inf, -np.inf, np.nan, np.nan]])
    assert np.isnan((x % 0).array()).all()


def test_footprints(spark):
    a, b = g.from_array(np.ones((4, 4), int), (0, 0), P), g.from_array(np.ones((4, 4), int), (10, -10), P)
    assert (a + b).dimensions == (14, 14) and (a + b).sum() == 32
    with pytest.raises(ValueError):
        (a * b).area  # noqa: B018
    assert ((a + 1) * (b + 1)).sum() == 228
    inset = g.from_array(np.array([[10, 20], [50, 60]]), (1, -1), P)
    whole = g.from_array(np.arange(1, 17).reshape(4, 4), (0, 0), P)
    assert (whole + inset).sum() == 136 + 140 and (whole * inset).dimensions == (2, 2)
    assert (whole == inset).dimensions == (2, 2) and (whole != inset).dimensions == (4, 4)
    assert g.where(inset > 0, whole, 0).dimensions == (2, 2)
    assert (whole.as_area(inset).as_area(whole)).sum() == 136
    assert whole.as_area(Area(1, -1, 3, -3)).sum() == 6 + 7 + 10 + 11
    with pytest.raises(TypeError):
        whole.as_area(None)
    with pytest.raises(ValueError):
        whole + g.from_array(np.ones((2, 2)), (0, 0), ("EPSG:4326", (1, -1)))


def test_equal_leaves_are_one_scan(spark):
    a = g.from_array(A, (0, 0), P)
    plan = ((a > 2) & (a < 7)).frame()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_bounds_reach_the_scan(spark, tmp_path):
    g.from_array(np.arange(10000).reshape(100, 100), (0, 0), P).to_parquet(f"{tmp_path}/a.parquet")
    layer = g.read_raster(f"{tmp_path}/a.parquet")
    plan = layer.as_area(Area(5.0, -5.0, 7.0, -8.0)).frame()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(y), IsNotNull(x), GreaterThanOrEqual(y,5), LessThan(y,8)" in plan
    assert layer.read_array(5, 5, 2, 1).tolist() == [[505, 506]]


def test_sums_of_zero_keeping_trees_need_no_grid(spark):
    a = g.from_array(A, (0, 0), P)
    far = g.from_array(B, (10_000_000, -10_000_000), P)
    assert (a + far).sum() == A.sum() + B.sum()


def test_aggregates(layers):
    a, _, f = layers
    assert a.sum() == 36 and a.min() == 1 and a.max() == 8 and np.isnan(f.sum()) and f.max() == 4
    values, counts = (a % 2).unique(return_counts=True)
    assert values.tolist() == [0, 1] and counts.tolist() == [4, 4]
    assert np.isnan(f.unique()[-1]) and len(f.unique()) == 8
    assert g.sum([a, a, 1]).sum() == 80 and g.any([a > 7, a < 2]).sum() == 2 and g.all([a > 2, a < 5]).sum() == 2
    with pytest.raises(ValueError):
        g.sum([])
    with pytest.raises(ValueError):
        g.constant(3).sum()
    seen = []
    a.sum(callback=seen.append)
    assert seen[0] == 0.0 and seen[-1] == 1.0


def test_declared_types(layers):
    a, _, f = layers
    assert (a == 3).datatype is DataType.Int64 and (a / 2).datatype is DataType.Int64 and (a + g.constant(1)).datatype is DataType.Float64
    assert f.as_type(DataType.Byte).datatype is DataType.Byte
    assert g.from_array(np.array([[5.5, -5.5, 300.0, np.nan]]), (0, 0), P).as_type(DataType.Int8).array().tolist() == [[5, -5, 44, 0]]


def test_nodata_and_mosaics(spark):
    a = g.from_array(np.array([[1.0, 5.0], [5.0, 4.0]]), (0, 0), P, nodata=5.0)
    b = g.from_array(np.array([[10.0, 20.0, 30.0]]), (0, 0), P)
    np.testing.assert_array_equal(a.array(), [[1, np.nan], [np.nan, 4]])
    np.testing.assert_array_equal(g.Mosaic([a, b]).array(), [[1, 20, 30], [0, 4, 0]])
    np.testing.assert_array_equal(g.Mosaic([b, a]).array(), [[10, 20, 30], [0, 4, 0]])
    with pytest.raises(g.MosaicEmpty):
        g.Mosaic([])


def test_mosaics_without_gaps_need_no_grid(spark):
    tiles = [g.from_array(np.full((2, 3), i), (3 * (i % 2), -2 * (i // 2)), P) for i in range(4)]
    whole, gap = g.Mosaic(tiles), g.Mosaic(tiles[:3])
    assert whole.dense and not gap.dense
    assert "Join" not in whole.frame()._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_array_equal(whole.array(), np.kron([[0, 1], [2, 3]], np.ones((2, 3))))
    np.testing.assert_array_equal(gap.array(), np.kron([[0, 1], [2, 0]], np.ones((2, 3))))


def test_save(layers, tmp_path):
    a, seen = layers[0], []
    assert a.save(f"{tmp_path}/a.parquet", and_sum=True, callback=seen.append) == 36 and seen == [0.0, 1.0]
    assert a.parallel_save(tmp_path / "a.tif", Area(0, 0, 2, -2, P), and_sum=True) == 14
    assert g.read_raster(f"{tmp_path}/a.parquet").sum() == 36 and g.read_raster(tmp_path / "a.tif").dimensions == (2, 2)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_convolution(spark, k):
    rng = np.random.default_rng(k)
    x, w = rng.normal(size=(20, 30)), rng.integers(-3, 4, (k, k)).astype(float)
    padded = np.pad(x, k // 2)
    expected = sum(w[i, j] * padded[i : i + 20, j : j + 30] for i in range(k) for j in range(k))
    from gridloom.operators.convolve import Convolved

    np.testing.assert_allclose(Convolved(g.from_array(x, (3, -2), P), w, tile=8).array(), expected, atol=1e-9)
    with pytest.raises(ValueError):
        g.from_array(x, (0, 0), P).conv2d(np.ones((2, 2)))


def test_rescaling(spark):
    x = np.arange(16.0).reshape(4, 4)
    layer, two = g.from_array(x, (0, 0), P), MapProjection("ESRI:54009", 2.0, -2.0)
    blocks = x.reshape(2, 2, 2, 2).transpose(0, 2, 1, 3).reshape(2, 2, 4)
    for method, f in (("Average", np.mean), ("Min", np.min), ("Max", np.max), ("Med", np.median), ("Sum", np.sum)):
        np.testing.assert_allclose(layer.as_projection(two, g.ResamplingMethod[method]).array(), f(blocks, axis=2))
    half = layer.as_projection(MapProjection("ESRI:54009", 0.5, -0.5), g.ResamplingMethod.Average)
    np.testing.assert_allclose(half.array(), np.kron(x, np.ones((2, 2))))
    third = MapProjection("ESRI:54009", 3.0, -3.0)
    assert layer.as_projection(third, g.ResamplingMethod.Sum).sum() == pytest.approx(x.sum())


def test_warp_keeps_the_total(spark):
    q = MapProjection("EPSG:4326", 0.1, -0.1)
    x = np.kron([[0.0, 1.0], [1.0, 0.0]], np.ones((8, 8)))
    layer = g.from_array(x, (10.0, 10.0), q)
    warped = layer.as_projection(MapProjection("ESRI:54009", 20000.0, -20000.0), g.ResamplingMethod.Sum)
    assert warped.sum() == pytest.approx(x.sum(), rel=0.02)


def test_geotiff_round_trip(spark, tmp_path):
    a = g.from_array(np.arange(5200.0).reshape(1300, 4), (3, -2), P)
    path = tmp_path / "x" / "a.tif"
    assert a.to_geotiff(path, and_sum=True) == a.sum()
    back = g.read_raster(path)
    assert back.area == a.area and back.datatype is DataType.Float64
    np.testing.assert_array_equal(back.array(), a.array())
    with pytest.raises(FileNotFoundError):
        g.read_raster(tmp_path / "none.tif")
    with pytest.raises(g.InvalidRasterBand):
        g.read_raster(path, 2)
    assert rasters_in(tmp_path / "x").sum() == a.sum()
    with pytest.raises(TypeError):
        g.read_rasters(str(path))


def test_multiband_and_sparse(spark, tmp_path):
    a, b = g.from_array(np.ones((4, 4), np.uint8), (0, 0), P), g.from_array(np.full((4, 4), 2, np.uint8), (2, -2), P)
    g.to_geotiff(tmp_path / "m.tif", [a, b], ["one", "two"])
    second = g.read_raster(tmp_path / "m.tif", 2)
    assert second.name == "two" and second.sum() == 32 and second.dimensions == (6, 6)
    with pytest.raises(TypeError):
        g.to_geotiff(tmp_path / "n.tif", [a, a * 1.5])
    zeros = g.from_array(np.zeros((1100, 3), np.uint8), (0, 0), P)
    with pytest.raises(ValueError):
        zeros.to_geotiff(tmp_path / "s.tif", sparse=True)
    zeros.to_geotiff(tmp_path / "s.tif", sparse=True, nodata=0)
    assert g.read_raster(tmp_path / "s.tif", ignore_nodata=True).sum() == 0


def test_rasterised_polygons():
    square = [np.array([(1, 1), (3, 1), (3, 3), (1, 3)])]
    assert [(y, c.tolist()) for y, c in touched(square, 0, 10)] == [(1, [1, 2]), (2, [1, 2])]
    hole = [np.array([(0, 0), (5, 0), (5, 5), (0, 5)]), np.array([(1, 1), (4, 1), (4, 4), (1, 4)])]
    assert dict((y, c.tolist()) for y, c in touched(hole, 0, 5))[2] == [0, 4]
    triangle = [np.array([(0, 0), (2, 0), (0, 2)])]
    assert [(y, c.tolist()) for y, c in touched(triangle, 0, 5)] == [(0, [0, 1]), (1, [0])]


def _gpkg(path, rings):
    wkb = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[c for p in r for c in p]) for r in rings)
    with sqlite3.connect(path) as con:
        con.execute("create table gpkg_geometry_columns (table_name, column_name, srs_id)")
        con.execute("create table gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id)")
        con.execute("insert into gpkg_geometry_columns values ('f', 'geom', 4326)")
        con.execute("insert into gpkg_spatial_ref_sys values (4326, 'EPSG', 4326)")
        con.execute("create table f (id_no integer, geom blob)")
        con.execute("insert into f values (42, ?)", (b"GP\0\1" + struct.pack("<i", 4326) + wkb,))


def test_shapes(spark, tmp_path):
    boxes = [[(0, 4), (2, 4), (2, 2), (0, 2), (0, 4)], [(2, 2), (4, 2), (4, 0), (2, 0), (2, 2)]]
    features = [{"type": "Feature", "properties": {"id_no": 42 + i}, "geometry": {"type": "Polygon", "coordinates": [b]}} for i, b in enumerate(boxes)]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [*features, {"type": "Feature", "properties": {"id_no": 1}, "geometry": None}]}))
    q = MapProjection("EPSG:4326", 1.0, -1.0)
    assert g.read_shape(path, q).sum() == 8 and g.read_shape(path, q).dimensions == (4, 4)
    assert g.read_shape(path, q, "id_no = 42").sum() == 4 and g.read_shape(path, q, burn_value="id_no").sum() == 4 * 85
    assert g.read_shape(path, q, burn_value=300).datatype is DataType.UInt16
    like = g.from_array(np.ones((8, 8), np.float32), (-1, 5), q)
    assert (g.read_shape_like(path, like) * like).sum() == 8 and g.read_shape_like(path, like).datatype is DataType.Float32
    assert g.read_shape(path).projection is None
    _gpkg(tmp_path / "a.gpkg", [boxes[0]])
    assert g.read_shape(tmp_path / "a.gpkg", q, burn_value="id_no").sum() == 4 * 42


def test_narrow_and_uniform(spark, tmp_path):
    column = g.from_array(np.array([[1], [2]]), (-180.0, 1.0), ("EPSG:4326", (1.0, -1.0)))
    ones = g.from_array(np.ones((2, 5)), (0.0, 1.0), ("EPSG:4326", (1.0, -1.0)))
    assert (ones * narrow(column)).sum() == 15
    assert is_uniform_rows(ones) and not is_uniform_rows(g.from_array(A, (0, 0), P))
    with pytest.raises(ValueError):
        narrow(ones)


def test_area_raster(spark):
    areas = g.area_raster(MapProjection("EPSG:4326", 10.0, -10.0))
    assert areas.dimensions == (36, 18) and areas.sum() == pytest.approx(5.1006e14, rel=1e-3)


def test_trees_can_be_seen(layers, capsys):
    a, b, _ = layers
    tree = (a + b) * a
    assert tree.pretty_print().startswith("mul") and tree.to_graphviz().count("label") == 4
    assert isinstance(tree, Expression) and lower(tree, tree.window)[1].kind == "i"


def test_places(layers):
    q = g.from_array(np.ones((4, 4)), (10.0, 10.0), ("EPSG:4326", (0.2, -0.2)))
    assert q.latlng_for_pixel(1, 2) == pytest.approx((9.6, 10.2)) and q.pixel_for_latlng(9.5, 10.3) == (1, 2)


def test_repartitioning_changes_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a, b = g.from_array(np.arange(400).reshape(20, 20), (0, 0), P), g.from_array(np.ones((20, 20)), (7, -3), P)
    try:
        results = []
        for n in (1, 3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append((a + b).array())
        assert all((r == results[0]).all() for r in results)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
