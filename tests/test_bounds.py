"""What goes to the driver is bounded; groups of layers, metadata and names of files' layers."""

import numpy as np
import pytest

import gridloom as g
from gridloom import Area, DataType, MapProjection
from gridloom.plans import layer as layers
from gridloom.sources.grids import narrowed

P = MapProjection("ESRI:54009", 1.0, -1.0)


def test_arrays_and_values_on_the_driver_are_bounded(spark, monkeypatch):
    a = g.from_array(np.arange(12).reshape(3, 4), (0, 0), P)
    with pytest.raises(ValueError):
        a.unique(most=11)
    assert len(a.unique(most=12)) == 12
    monkeypatch.setattr(layers, "MOST_PIXELS", 11)
    with pytest.raises(ValueError):
        a.array()


def test_groups_of_one_of_shapes_and_of_expressions(spark):
    a = g.from_array(np.array([[1.0, 5.0], [5.0, 4.0]]), (0, 0), P, nodata=5.0)
    assert g.Mosaic([a]).array().tolist() == [[1, 0], [0, 4]]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, -1.0)], "priority int, left double, top double, right double, bottom double")
    shape = g.rectangles(boxes, P, 7)
    whole = g.Mosaic([shape, g.from_array(np.full((2, 2), 3), (0, 0), P) * 2])
    assert whole.array().tolist() == [[7, 6], [6, 6]] and whole.datatype is DataType.Int64
    assert g.Mosaic([a, shape]).datatype is DataType.UInt8


def test_narrowed_and_like(spark, tmp_path):
    rows = g.from_array(np.array([[2, 2, 2], [5, 5, 5]]), (0, 0), P)
    thin = narrowed(rows)
    assert thin.dimensions == rows.dimensions and (rows * thin).sum() == 3 * 4 + 3 * 25
    rows.save(tmp_path / "a.tif")
    two = g.from_array(np.zeros((1, 2)), (0, 0), MapProjection("ESRI:54009", 2.0, -2.0))
    assert g.read_raster_like(tmp_path / "a.tif", two, g.ResamplingMethod.Sum).sum() == pytest.approx(21)
    with pytest.raises(ValueError):
        g.read_raster_like(tmp_path / "a.tif", g.constant(1))


def test_areas_on_other_projections():
    a = Area(-10.0, 10.0, 10.0, -10.0, MapProjection("EPSG:4326", 0.5, -0.5)).reproject(MapProjection("EPSG:3857", 1e5, -1e5))
    assert (a.left, a.top, a.right, a.bottom) == (-1200000, 1200000, 1200000, -1200000)
    assert Area.world().reproject(P).is_world and Area(0, 0, 2, -2, P).project_like(P) == Area(0, 0, 2, -2, P)


@pytest.mark.parametrize("method", [m for m in g.ResamplingMethod if m is not g.ResamplingMethod.Sum])
@pytest.mark.parametrize(("source", "target"), [(("EPSG:4326", 1.0), ("ESRI:54009", 55_000.0)), (("ESRI:54009", 100_000.0), ("EPSG:4326", 0.7)), (("EPSG:4326", 2.0), ("EPSG:3857", 100_000.0))])
def test_a_constant_stays_constant_at_any_distortion(spark, method, source, target):
    p, q = (MapProjection(name, step, -step) for name, step in (source, target))
    edge = (0, 85.0) if p.name == "EPSG:4326" else (0, 8_900_000.0)
    top = edge[1] // p.xstep * p.xstep
    layer = g.from_array(np.ones((int(top / p.xstep), 6)), (0, top), p)
    out = layer.as_projection(q, method).array()
    inside = out[:, : out.shape[1] // 8 + 1]
    assert set(np.unique(out)) <= {0.0, 1.0} and out.sum() > 0
    rows = inside[:, 0][1:-1]
    assert np.all(rows[np.flatnonzero(rows)[0] : np.flatnonzero(rows)[-1]] == 1)  # no hole in the column at the edge


@pytest.mark.parametrize("step", [20_000.0, 5_000.0])
def test_sums_are_kept_across_projections(spark, step):
    layer = g.from_array(np.arange(64.0).reshape(8, 8), (10.0, 50.0), MapProjection("EPSG:4326", 0.1, -0.1))
    assert layer.as_projection(MapProjection("ESRI:54009", step, -step), g.ResamplingMethod.Sum).sum() == pytest.approx(2016, rel=0.03)
