import math

import pytest

from gridloom import Area, DataType, MapProjection, Window
from gridloom.plans import crs

P = MapProjection("ESRI:54009", 10.0, -10.0)


def test_projections_compare_within_a_metre():
    assert P == MapProjection("ESRI:54009", 10.4, -10.0)
    assert P != MapProjection("ESRI:54009", 12.0, -10.0)
    assert P != MapProjection("EPSG:3857", 10.0, -10.0)
    with pytest.raises(ValueError):
        MapProjection("EPSG:1", 1, -1)


def test_pixels_of_under_a_metre_are_noise():
    assert P.round_up_pixels(5.05, 5.2) == (5, 6)
    assert P.round_down_pixels(5.95, 5.8) == (6, 5)


def test_an_area_is_whole_pixels():
    with pytest.raises(ValueError):
        Area(0, 0, 15, -20, P)
    assert Area(0, 0, 20, -30, P).pixel_dimensions == (2, 3)
    assert Area(0, 0, 20, -30, P).geo_transform == (0, 10.0, 0.0, 0, 0.0, -10.0)


def test_world_is_neutral_for_and_but_absorbs_or():
    a = Area(0, 0, 20, -30, P)
    assert a & Area.world() == a and (a | Area.world()).is_world and Area.world() == Area.world()


@pytest.mark.parametrize("offset", [0.0, 1.0, 4.9, 5.0, -4.9])
def test_offsets_of_up_to_half_a_step_are_the_same_cells(offset):
    a, b = Area(0, 0, 30, -30, P), Area(10 + offset, -10, 40 + offset, -40, P)
    both = a & b
    assert both.window == Window(1, 1, 2, 2)
    assert math.isclose(both.left, 10 + offset / 2)
    assert (a | b).window == Window(0, 0, 4, 4)


def test_more_than_half_a_step_is_the_next_cell():
    assert (Area(0, 0, 30, -30, P) & Area(15.1, -10, 45.1, -40, P)).window == Window(2, 1, 1, 2)


def test_apart_and_mismatch():
    with pytest.raises(ValueError):
        Area(0, 0, 10, -10, P) & Area(50, 0, 60, -10, P)
    with pytest.raises(ValueError):
        Area(0, 0, 10, -10, P) & Area(0, 0, 1, -1, MapProjection("EPSG:4326", 1, -1))


def test_an_area_without_projection_is_widened():
    assert (Area(0, 0, 30, -30, P) & Area(12, -12, 18, -18)).window == Window(1, 1, 1, 1)
    assert Area(12, -12, 18, -18).project_like(P) == Area(10, -10, 20, -20, P)


def test_overlap_counts_edges():
    a = Area(0, 0, 10, -10, P)
    assert a.overlaps(Area(10, 0, 20, -10, P)) and not a.overlaps(Area(20, 0, 30, -10, P)) and a.overlaps(Area.world())
    assert a.grow(10) == Area(-10, 10, 20, -20, P)


def test_windows():
    a, b = Window(0, 0, 10, 10), Window(2, 2, 3, 3)
    assert b < a and a >= b and a.grow(1) == Window(-1, -1, 12, 12)
    assert Window.find_intersection([a, Window(5, 5, 10, 10)]) == Window(5, 5, 5, 5)
    assert Window.shared([a, Window(20, 0, 1, 1)]) is None
    for bad in ((0.5, 0, 1, 1), (True, 0, 1, 1)):
        with pytest.raises(ValueError):
            Window(*bad)


@pytest.mark.parametrize("name", ["ESRI:54009", "EPSG:3857", "EPSG:32633", "EPSG:32733"])
def test_coordinates_come_back(name):
    lon, lat = [12.0, 15.0, 17.5], [10.0, 47.5, 60.0]
    if name == "EPSG:32733":
        lat = [-x for x in lat]
    back = crs.to_lonlat(name, *crs.from_lonlat(name, lon, lat))
    assert back[0] == pytest.approx(lon, abs=1e-8) and back[1] == pytest.approx(lat, abs=1e-8)


def test_known_points():
    x, y = crs.from_lonlat("EPSG:32631", [3.0], [0.0])
    assert x[0] == pytest.approx(500000) and y[0] == pytest.approx(0)
    x, y = crs.from_lonlat("ESRI:54009", [180.0, 0.0], [0.0, 90.0])
    assert x[0] == pytest.approx(18040095.7, abs=1) and y[1] == pytest.approx(9020047.8, abs=1)


def test_types():
    assert DataType.Byte is DataType.UInt8 and DataType.joint([DataType.Int8, DataType.UInt8]) is DataType.Int16
    assert DataType.joint([DataType.UInt64, DataType.Int64]) is DataType.Float64 and DataType.of_literal(3) is DataType.Int64
    with pytest.raises(ValueError):
        DataType.of_array([True])
    assert all(DataType.of_gdal(t.to_gdal()) is t for t in DataType)


def _areas():
    from hypothesis import strategies as st

    cell = st.integers(-50, 50)
    off = st.sampled_from([0.0, 1.0, -2.0, 4.0])
    return st.builds(lambda x, y, w, h, dx, dy: Area.of_window(Window(x, y, w, h), P, (dx, dy)), cell, cell, st.integers(1, 40), st.integers(1, 40), off, off)


def test_area_algebra():
    from hypothesis import given, settings

    @settings(max_examples=200, deadline=None)
    @given(_areas(), _areas(), _areas())
    def laws(a, b, c):
        assert a | b == b | a and (a | b).window == (b | a).window
        assert ((a | b) | c).window == (a | (b | c)).window
        assert (a | b).window.contains(a.window) and (a | b).window.contains(b.window)
        shared = Window.shared([a.window, b.window])
        if shared is None:
            with pytest.raises(ValueError):
                a & b
        else:
            assert (a & b).window == shared == (b & a).window and a.overlaps(b)
        assert (a & a) == a and (a | a) == a and a & Area.world() == a

    laws()
