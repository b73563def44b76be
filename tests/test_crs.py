"""Coordinate systems against published places, and there and back."""

import numpy as np
import pytest

import gridloom as g
from gridloom import MapProjection
from gridloom.plans import crs

# Published by the registry and the makers of the grids: longitude, latitude, east, north.
PLACES = {
    "EPSG:3035": [(5.0, 50.0, 3962799.45, 2999718.85), (10.0, 52.0, 4321000.0, 3210000.0)],
    "EPSG:6933": [(180.0, 0.0, 17367530.45, 0.0), (0.0, 90.0, 0.0, 7342230.14)],
    "EPSG:3395": [(180.0, 84.0, 20037508.34, 18764656.23), (-180.0, -80.0, -20037508.34, -15496570.74)],
    "EPSG:3857": [(180.0, 85.0511287798, 20037508.34, 20037508.34)],
    "ESRI:54009": [(180.0, 0.0, 18040095.7, 0.0), (0.0, 90.0, 0.0, 9020047.85)],
    "EPSG:32633": [(15.0, 0.0, 500000.0, 0.0)],
}


@pytest.mark.parametrize("name", PLACES)
def test_published_places(name):
    for lon, lat, x, y in PLACES[name]:
        np.testing.assert_allclose(crs.from_lonlat(name, lon, lat), (x, y), atol=0.02)


@pytest.mark.parametrize("name", [*PLACES, "EPSG:32719"])
def test_there_and_back(name):
    lon, lat = np.meshgrid(np.linspace(6, 14, 9) - (80 if name == "EPSG:32719" else 0), np.linspace(25, 80, 12) * (-1 if name == "EPSG:32719" else 1))
    back = crs.to_lonlat(name, *crs.from_lonlat(name, lon, lat))
    np.testing.assert_allclose(back, (lon, lat), atol=1e-8)


@pytest.mark.parametrize("name", ["EPSG:6933", "EPSG:3035", "ESRI:54009"])
def test_equal_areas(name):
    """Small squares keep the area that they have on the ellipsoid."""
    lat, d = np.linspace(30, 70, 9), 1e-3
    corners = [crs.from_lonlat(name, 12 + i * d, lat + j * d) for i, j in ((0, 0), (1, 0), (0, 1))]
    (ax, ay), (bx, by), (cx, cy) = corners
    flat = np.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    s = np.sin(np.radians(lat + d / 2))
    true = np.radians(d) ** 2 * crs.A**2 * (1 - crs.E2) * np.cos(np.radians(lat + d / 2)) / (1 - crs.E2 * s * s) ** 2
    np.testing.assert_allclose(flat, true, rtol=8e-3 if name == "ESRI:54009" else 1e-4)


def test_names_and_areas():
    for name in PLACES:
        assert MapProjection(name, 1000.0, -1000.0).epsg in (None, int(name.split(":")[1]))
        assert g.area_raster(MapProjection(name, 100_000.0, -100_000.0)).dimensions[0] > 5
    with pytest.raises(ValueError):
        MapProjection("EPSG:99999", 1.0, -1.0)
