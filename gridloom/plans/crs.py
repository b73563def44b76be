"""Coordinate systems by formula: longitude/latitude, Mollweide, web and world Mercator, equal-area cylinder and UTM, all on WGS 84,
and the equal-area azimuthal system of Europe, whose ellipsoid differs by a tenth of a millimetre."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

A, B = 6378137.0, 6356752.314245179  # WGS 84 semi-axes
E2 = 1 - (B / A) ** 2


@dataclass(frozen=True)
class System:
    name: str
    unit: str
    epsg: int | None
    kind: str
    zone: int = 0
    south: bool = False


@lru_cache
def lookup(name: str) -> System:
    """The system of a name such as EPSG:4326, or of a WKT text that names it; ValueError if it isn't known."""
    text = str(name).strip().upper().replace(" ", "")
    if text in ("EPSG:4326", "WGS84", "OGC:CRS84") or re.match(r'GEOG(CS|CRS)\["WGS_?84', text):
        return System("EPSG:4326", "degree", 4326, "geographic")
    if "54009" in text or "MOLLWEIDE" in text:
        return System("ESRI:54009", "metre", None, "mollweide")
    if text in ("EPSG:3857", "EPSG:900913") or "PSEUDO-MERCATOR" in text:
        return System("EPSG:3857", "metre", 3857, "mercator")
    if text == "EPSG:3395" or "WORLD_MERCATOR" in text or "WGS84/WORLDMERCATOR" in text:
        return System("EPSG:3395", "metre", 3395, "world mercator")
    if text == "EPSG:6933" or "EASE-GRID2.0GLOBAL" in text:
        return System("EPSG:6933", "metre", 6933, "equal cylinder")
    if text == "EPSG:3035" or "LAEAEUROPE" in text.replace("-", "").replace("_", ""):
        return System("EPSG:3035", "metre", 3035, "equal azimuth")
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", text) or re.search(r"UTMZONE(\d\d?)([NS])", text)
    if m:
        first, second = m.groups()
        zone, south = (int(second), first == "7") if second.isdigit() else (int(first), second == "S")
        if 1 <= zone <= 60:
            return System(f"EPSG:32{7 if south else 6}{zone:02d}", "metre", 32000 + (700 if south else 600) + zone, "utm", zone, south)
    raise ValueError(f"Invalid map projection: {name}")


def _mollweide(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    theta = lat.copy()
    for _ in range(30):
        slope = 2 + 2 * np.cos(2 * theta)
        theta = theta - np.where(np.abs(slope) < 1e-12, 0, (2 * theta + np.sin(2 * theta) - np.pi * np.sin(lat)) / np.where(np.abs(slope) < 1e-12, 1, slope))
    return 2 * np.sqrt(2) / np.pi * A * lon * np.cos(theta), np.sqrt(2) * A * np.sin(theta)


def _mollweide_back(x, y):
    with np.errstate(invalid="ignore", divide="ignore"):
        theta = np.arcsin(y / (A * np.sqrt(2)))
        lat = np.arcsin((2 * theta + np.sin(2 * theta)) / np.pi)
        lon = np.pi * x / (2 * A * np.sqrt(2) * np.cos(theta))
        lon = np.where(np.abs(lon) > np.pi * (1 + 1e-9), np.nan, lon)
    return np.degrees(lon), np.degrees(lat)


def _latitude(find, guess):
    """Latitudes in radians by a fixed point: ``find`` gives a better one."""
    for _ in range(12):
        guess = find(guess)
    return guess


def _world_mercator(lon, lat):
    e, phi = np.sqrt(E2), np.radians(lat)
    with np.errstate(divide="ignore"):
        return A * np.radians(lon), A * (np.log(np.tan(np.pi / 4 + phi / 2)) - e * np.arctanh(e * np.sin(phi)))


def _world_mercator_back(x, y):
    e, t = np.sqrt(E2), y / A
    phi = _latitude(lambda p: 2 * np.arctan(np.exp(t + e * np.arctanh(e * np.sin(p)))) - np.pi / 2, 2 * np.arctan(np.exp(t)) - np.pi / 2)
    return np.degrees(x / A), np.degrees(phi)


def _q(phi):
    """Twice the area from the equator to a latitude on the ellipsoid of half-axis 1, for a longitude of 1."""
    e, s = np.sqrt(E2), np.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(e * s) / e)


def _latitude_of_q(q):
    """Inverse of _q by the series in the authalic latitude, made exact by Newton's steps."""
    with np.errstate(invalid="ignore"):
        beta = np.arcsin(np.where(np.abs(q) <= _q(np.pi / 2) * (1 + 1e-12), np.clip(q / _q(np.pi / 2), -1, 1), np.nan))
    phi = beta + (E2 / 3 + 31 * E2**2 / 180) * np.sin(2 * beta) + 23 * E2**2 / 360 * np.sin(4 * beta)
    for _ in range(4):
        s, c = np.sin(phi), np.cos(phi)
        phi = phi + np.where(np.abs(c) < 1e-9, 0, (1 - E2 * s * s) ** 2 / (2 * np.where(np.abs(c) < 1e-9, 1, c) * (1 - E2)) * (q - _q(phi)))
    return phi


_K = np.cos(np.radians(30)) / np.sqrt(1 - E2 * np.sin(np.radians(30)) ** 2)  # the cylinder cuts at 30 degrees
_LAEA = (np.radians(52.0), np.radians(10.0), 4321000.0, 3210000.0)  # latitude and longitude of the centre, and its place


def _azimuth():
    """Authalic radius, sine and cosine of the centre's authalic latitude, and the factor that keeps scale there."""
    phi, whole = _LAEA[0], _q(np.pi / 2)
    radius, beta = A * np.sqrt(whole / 2), np.arcsin(_q(phi) / whole)
    factor = A * np.cos(phi) / np.sqrt(1 - E2 * np.sin(phi) ** 2) / (radius * np.cos(beta))
    return radius, np.sin(beta), np.cos(beta), factor


def _laea(lon, lat):
    radius, s1, c1, d = _azimuth()
    beta, dl = np.arcsin(np.clip(_q(np.radians(lat)) / _q(np.pi / 2), -1, 1)), np.radians(lon) - _LAEA[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        b = radius * np.sqrt(2 / (1 + s1 * np.sin(beta) + c1 * np.cos(beta) * np.cos(dl)))
        return _LAEA[2] + b * d * np.cos(beta) * np.sin(dl), _LAEA[3] + b / d * (c1 * np.sin(beta) - s1 * np.cos(beta) * np.cos(dl))


def _laea_back(x, y):
    radius, s1, c1, d = _azimuth()
    u, v = (x - _LAEA[2]) / d, (y - _LAEA[3]) * d
    rho = np.hypot(u, v)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = 2 * np.arcsin(rho / (2 * radius))
        beta = np.where(rho > 0, np.cos(c) * s1 + v * np.sin(c) * c1 / np.where(rho > 0, rho, 1), s1)
        lon = _LAEA[1] + np.arctan2(u * np.sin(c), rho * c1 * np.cos(c) - v * s1 * np.sin(c))
    return np.degrees(lon), np.degrees(_latitude_of_q(beta * _q(np.pi / 2)))


def _series():
    """Coefficients of the transverse Mercator series in the third flattening."""
    n = (A - B) / (A + B)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    geodetic = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, forward, back, geodetic


def _utm(lon, lat, zone, south):
    n, radius, alpha, _, _ = _series()
    lon = np.radians(lon - (6 * zone - 183))
    s, k = np.sin(np.radians(lat)), 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(s) - k * np.arctanh(k * s))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * radius * x, (1e7 if south else 0) + 0.9996 * radius * y


def _utm_back(x, y, zone, south):
    _, radius, _, beta, delta = _series()
    xi, eta = (y - (1e7 if south else 0)) / (0.9996 * radius), (x - 500000) / (0.9996 * radius)
    xi1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = np.arcsin(np.sin(xi1) / np.cosh(eta1))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return 6 * zone - 183 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1))), np.degrees(lat)


def to_lonlat(name: str, x, y):
    """Longitude and latitude in degrees; NaN where a point has none."""
    s, x, y = lookup(name), np.asarray(x, float), np.asarray(y, float)
    if s.kind == "mollweide":
        return _mollweide_back(x, y)
    if s.kind == "mercator":
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2)
    if s.kind == "utm":
        return _utm_back(x, y, s.zone, s.south)
    if s.kind == "world mercator":
        return _world_mercator_back(x, y)
    if s.kind == "equal cylinder":
        return np.degrees(x / (A * _K)), np.degrees(_latitude_of_q(2 * y * _K / A))
    if s.kind == "equal azimuth":
        return _laea_back(x, y)
    return x, y


def from_lonlat(name: str, lon, lat):
    s, lon, lat = lookup(name), np.asarray(lon, float), np.asarray(lat, float)
    if s.kind == "mollweide":
        return _mollweide(lon, lat)
    if s.kind == "mercator":
        with np.errstate(divide="ignore"):
            return A * np.radians(lon), A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    if s.kind == "utm":
        return _utm(lon, lat, s.zone, s.south)
    if s.kind == "world mercator":
        return _world_mercator(lon, lat)
    if s.kind == "equal cylinder":
        return A * _K * np.radians(lon), A * _q(np.radians(lat)) / (2 * _K)
    if s.kind == "equal azimuth":
        return _laea(lon, lat)
    return lon, lat


def transform(source: str, target: str, x, y):
    """Points from one system to the other (x east, y north)."""
    if lookup(source) == lookup(target):
        return np.asarray(x, float), np.asarray(y, float)
    return from_lonlat(target, *to_lonlat(source, x, y))
