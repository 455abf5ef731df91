"""Geodesy and geometry as Column expressions: UTM, grids, rings."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563  # WGS 84
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger series of the transverse Mercator projection, orders 1 to 4 in the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_E = math.sqrt(_F * (2 - _F))


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; longitude 180 counts to zone 60."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_forward(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) in metres in the point's zone or the given one.

    Longitudes beyond 180 are places too: 186.5 lies where -173.5 does, so its metres are those of zone 2. The hyperbolic
    functions are written out as in the query's SQL, since last bits decide where a value is halfway between millimetres.
    """
    zone = F.floor((lon + 180) / 6) + F.when(lon == 180, 0).otherwise(1) if zone is None else zone
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    half_log = lambda v: 0.5 * F.ln((1 + v) / (1 - v))
    sinh, cosh = (lambda v: (F.exp(v) - F.exp(-v)) / 2), (lambda v: (F.exp(v) + F.exp(-v)) / 2)
    pole = F.abs(s) >= 1
    t = F.when(pole, s * float("inf")).otherwise(sinh(half_log(s) - F.lit(_E) * 0.5 * F.ln((1 + F.lit(_E) * s) / (1 - F.lit(_E) * s))))
    across = F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam))
    xi, eta = F.atan2(t, F.cos(lam)), F.ln(across + F.sqrt(F.sin(lam) * F.sin(lam) / (t * t + F.cos(lam) * F.cos(lam)) + 1))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * cosh(2 * j * eta)
    k = 0.9996 * _RADIUS
    return F.lit(500000.0) + k * x, F.when(lat >= 0, 0.0).otherwise(1e7) + k * y


#: Series back to conformal coordinates and from the conformal to the geographic latitude, orders 1 to 4.
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a place in a UTM zone."""
    k = 0.9996 * _RADIUS
    eta = (easting - 500000.0) / k
    xi = (northing - (1e7 if south else 0.0)) / k
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)


def inverse_arrays(x: np.ndarray, y: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """utm_inverse for arrays."""
    k = 0.9996 * _RADIUS
    eta, xi = (x - 500000.0) / k, (y - (1e7 if south else 0.0)) / k
    n, e = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        n -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        e -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(n) / np.cosh(e))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return np.degrees(phi), np.degrees(np.arctan2(np.sinh(e), np.cos(n))) + (zone * 6 - 183)


def project(lat: float, lon: float, zone: int) -> tuple[float, float]:
    """utm_forward for a single place on the driver."""
    phi, lam, s = math.radians(lat), math.radians(lon - (zone * 6 - 183)), math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - _E * math.atanh(_E * s))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500000 + 0.9996 * _RADIUS * x, (0 if lat >= 0 else 1e7) + 0.9996 * _RADIUS * y


def snap_grid(minx: Column, miny: Column, maxx: Column, maxy: Column, resolution: float) -> tuple[Column, Column, Column, Column]:
    """(origin x, origin y, width, height) of the pixel grid that covers the bounds; the origin is the upper left."""
    r = F.lit(float(resolution))
    left, top = F.floor(minx / r) * r, F.ceil(maxy / r) * r
    return left, top, F.greatest(F.ceil((maxx - left) / r), F.lit(1)), F.greatest(F.ceil((top - miny) / r), F.lit(1))


def rect_coverage(x0: Column, y0: Column, size: float, minx, miny, maxx, maxy) -> Column:
    """Share of a square tile inside a rectangle."""
    w = F.greatest(F.least(x0 + size, F.lit(maxx)) - F.greatest(x0, F.lit(minx)), F.lit(0.0))
    h = F.greatest(F.least(y0 + size, F.lit(maxy)) - F.greatest(y0, F.lit(miny)), F.lit(0.0))
    return w * h / max(size * size, 1.0)


def in_bbox(lat: Column, lon: Column, zone) -> Column:
    """Inclusive on all sides; a missing bound gives false."""
    return F.coalesce((lat >= zone["min_lat"]) & (lat <= zone["max_lat"]) & (lon >= zone["min_lon"]) & (lon <= zone["max_lon"]), F.lit(False))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast of a point against a closed ring of literal corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        above = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = F.lit(float(x1)) + (y - y1) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(above & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def edges_around(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray cast against edges (x1, y1, x2, y2) of any number of rings, so holes are outside."""
    cut = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))
    return F.size(F.filter(edges, cut)) % 2 == 1


def edges_meet_box(west: Column, south: Column, east: Column, north: Column, edges: Column) -> Column:
    """Whether rings touch or hold a box: an edge meets it, or a corner of it lies inside."""

    def meets(e: Column) -> Column:
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [side(x, y) for x in (west, east) for y in (south, north)]
        near = (F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= west) & (F.least(e["y1"], e["y2"]) <= north) & (F.greatest(e["y1"], e["y2"]) >= south)
        return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(edges, meets) | edges_around(west, south, edges)


def in_zone(lat: Column, lon: Column, zones) -> Column:
    """in_bbox, and inside the zone's polygon where it has edges."""
    box = in_bbox(lat, lon, zones)
    return box & (zones["edges"].isNull() | edges_around(lon, lat, zones["edges"])) if "edges" in zones.columns else box


def ring_area(xs: Column, ys: Column) -> Column:
    """Area of a ring given as two arrays, by the shoelace sum."""
    n = F.size(xs)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(xs, i) * F.get(ys, ((i + 1) % n).cast("int")) - F.get(xs, ((i + 1) % n).cast("int")) * F.get(ys, i),
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2
