"""Map projections as closed-form columns (Snyder, 1987)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# GRS80 ellipsoid and the parameters of the European equal-area grid.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
LAEA_LAT0, LAEA_LON0 = 52.0, 10.0
LAEA_FE, LAEA_FN = 4321000.0, 3210000.0

E2 = GRS80_F * (2 - GRS80_F)
ECC = math.sqrt(E2)


def _q(s):
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))


QP = _q(1.0)
RQ = GRS80_A * math.sqrt(QP / 2)
_S0 = math.sin(math.radians(LAEA_LAT0))
BETA0 = math.asin(_q(_S0) / QP)
_M0 = math.cos(math.radians(LAEA_LAT0)) / math.sqrt(1 - E2 * _S0 * _S0)
DD = GRS80_A * _M0 / (RQ * math.cos(BETA0))


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to metres on the equal-area grid."""
    s = F.sin(F.radians(lat))
    q = (F.lit(1 - E2)) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / F.lit(2 * ECC))
    beta = F.asin(q / F.lit(QP))
    dl = F.radians(lon - LAEA_LON0)
    b = RQ * F.sqrt(
        F.lit(2.0) / (1 + math.sin(BETA0) * F.sin(beta) + math.cos(BETA0) * F.cos(beta) * F.cos(dl))
    )
    x = LAEA_FE + b * DD * F.cos(beta) * F.sin(dl)
    y = LAEA_FN + b / DD * (math.cos(BETA0) * F.sin(beta) - math.sin(BETA0) * F.cos(beta) * F.cos(dl))
    return x, y


def laea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres on the equal-area grid back to degrees."""
    dx, dy = (x - LAEA_FE) / DD, (y - LAEA_FN) * DD
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(rho / F.lit(2 * RQ))
    sin_beta = F.when(rho == 0, F.lit(math.sin(BETA0))).otherwise(
        F.cos(c) * math.sin(BETA0) + dy * F.sin(c) * math.cos(BETA0) / rho
    )
    beta = F.asin(sin_beta)
    e4, e6 = E2 * E2, E2 * E2 * E2
    lat = (
        beta
        + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    lon = LAEA_LON0 + F.degrees(
        F.atan2(dx * F.sin(c), rho * math.cos(BETA0) * F.cos(c) - dy * math.sin(BETA0) * F.sin(c))
    )
    return F.when(rho == 0, F.lit(LAEA_LON0)).otherwise(lon), F.degrees(lat)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = GRS80_A
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


# Fixed values: (longitude and latitude of the origin, scale, false easting and northing) of grids in use.
TRANSVERSE_GRIDS = {
    25829: (-9.0, 0.0, 0.9996, 500_000.0, 0.0),
    6679: (140.25, 44.0, 0.9999, 0.0, 0.0),
}
# Fixed values: (longitude and latitude of the origin, two standard parallels) of the equal-area conic grid in use.
CONIC_GRIDS = {9473: (132.0, 0.0, -18.0, -36.0)}

_N = GRS80_F / (2 - GRS80_F)
_RADIUS = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series in the third flattening, up to its fourth power
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def _conformal(lat: Column) -> Column:
    """Tangent of the conformal latitude."""
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.lit(ECC) * F.atanh(F.lit(ECC) * s))


def _northing_of(lat: float) -> float:
    """Length of the meridian from the equator in units of the rectifying radius."""
    s = math.sin(math.radians(lat))
    xi = math.atan(math.sinh(math.atanh(s) - ECC * math.atanh(ECC * s)))
    return xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(_ALPHA))


def transverse_mercator(lon: Column, lat: Column, lon0: float, lat0: float, scale: float, fe: float, fn: float) -> tuple[Column, Column]:
    t, dl = _conformal(lat), F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA):
        m = 2 * (k + 1)
        y = y + a * F.sin(m * xi) * F.cosh(m * eta)
        x = x + a * F.cos(m * xi) * F.sinh(m * eta)
    return fe + scale * _RADIUS * x, fn + scale * _RADIUS * (y - _northing_of(lat0))


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, lat0: float, scale: float, fe: float, fn: float) -> tuple[Column, Column]:
    xi, eta = (y - fn) / (scale * _RADIUS) + _northing_of(lat0), (x - fe) / (scale * _RADIUS)
    u, v = xi, eta
    for k, b in enumerate(_BETA):
        m = 2 * (k + 1)
        u = u - b * F.sin(m * xi) * F.cosh(m * eta)
        v = v - b * F.cos(m * xi) * F.sinh(m * eta)
    conformal = F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u))
    # a fixed number of steps from the conformal to the geographic latitude, each a hundred times nearer
    s = F.sin(F.atan(conformal))
    for _ in range(6):
        s = F.tanh(F.asinh(conformal) + F.lit(ECC) * F.atanh(F.lit(ECC) * s))
    return lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(F.asin(s))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Northern UTM zone on GRS80."""
    return transverse_mercator(lon, lat, 6.0 * zone - 183.0, 0.0, 0.9996, 500_000.0, 0.0)


def _q_col(s: Column) -> Column:
    return F.lit(1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / F.lit(2 * ECC))


def _lat_of_q(q: Column) -> Column:
    """Latitude in degrees from the authalic q."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / F.lit(QP))))
    e4, e6 = E2 * E2, E2 * E2 * E2
    return F.degrees(
        beta
        + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )


def _m(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - E2 * s * s)


def _conic(lat0: float, lat1: float, lat2: float) -> tuple[float, float, float]:
    q0, q1, q2 = (_q(math.sin(math.radians(v))) for v in (lat0, lat1, lat2))
    n = (_m(lat1) ** 2 - _m(lat2) ** 2) / (q2 - q1)
    c = _m(lat1) ** 2 + n * q1
    return n, c, GRS80_A * math.sqrt(c - n * q0) / n


def equal_area_conic(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    n, c, rho0 = _conic(lat0, lat1, lat2)
    rho = GRS80_A * F.sqrt(c - n * _q_col(F.sin(F.radians(lat)))) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def equal_area_conic_inverse(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    n, c, rho0 = _conic(lat0, lat1, lat2)
    side = math.copysign(1.0, n)
    rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    theta = F.atan2(side * x, side * (rho0 - y))
    q = (c - (rho * n / GRS80_A) * (rho * n / GRS80_A)) / n
    return lon0 + F.degrees(theta / n), _lat_of_q(q)


def equal_area_cylindrical(lon: Column, lat: Column, lon0: float = 0.0, lat_ts: float = 0.0) -> tuple[Column, Column]:
    k = _m(lat_ts)
    return GRS80_A * k * F.radians(lon - lon0), GRS80_A * _q_col(F.sin(F.radians(lat))) / (2 * k)


def equal_area_cylindrical_inverse(x: Column, y: Column, lon0: float = 0.0, lat_ts: float = 0.0) -> tuple[Column, Column]:
    k = _m(lat_ts)
    return lon0 + F.degrees(x / (GRS80_A * k)), _lat_of_q(2 * k * y / GRS80_A)


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """To the grid of an EPSG code: 3035, 3857, northern UTM on ETRS89 (258xx) and the grids listed above."""
    if epsg == 3035:
        return laea(lon, lat)
    if epsg == 3857:
        return web_mercator(lon, lat)
    if epsg in TRANSVERSE_GRIDS:
        return transverse_mercator(lon, lat, *TRANSVERSE_GRIDS[epsg])
    if epsg in CONIC_GRIDS:
        return equal_area_conic(lon, lat, *CONIC_GRIDS[epsg])
    if 25828 <= epsg <= 25838:
        return utm(lon, lat, epsg - 25800)
    raise ValueError(f"no projection for EPSG {epsg}")
