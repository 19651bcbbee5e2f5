"""Scalar helpers: physics, units, colours, stretches, local coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Speed of light, Planck and Boltzmann constants as the radiance tables use them.
LIGHT = 299792458.0
PLANCK = 6.6260755e-34
BOLTZMANN = 1.380658e-23

# Fixed value: km per degree of latitude.
KM_PER_DEGREE = 111.32

_C1 = 2 * PLANCK * LIGHT * LIGHT
_C2 = PLANCK * LIGHT / BOLTZMANN


def radiance(wavelength_um: Column, kelvin: Column) -> Column:
    """Planck radiance in W/(m2 sr um); 0 for 0 K."""
    w = wavelength_um * 1e-6
    return F.when(kelvin == 0, F.lit(0.0)).otherwise(F.lit(_C1) / (F.pow(w, F.lit(5.0)) * (F.exp(F.lit(_C2) / (w * kelvin)) - 1)) * 1e-6)


def brightness(wavelength_um: Column, rad: Column) -> Column:
    """Brightness temperature in K; 0 for no radiance."""
    w = wavelength_um * 1e-6
    return F.when(rad == 0, F.lit(0.0)).otherwise(F.lit(_C2) / (w * F.log(F.lit(_C1) / (F.pow(w, F.lit(5.0)) * rad * 1e6) + 1)))


def fine_fuel_moisture(code: Column) -> Column:
    """Fine-fuel code to moisture in percent."""
    return 147.2 * (101 - code) / (59.5 + code)


def dms(value: Column) -> Column:
    """Decimal degrees to degrees, minutes and seconds."""
    a = F.abs(value)
    d = F.floor(a).cast("int")
    full = (a - d) * 60
    m = F.floor(full).cast("int")
    return F.struct(F.when(value < 0, -d).otherwise(d).alias("d"), m.alias("m"), F.round((full - m) * 60, 2).alias("s"))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def half_side_box(lon: Column, lat: Column, km: float) -> Column:
    """Degrees box of a half side in km around a point."""
    dlat = km / KM_PER_DEGREE
    dlon = F.lit(km) / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def quarter_tile(value: Column) -> Column:
    """Nearest quarter degree, half to even."""
    return F.rint(value * 4) / 4


def local_to_lonlat(x: Column, y: Column, wsen: tuple, lbrt: tuple) -> tuple[Column, Column]:
    (w, s, e, n), (l, b, r, t) = wsen, lbrt
    return w + (x - l) / (r - l) * (e - w), s + (y - b) / (t - b) * (n - s)


def lonlat_to_local(lon: Column, lat: Column, wsen: tuple, lbrt: tuple) -> tuple[Column, Column]:
    (w, s, e, n), (l, b, r, t) = wsen, lbrt
    return l + (lon - w) / (e - w) * (r - l), b + (lat - s) / (n - s) * (t - b)


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """16-bit to 8-bit: below `low` 0, from `high` on 255, linear between."""
    inside = F.floor((value - low) * F.lit(255.0) / (high - low - 1))
    return F.when(value < low, 0).when(value >= high, 255).otherwise(inside).cast("int")


def stretch(value: Column, low: Column, high: Column, how: str = "linear") -> Column:
    """Clip to [low, high], scale to 0..1 (linear or square root), times 256 as a byte."""
    v = F.least(F.greatest(value, low), high) - low
    share = v / (high - low) if how == "linear" else F.sqrt(v) / F.sqrt(high - low)
    return F.pmod(F.floor(256 * share), F.lit(256)).cast("int")


def midpoint(a: Column, b: Column) -> Column:
    ua, ub = F.unix_micros(a.cast("timestamp")), F.unix_micros(b.cast("timestamp"))
    return F.timestamp_micros(ua + F.floor((ub - ua) / 2).cast("long"))
