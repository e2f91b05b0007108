"""Geographic column expressions, in degrees and metres on WGS84."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius; eccentricity, scaled rectifying radius and series of the transverse Mercator
# projection for WGS84; central meridian and false easting of zone 37 north.
RADIUS = 6_371_008.8
ECCENTRICITY = 0.08181919084262149
RECTIFYING = 0.9996 * 6367449.145823415
SERIES = (0.0008377318188192541, 7.608496958699166e-07, 1.2034877875966646e-09)
MERIDIAN, EASTING = 39.0, 500_000.0
#: Third flattening, and the series back from the plane by its powers.
THIRD = (1 - math.sqrt(1 - ECCENTRICITY**2)) / (1 + math.sqrt(1 - ECCENTRICITY**2))
BACK = (
    THIRD / 2 - 2 * THIRD**2 / 3 + 37 * THIRD**3 / 96 - THIRD**4 / 360, THIRD**2 / 48 + THIRD**3 / 15 - 437 * THIRD**4 / 1440,
    17 * THIRD**3 / 480 - 37 * THIRD**4 / 840, 4397 * THIRD**4 / 161280,
)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """In range and not the (0, 0) placeholder; null and NaN are invalid."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance. Callers filter to valid coordinates first."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def utm37(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in zone 37 north, by a third-order Krüger series."""
    p, l, c = F.radians(lat), F.radians(lon - MERIDIAN), F.lit(ECCENTRICITY)
    t = F.sinh(F.atanh(F.sin(p)) - c * F.atanh(c * F.sin(p)))
    x, e = F.atan(t / F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    east, north = e, x
    for j, a in enumerate(SERIES, 1):
        east = east + a * F.cos(2 * j * x) * F.sinh(2 * j * e)
        north = north + a * F.sin(2 * j * x) * F.cosh(2 * j * e)
    return EASTING + RECTIFYING * east, RECTIFYING * north


def from_utm37(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a place in zone 37 north: the inverse series, then the latitude by a few fixed-point steps."""
    y, x = north / RECTIFYING, (east - EASTING) / RECTIFYING
    up, out = y, x
    for j, b in enumerate(BACK, 1):
        up = up - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        out = out - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    conformal = F.sin(up) / F.cosh(out)
    isometric, sine = F.atanh(conformal), conformal
    for _ in range(6):  # each step leaves a hundred-and-fiftieth of the error
        sine = F.tanh(isometric + ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    return F.degrees(F.asin(sine)), MERIDIAN + F.degrees(F.atan2(F.sinh(out), F.cos(up)))


def grid_cell(lat: Column, lon: Column, size: int = 5000) -> Column:
    """Name of the 5 km cell; invalid coordinates have a name of their own."""
    east, north = utm37(lat, lon)
    name = F.concat(F.lit("utm37_5km_"), F.floor(east / size).cast("string"), F.lit("_"), F.floor(north / size).cast("string"))
    return F.when(valid_coordinates(lat, lon), name).otherwise("invalid_coordinate")
