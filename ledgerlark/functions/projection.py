"""N-34: WGS84 and the British national grid, as column expressions.

The transverse Mercator projection is Krueger's series to the fourth order;
the datum shift is a seven-parameter transformation between the ellipsoids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def n(self) -> float:
        return (self.a - self.b) / (self.a + self.b)

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2


# Ellipsoids, the grid's origin and the published datum shift (metres, parts per million, arc seconds). Fixed values.
AIRY, WGS84 = Ellipsoid(6377563.396, 6356256.909), Ellipsoid(6378137.0, 6356752.3141)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
SHIFT, PPM, TURN = (-446.448, 125.157, -542.060), 20.4894, (-0.1502, -0.2470, -0.8421)


def _series(n: float) -> tuple[float, list[float], list[float]]:
    """The rectifying radius over a, and the coefficients to and from the sphere."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, to, back


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _conformal(lat: Column, e: float) -> Column:
    """The tangent of the conformal latitude."""
    return F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))


def _origin_arc() -> float:
    """The northing of the grid's origin before its false northing."""
    import math

    radius, to, _ = _series(AIRY.n)
    lat, e = math.radians(LAT0), math.sqrt(AIRY.e2)
    xi = math.atan(math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))))
    return SCALE * AIRY.a * radius * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(to)))


def project(lat: Column, lon: Column) -> Column:
    """Latitude and longitude on the grid's ellipsoid (radians) to a struct of easting, northing."""
    radius, to, _ = _series(AIRY.n)
    t, dl = _conformal(lat, AIRY.e2**0.5), lon - F.radians(F.lit(LON0))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    k = SCALE * AIRY.a * radius
    north = k * (xi + _sum([c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(to)]))
    east = k * (eta + _sum([c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(to)]))
    return F.struct((EAST0 + east).alias("e"), (NORTH0 + north - _origin_arc()).alias("n"))


def unproject(east: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing to latitude and longitude on the grid's ellipsoid (radians)."""
    radius, _, back = _series(AIRY.n)
    k = SCALE * AIRY.a * radius
    x, y = (north - NORTH0 + _origin_arc()) / k, (east - EAST0) / k
    xi = x - _sum([c * F.sin(2 * (j + 1) * x) * F.cosh(2 * (j + 1) * y) for j, c in enumerate(back)])
    eta = y - _sum([c * F.cos(2 * (j + 1) * x) * F.sinh(2 * (j + 1) * y) for j, c in enumerate(back)])
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    e = AIRY.e2**0.5
    # the conformal latitude back to the geodetic one by a few fixed steps
    lat = chi
    for _ in range(4):
        lat = F.asin(F.tanh(F.atanh(F.sin(chi)) + e * F.atanh(e * F.sin(lat))))
    return lat, F.radians(F.lit(LON0)) + F.atan2(F.sinh(eta), F.cos(xi))


def _shift(lat: Column, lon: Column, here: Ellipsoid, there: Ellipsoid, sign: int) -> tuple[Column, Column]:
    """Through earth-centred coordinates from one ellipsoid to the other."""
    import math

    nu = here.a / F.sqrt(1 - here.e2 * F.sin(lat) * F.sin(lat))
    x, y, z = nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), (1 - here.e2) * nu * F.sin(lat)
    (tx, ty, tz), s = (sign * t for t in SHIFT), 1 + sign * PPM * 1e-6
    rx, ry, rz = (sign * math.radians(r / 3600) for r in TURN)
    u, v, w = tx + s * x - rz * y + ry * z, ty + rz * x + s * y - rx * z, tz - ry * x + rx * y + s * z
    p = F.hypot(u, v)
    beta = F.atan2(w * there.a, p * there.b)  # Bowring's parametric start is exact to nanometres on the ground
    ep2 = there.e2 / (1 - there.e2)
    far = F.atan2(w + ep2 * there.b * F.pow(F.sin(beta), 3), p - there.e2 * there.a * F.pow(F.cos(beta), 3))
    return far, F.atan2(v, u)


def to_grid(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to a struct of easting, northing."""
    return project(*_shift(F.radians(lat), F.radians(lon), WGS84, AIRY, 1))


def from_grid(east: Column, north: Column) -> Column:
    """Easting, northing to a struct of WGS84 lon, lat in degrees."""
    lat, lon = _shift(*unproject(east, north), AIRY, WGS84, -1)
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))
