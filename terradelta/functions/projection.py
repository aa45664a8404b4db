"""Map projections as column expressions: WGS84 longitude and latitude (degrees) to plane coordinates (metres).

Transverse Mercator by Krüger's series to the sixth order (Karney, 2011); Lambert azimuthal equal area and Albers conic
by Snyder's closed forms (1987). All are codegen-friendly arithmetic, with no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-major axis and flattening of WGS84 and GRS80.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)

# Krüger's coefficients alpha_1 to alpha_6, as polynomials in n (lowest power first, from n^j on).
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)


def utm_zone(epsg: int) -> tuple[int, bool]:
    """Zone number and whether it is north, of an EPSG code 326zz or 327zz."""
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG {epsg} is not a UTM zone")
    return epsg % 100, epsg < 32700


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    zone, north = utm_zone(epsg)
    a, f = WGS84
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    dlon, phi = F.radians(lon - F.lit(6.0 * zone - 183)), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi0, eta0 = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, row in enumerate(ALPHA, 1):
        c = F.lit(sum(x * n ** (j + k) for k, x in enumerate(row)))
        xi = xi + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return F.lit(500000.0) + F.lit(0.9996 * radius) * eta, F.lit(0.0 if north else 10000000.0) + F.lit(0.9996 * radius) * xi


def _q(phi: Column, e: float) -> Column:
    s = F.sin(phi)
    return F.lit(1 - e * e) * (s / (1 - F.lit(e * e) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))


def _q_number(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)


def to_laea_europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 3035: centre 52 N 10 E, false origin 4321000, 3210000."""
    a, f = GRS80
    e = math.sqrt(f * (2 - f))
    phi1 = math.radians(52.0)
    qp, q1 = _q_number(math.pi / 2, e), _q_number(phi1, e)
    beta1 = math.asin(q1 / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * math.cos(phi1) / math.sqrt(1 - (e * math.sin(phi1)) ** 2) / (rq * math.cos(beta1))
    dlon = F.radians(lon - F.lit(10.0))
    beta = F.asin(_q(F.radians(lat), e) / F.lit(qp))
    sb, cb = F.sin(beta), F.cos(beta)
    b = F.lit(rq) * F.sqrt(F.lit(2.0) / (1 + F.lit(math.sin(beta1)) * sb + F.lit(math.cos(beta1)) * cb * F.cos(dlon)))
    x = F.lit(4321000.0) + b * F.lit(d) * cb * F.sin(dlon)
    y = F.lit(3210000.0) + b / F.lit(d) * (F.lit(math.cos(beta1)) * sb - F.lit(math.sin(beta1)) * cb * F.cos(dlon))
    return x, y


def to_albers_conus(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 5070: parallels 29.5 and 45.5 N, origin 23 N 96 W."""
    a, f = GRS80
    e = math.sqrt(f * (2 - f))
    p1, p2, p0 = math.radians(29.5), math.radians(45.5), math.radians(23.0)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    n = (m(p1) ** 2 - m(p2) ** 2) / (_q_number(p2, e) - _q_number(p1, e))
    c = m(p1) ** 2 + n * _q_number(p1, e)
    rho0 = a * math.sqrt(c - n * _q_number(p0, e)) / n
    rho = F.lit(a / n) * F.sqrt(F.lit(c) - F.lit(n) * _q(F.radians(lat), e))
    theta = F.lit(n) * F.radians(lon + F.lit(96.0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3035:
        return to_laea_europe(lon, lat)
    if epsg == 5070:
        return to_albers_conus(lon, lat)
    return to_utm(lon, lat, epsg)
