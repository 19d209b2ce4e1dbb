"""Distances on the earth."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8
# The WGS-84 ellipsoid.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere of mean radius; differs from the ellipsoid by 0.5 % at most."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Rounds of Vincenty's iteration; all but nearly opposite points need under ten.
ROUNDS = 30
#: Metres from pole to pole, the longest way between two points.
HALF_MERIDIAN = 20_003_931.4586


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the WGS-84 ellipsoid by Vincenty's inverse formula, as columns alone.

    The iteration is a fold over a fixed number of rounds that stops changing once it has converged. Nearly opposite points, where it
    doesn't, get the distance on the sphere, half a meridian at most; null coordinates give null, equal points 0.
    """
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    flat = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    turned = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    known = F.struct(F.sin(flat(lat1)).alias("s1"), F.cos(flat(lat1)).alias("c1"), F.sin(flat(lat2)).alias("s2"), F.cos(flat(lat2)).alias("c2"), F.radians(turned).alias("span"))

    def sides(k: Column, x: Column) -> tuple[Column, Column]:
        """Sine and cosine of the arc between the points if they are x apart on the auxiliary sphere."""
        across, along = k["c2"] * F.sin(x), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(x)
        return F.sqrt(across * across + along * along), k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(x)

    def parts(k: Column, x: Column) -> tuple[Column, Column, Column, Column, Column]:
        """Sine, cosine, sine of the azimuth at the equator, its cosine squared, cosine of twice the middle."""
        sine, cosine = sides(k, x)
        azimuth = F.when(sine == 0, 0.0).otherwise(k["c1"] * k["c2"] * F.sin(x) / F.when(sine != 0, sine))
        rest = 1 - azimuth * azimuth
        middle = F.when(rest == 0, 0.0).otherwise(cosine - 2 * k["s1"] * k["s2"] / F.when(rest != 0, rest))
        return sine, cosine, azimuth, rest, middle

    def bound(value: Column, then) -> Column:
        """`then` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def moved(k: Column, x: Column) -> Column:
        sine, cosine, azimuth, rest, middle = parts(k, x)
        told = F.struct(sine.alias("s"), cosine.alias("c"), azimuth.alias("a"), rest.alias("r"), middle.alias("m"))

        def new(p: Column) -> Column:
            c = f / 16 * p["r"] * (4 + f * (4 - 3 * p["r"]))
            return k["span"] + (1 - c) * f * p["a"] * (F.atan2(p["s"], p["c"]) + c * p["s"] * (p["m"] + c * p["c"] * (2 * p["m"] * p["m"] - 1)))

        return bound(told, new)

    def distance(k: Column, x: Column) -> Column:
        sine, cosine, _, rest, middle = parts(k, x)
        told = F.struct(sine.alias("s"), cosine.alias("c"), (rest * (WGS84_A**2 - b**2) / b**2).alias("u"), middle.alias("m"))

        def metres(p: Column) -> Column:
            u, m, s, c = p["u"], p["m"], p["s"], p["c"]
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            less = big_b * s * (m + big_b / 4 * (c * (2 * m * m - 1) - big_b / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
            return b * big_a * (F.atan2(s, c) - less)

        return bound(told, metres)

    def solved(k: Column) -> Column:
        begin = F.struct(k["span"].alias("x"), F.lit(False).alias("done"))

        def step(a: Column, _: Column) -> Column:
            return F.when(a["done"], a).otherwise(bound(moved(k, a["x"]), lambda new: F.struct(new.alias("x"), (F.abs(new - a["x"]) < 1e-12).alias("done"))))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step)
        return bound(found, lambda a: F.when(a["done"] & (F.abs(a["x"]) <= math.pi), distance(k, a["x"])))

    whole = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(whole, F.coalesce(bound(known, solved), F.least(haversine(lat1, lon1, lat2, lon2), F.lit(HALF_MERIDIAN))))
