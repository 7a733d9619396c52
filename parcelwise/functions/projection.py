"""Albers equal-area conic coordinates as column expressions, forward and inverse, on any ellipsoid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_turns(latitude: Column) -> Column:
    """How often a latitude has passed a pole, southward less than 0: 0 from -90 to below 90."""
    return F.floor((latitude + 90) / 180)


def unfolded(latitude: Column, turns: Column) -> Column:
    """A latitude on the globe as the one that has passed poles so often; a projection sees the sine only and tells them apart no more."""
    return 180 * turns + F.when(turns % 2 == 0, latitude).otherwise(-latitude)


@dataclass(frozen=True)
class Albers:
    """A projection by its standard parallels, origin and offsets in degrees and metres; the ellipsoid by its greater half-axis and flattening (a sphere: 0)."""

    first: float = 29.5
    second: float = 45.5
    latitude: float = 23.0
    longitude: float = -96.0
    x_0: float = 0.0
    y_0: float = 0.0
    axis: float = 6378137.0
    flattening: float = 1 / 298.257222101

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _q(self, phi: float) -> float:
        e, s = self.eccentricity, math.sin(phi)
        return 2 * s if e == 0 else (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)

    @property
    def constants(self) -> tuple[float, float, float]:
        """(n, C, rho of the origin) of the cone."""
        one, two, origin = map(math.radians, (self.first, self.second, self.latitude))
        m = lambda phi: math.cos(phi) / math.sqrt(1 - (self.eccentricity * math.sin(phi)) ** 2)
        q1, q2 = self._q(one), self._q(two)
        n = math.sin(one) if abs(one - two) < 1e-12 else (m(one) ** 2 - m(two) ** 2) / (q2 - q1)
        c = m(one) ** 2 + n * q1
        return n, c, self.axis * math.sqrt(c - n * self._q(origin)) / n

    def forward(self, longitude: Column, latitude: Column) -> tuple[Column, Column]:
        """(x, y) in metres of degrees; null of null."""
        n, c, rho_0 = self.constants
        e, s = self.eccentricity, F.sin(F.radians(latitude))
        q = 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
        rho = self.axis * F.sqrt(c - n * q) / n
        theta = n * F.radians(longitude - self.longitude)
        return self.x_0 + rho * F.sin(theta), self.y_0 + rho_0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(longitude, latitude) in degrees of metres: the latitude of equal area, whose series in the eccentricity gives the geodetic one, and a Newton step against the rest of the series."""
        n, c, rho_0 = self.constants
        sign = 1.0 if n > 0 else -1.0
        east, north = x - self.x_0, rho_0 - (y - self.y_0)
        rho = F.sqrt(east * east + north * north)
        theta = F.atan2(sign * east, sign * north)
        q = (c - (rho * n / self.axis) * (rho * n / self.axis)) / n
        e, e2 = self.eccentricity, self.eccentricity**2
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(math.pi / 2))))
        series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
        phi = beta + sum((k * F.sin(2 * (i + 1) * beta) for i, k in enumerate(series)), F.lit(0.0))
        if e:
            s = F.sin(phi)
            own = (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)
            slope = 2 * (1 - e2) * F.cos(phi) / ((1 - e2 * s * s) * (1 - e2 * s * s))
            phi = phi + F.when(F.abs(slope) > 1e-9, (q - own) / slope).otherwise(0.0)
        return self.longitude + F.degrees(theta / n), F.degrees(phi)
