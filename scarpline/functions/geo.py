"""Coordinates, raster grids and great-circle geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from scarpline.functions.rounding import round_exact

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111000.0


@dataclass(frozen=True)
class Grid:
    """North-up raster geometry: origin at the upper left corner."""

    min_x: float
    max_y: float
    pixel: float
    width: int
    height: int
    nodata: float = -9999.0

    @property
    def cells(self) -> int:
        return self.width * self.height

    def row_of(self, lat: Column) -> Column:
        return F.floor((F.lit(self.max_y) - lat) / F.lit(self.pixel)).cast("int")

    def col_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.min_x)) / F.lit(self.pixel)).cast("int")

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)


def valid_lat(c: Column) -> Column:
    return F.coalesce(c.between(-90.0, 90.0), F.lit(False))


def valid_lon(c: Column) -> Column:
    return F.coalesce(c.between(-180.0, 180.0), F.lit(False))


def point(lon: Column, lat: Column) -> Column:
    """GeoJSON point: longitude is X and comes first."""
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / F.lit(2.0)
    dlon = F.radians(lon2 - lon1) / F.lit(2.0)
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def metres_to_leg(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of a point to the leg between two places, a straight line of longitude and latitude.

    The nearest place of the leg is found in the plane that touches the earth
    at the point.
    """
    flat = F.cos(F.radians(lat))
    dx, dy = (lon2 - lon1) * flat, lat2 - lat1
    along = (lon - lon1) * flat * dx + (lat - lat1) * dy
    whole = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(whole > 0, along / whole).otherwise(0.0)))
    nearest = haversine_m(lat, lon, lat1 + t * (lat2 - lat1), lon1 + t * (lon2 - lon1))
    return F.least(nearest, haversine_m(lat, lon, lat1, lon1), haversine_m(lat, lon, lat2, lon2))


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd test against all rings of a polygon: inside the outline and in no hole."""
    return F.size(F.filter(rings, lambda ring: in_ring(lon, lat, ring))) % 2 == 1


def leg_meets_rings(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rings: Column) -> Column:
    """Whether a leg touches or crosses an edge of any ring."""

    def turn(ax, ay, bx, by, cx, cy) -> Column:
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def meets(ring: Column, i: Column) -> Column:
        x3, y3 = ring[i][0], ring[i][1]
        x4, y4 = ring[i + 1][0], ring[i + 1][1]
        apart = (
            (F.greatest(lon1, lon2) < F.least(x3, x4)) | (F.greatest(x3, x4) < F.least(lon1, lon2))
            | (F.greatest(lat1, lat2) < F.least(y3, y4)) | (F.greatest(y3, y4) < F.least(lat1, lat2))
        )
        one = F.signum(turn(x3, y3, x4, y4, lon1, lat1)) * F.signum(turn(x3, y3, x4, y4, lon2, lat2))
        two = F.signum(turn(lon1, lat1, lon2, lat2, x3, y3)) * F.signum(turn(lon1, lat1, lon2, lat2, x4, y4))
        return ~apart & (one <= 0) & (two <= 0)

    edges = lambda ring: F.sequence(F.lit(0), F.size(ring) - 2)
    return F.exists(rings, lambda ring: (F.size(ring) >= 4) & F.exists(edges(ring), lambda i: meets(ring, i)))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ``array<array<double>>`` ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        x1, y1 = F.element_at(F.element_at(ring, i), 1), F.element_at(F.element_at(ring, i), 2)
        x2, y2 = F.element_at(F.element_at(ring, i + 1), 1), F.element_at(F.element_at(ring, i + 1), 2)
        spans = (y1 > lat) != (y2 > lat)
        at = (x2 - x1) * (lat - y1) / F.when(y2 != y1, y2 - y1) + x1
        return F.when(spans & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.when(n < 4, F.lit(False)).otherwise(hits % 2 == 1)


def rounded_key(lat: Column, lon: Column, digits: int = 4) -> list[Column]:
    """Grid key of a coordinate: both values rounded to a few decimals."""
    return [round_exact(lat, digits).alias("lat_key"), round_exact(lon, digits).alias("lon_key")]
