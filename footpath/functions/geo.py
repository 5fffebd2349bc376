"""Scalar functions as Column expressions; all run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between points in degrees."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * fixed.EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 inclusive to 360 exclusive."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    sector = (F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45.0) % 8).cast("int")
    return F.element_at(F.array(*map(F.lit, fixed.COMPASS)), sector + 1)


def signed_angle(angle: Column) -> Column:
    """A difference of two bearings in -180..180."""
    return F.when(angle > 180.0, angle - 360.0).when(angle < -180.0, angle + 360.0).otherwise(angle)


def classify_turn(angle: Column) -> Column:
    size, left = F.abs(angle), angle < 0
    side = lambda name: F.concat(F.lit(name), F.when(left, F.lit("left")).otherwise(F.lit("right")))
    return (
        F.when(size < 15, F.lit("straight")).when(size < 45, side("slight_")).when(size < 120, side("")).when(size < 160, side("sharp_")).otherwise(F.lit("u_turn"))
    )


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def turn_prefix(turn: Column) -> Column:
    return lookup(fixed.PREFIXES, turn)


def describe_highway(highway: Column) -> Column:
    return F.coalesce(lookup(fixed.DESCRIPTIONS, highway), F.lit("road"))


def effective_name(name: Column, highway: Column) -> Column:
    """The name, or else what the way's type is called."""
    return F.coalesce(F.nullif(name, F.lit("")), describe_highway(highway))


def instruction(turn: Column, first_bearing: Column, name: Column) -> Column:
    head = F.concat(F.lit("Head "), compass(first_bearing), F.lit(" on "), name)
    word = F.when(turn == "straight", F.lit(" on ")).otherwise(F.lit(" onto "))
    return F.when(turn == "start", head).when(turn == "arrive", F.lit("Arrive at destination")).otherwise(F.concat(turn_prefix(turn), word, name))


def project(lat: Column, lon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Equirectangular metres around a mean latitude: (northing, easting)."""
    r = F.lit(fixed.EARTH_RADIUS_M)
    return F.radians(lat) * r, F.radians(lon) * r * F.cos(F.radians(mean_lat))


def parse_latlon(text: Column) -> Column:
    """Struct lat, lon of "lat,lon"; further parts are ignored; null if it can't be read."""
    part = F.split(text, ",", -1)
    lat = F.trim(F.get(part, F.lit(0))).try_cast("double")
    lon = F.trim(F.get(part, F.lit(1))).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def metres_text(metres: Column) -> Column:
    """Whole metres, or N/A."""
    return F.when(metres.isNull(), F.lit("N/A")).otherwise(F.format_string("%.0fm", metres))


def padded(text: Column, width: int) -> Column:
    return F.rpad(text, width, " ")


def walk_minutes(metres: Column, metres_per_second: float = fixed.CLI_KMH / 3.6) -> Column:
    return metres / F.lit(metres_per_second) / 60.0


def overhead_for_extra_minutes(minutes: Column, metres: Column) -> Column:
    """Share of a route's length that so many more minutes allow."""
    return F.when(metres > 0, minutes * 60.0 * fixed.REPORT_MPS / metres).otherwise(F.lit(0.0))
