import math

import pytest
from pyspark.sql import functions as F

from footpath.functions import geo


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_distances_and_bearings(spark):
    a, b, c, d = values(spark, geo.haversine(*lit(0, 0, 0, 1)), geo.haversine(*lit(37.75, -122.45, 37.75, -122.4489)), geo.bearing(*lit(37.75, -122.45, 37.75, -122.4489)), geo.bearing(*lit(37.75, -122.4489, 37.7491, -122.4489)))
    assert a == pytest.approx(111194.92664455874, abs=1e-6)
    assert b == pytest.approx(96.71273606632545, abs=1e-6)
    assert c == pytest.approx(89.99966328043502, abs=1e-9)
    assert d == pytest.approx(180.0)


def test_bearing_is_below_360(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0, -1e-18), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    for r in rows.select(geo.bearing("a", "b", "c", "d").alias("x")).collect():
        assert 0 <= r.x < 360


@pytest.mark.parametrize(
    ("angle", "turn"),
    [(0, "straight"), (14.999, "straight"), (15, "slight_right"), (-15, "slight_left"), (45, "right"), (-45, "left"), (119.999, "right"), (120, "sharp_right"), (-120, "sharp_left"), (159.999, "sharp_right"), (160, "u_turn"), (-160, "u_turn"), (180, "u_turn")],
)
def test_turns(spark, angle, turn):
    assert values(spark, geo.classify_turn(F.lit(float(angle)))) == [turn]


def test_signed_angles(spark):
    got = values(spark, *(geo.signed_angle(F.lit(float(a - b))) for a, b in ((10, 350), (350, 10), (180, 0), (0, 180))))
    assert got == [20, -20, 180, -180]


def test_compass(spark):
    got = values(spark, *(geo.compass(F.lit(float(x))) for x in (0, 22.4, 22.5, 90, 180, 270, 337.4, 337.5)))
    assert got == ["north", "north", "northeast", "east", "south", "west", "northwest", "north"]


def test_names(spark):
    got = values(spark, geo.effective_name(F.lit(""), F.lit("steps")), geo.effective_name(F.lit(None).cast("string"), F.lit("other")), geo.effective_name(F.lit("Oak"), F.lit("steps")))
    assert got == ["steps", "road", "Oak"]


def test_parse_latlon(spark):
    got = values(spark, *(geo.parse_latlon(F.lit(t)) for t in (" 37.5 , -122 ", "37.5,-122,9", "x,1", "37.5")))
    assert tuple(got[0]) == (37.5, -122.0) and tuple(got[1]) == (37.5, -122.0) and got[2] is None and got[3] is None


def test_small_formulas(spark):
    minutes, share, none, text, missing, wide = values(spark, geo.walk_minutes(F.lit(5000.0)), geo.overhead_for_extra_minutes(F.lit(10), F.lit(8400.0)), geo.overhead_for_extra_minutes(F.lit(10), F.lit(0.0)), geo.metres_text(F.lit(12.6)), geo.metres_text(F.lit(None).cast("double")), geo.padded(F.lit("ab"), 4))
    assert minutes == pytest.approx(60) and share == pytest.approx(0.1) and none == 0
    assert (text, missing, wide) == ("13m", "N/A", "ab  ")
    north, east = values(spark, *geo.project(F.lit(37.0), F.lit(-122.0), F.lit(37.0)))
    assert north == pytest.approx(math.radians(37) * 6371000) and east == pytest.approx(math.radians(-122) * 6371000 * math.cos(math.radians(37)))
