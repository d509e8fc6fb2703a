"""Column expressions against their boundary tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from kerbstat.functions import clock, place, text

HOURS = [
    # text, strict, lenient
    ("0932A", 9, 9), ("0932P", 21, 21), ("1200A", 0, 0), ("1259P", 12, 12), ("0000A", 0, 0), ("0032P", 12, 12),
    ("1332P", 25, None), ("1432", None, 14), ("2359", None, 23), ("0932", None, 9), ("2400", None, None),
    ("2459", None, None), ("abc", None, None), ("12A", None, None), ("", None, None), (None, None, None),
    ("1", None, None), (" 0932a ", None, 9), ("\t0932p", None, 21), ("0932A\n", None, 9), ("9 32P", None, 21),
    ("+932A", None, 9), ("-132P", None, 11), ("09:32A", None, 9), ("1130 PM", None, 11), ("0932AM", None, 9),
    ("99XXA", None, None), ("9x32A", None, None), ("1.32P", None, None), (" 0932A", None, 9),
]


def test_hours(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in HOURS], "t string")
    out = clock.add_lenient_hour(df, "t", "lenient").select("t", clock.strict_hour(F.col("t")), "lenient")
    assert [tuple(r) for r in out.collect()] == HOURS


def test_time_of_day(spark):
    cases = {0: "night", 6: "night", 7: "morning", 12: "morning", 13: "afternoon", 17: "afternoon",
             18: "evening", 21: "evening", 22: "late_night", 23: "late_night", None: None}
    df = spark.createDataFrame([(h,) for h in cases], "h int")
    assert {r[0]: r[1] for r in df.select("h", clock.time_of_day(F.col("h"))).collect()} == cases


def test_days(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 8)], "d string").select(
        clock.as_date(F.col("d")).alias("d")
    )
    dow = clock.dow_from_monday(F.col("d"))
    rows = df.select(
        clock.dow_from_sunday(F.col("d")), dow, clock.is_weekend(dow), clock.is_sweeping_day(dow),
        *[clock.is_rush_hour(dow, F.lit(h)) for h in (6, 7, 9, 10, 15, 16, 19, 20)],
        clock.is_rush_hour(dow, F.lit(None).cast("int")),
    ).collect()
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6, 0]
    assert [r[1] for r in rows] == [0, 1, 2, 3, 4, 5, 6]
    assert [r[2] for r in rows] == [0, 0, 0, 0, 0, 1, 1]
    assert [r[3] for r in rows] == [1, 1, 0, 1, 1, 0, 0]
    assert [tuple(r[4:]) for r in rows] == [(0, 1, 1, 0, 0, 1, 1, 0, 0)] * 5 + [(0,) * 9] * 2


def test_bad_date_is_null(spark):
    df = spark.createDataFrame([("2024-02-30",), ("soon",), ("2024-02-29",)], "d string")
    got = [r[0] for r in df.select(clock.as_date(F.col("d")).cast("string")).collect()]
    assert got == [None, None, "2024-02-29"]


@pytest.mark.parametrize(
    "code,name",
    [("ny", "Manhattan"), (" MN ", "Manhattan"), ("NEW Y", "Manhattan"), ("KINGS", "Brooklyn"), ("qn ", "Queens"),
     ("BX", "Bronx"), ("ST", "Staten Island"), ("XX", "Unknown"), (None, "Unknown"), ("\tk\n", "Brooklyn")],
)
def test_borough(spark, code, name):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(place.borough(F.col("c"))).first()[0] == name


def test_words_strip_and_plates(spark):
    df = spark.createDataFrame([("MAIN ST",), ("STATE",), ("5 AVENUE",), (None,)], "s string")
    got = [tuple(r) for r in df.select(
        text.has_word(F.col("s"), "ST", "STREET"), text.has_word(F.col("s"), "AVE", "AVENUE")
    ).collect()]
    assert got == [(1, 0), (0, 0), (0, 1), (0, 0)]
    plates = spark.createDataFrame([("pas",), ("omt ",), ("APP",), (None,)], "p string")
    assert [r[0] for r in plates.select(place.plate_group(text.upper_strip(F.col("p")))).collect()] == [
        "PAS", "OMT", "OTHER", "OTHER"
    ]
    assert spark.range(1).select(text.strip(F.lit("  a b \r\n"))).first()[0] == "a b"


def test_grids(spark):
    df = spark.createDataFrame([(2.5 / 200, 40.5005), (3.5 / 200, -74.2005), (None, None)], "a double, b double")
    rows = df.select(place.cell_edge(F.col("a")), place.risk_grid(F.col("b")),
                     place.cell_id(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [0.01, 0.02, None]
    assert [r[1] for r in rows] == [40.501, -74.201, None]
    assert rows[2][2] is None


def test_feature_frame_is_compiled_in_small_methods(spark, conf, capsys):
    """HotSpot compiles methods of 8000 bytes at most, whatever Spark's own limit is set to."""
    conf("spark.sql.adaptive.enabled", "false")  # else a plan with a shuffle has no code yet
    QUERIES["features_final"](spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 6000


def test_hours_do_not_touch_other_columns(spark):
    df = spark.createDataFrame([(None, 1), ("1130P", 2), ("1130P", 2)], "t string, _number int")
    out = clock.add_lenient_hour(df, "t")
    assert out.columns == ["t", "_number", "hour"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1130P", 2, 23), ("1130P", 2, 23), (None, 1, None)]
