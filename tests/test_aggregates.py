"""Grouping operators against brute force on tables where one group holds most rows."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from kerbstat.operators.aggregates import ROWS, exact_median, group_with_values, money_mean
from kerbstat.plans import views
from kerbstat.operators import stats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for _ in range(4000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        out.append((
            key,
            rng.choice(["1", "2", "3", "10", None]),
            rng.choice(["x", "y", "z", None]),
            None if rng.random() < 0.1 else Decimal(rng.randrange(1, 40)),
        ))
    return out + [("nulls", None, None, None)] * 3 + [("tie", "2", "x", Decimal(1)), ("tie", "10", "y", Decimal(2))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, w string, f decimal(10,2)").repartition(6)


def brute(rows):
    groups = {}
    for k, v, w, f in rows:
        groups.setdefault(k, []).append((v, w, f))
    out = {}
    for k, members in groups.items():
        counts = Counter(v for v, _, _ in members if v is not None)
        mode = min(counts, key=lambda v: (-counts[v], v)) if counts else None
        fines = [f for _, _, f in members if f is not None]
        out[k] = (
            len(members), len(counts), len({w for _, w, _ in members if w is not None}), mode,
            float(sum(fines)) / len(fines) if fines else None,
            min(fines) if fines else None, max(fines) if fines else None,
        )
    return out


def test_two_value_columns(frame, rows):
    grouped = group_with_values(
        frame, ["k"], {"dv": "v", "dw": "w"}, ("m", "v"),
        sums={"s": F.sum("f"), "n": F.count("f")}, lows={"lo": F.min("f")}, highs={"hi": F.max("f")},
    ).select("k", ROWS, "dv", "dw", "m", money_mean(F.col("s"), F.col("n")), "lo", "hi")
    assert {r[0]: tuple(r)[1:] for r in grouped.collect()} == brute(rows)


def test_one_value_column(frame, rows):
    grouped = group_with_values(frame, ["k"], {"dv": "v"}, ("m", "v")).select("k", ROWS, "dv", "m")
    want = {k: (t[0], t[1], t[3]) for k, t in brute(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in grouped.collect()} == want
    assert want["tie"] == (2, 2, "10") and want["nulls"] == (3, 0, None)


def test_exact_median(frame, rows):
    got = exact_median(frame.where("f IS NOT NULL"), ["k"], "f").select("k", ROWS, "_median").collect()
    fines = {}
    for k, _, _, f in rows:
        if f is not None:
            fines.setdefault(k, []).append(f)
    assert {r[0]: (r[1], r[2]) for r in got} == {k: (len(v), float(median(v))) for k, v in fines.items()}


def test_median_between_values(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 4, 9)], "f int").withColumn("k", F.lit("a"))
    assert exact_median(df, ["k"], "f").first()["_median"] == 3.0


def test_thresholds_are_parameters(citations):
    assert views.street_stats(citations, least=1).count() >= views.street_stats(citations, least=50).count()
    assert views.temporal_patterns(citations, least=1).agg(F.sum("ticket_count")).first()[0] == citations.where(
        "violation_time IS NOT NULL"
    ).count()


def test_orders(citations):
    counts = [r["ticket_count"] for r in stats.violation_summary(citations).collect()]
    assert counts == sorted(counts, reverse=True)
    slots = [(r[0], r[1]) for r in stats.temporal_distribution(citations).collect()]
    assert slots == sorted(slots, key=lambda s: tuple((v is None, v or 0) for v in s))
    top = stats.hotspots(citations, 5).collect()
    assert len(top) == 5 and top[0]["total_locations"] == stats.location_summary(citations).count()


def test_heatmap_filters(citations):
    points = stats.heatmap_points(citations, "1995-01-01", "1996-01-01", "3", limit=7)
    assert points.columns == ["latitude", "longitude", "violation_code", "point_count"]
    assert {r["point_count"] for r in points.collect()} == {points.count()}
    assert points.count() == 7 and points.where("violation_code <> '3'").count() == 0


def test_rows_are_shuffled_once(spark, citations, conf):
    """One exchange between the rows and the counts, one of the counts by group."""
    from kerbstat.plans.views import location_risk_scores

    conf("spark.sql.adaptive.enabled", "false")
    plan = location_risk_scores(citations)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("ordered", [2, 5, 1000])
def test_median_by_narrowed_ranges(spark, ordered):
    rng = random.Random(8)
    groups = {
        "even": [rng.random() for _ in range(400)], "odd": [rng.gauss(0, 1e6) for _ in range(401)], "skew": [2.0 ** rng.randrange(-40, 60) for _ in range(300)],
        "one": [7.0] * 50, "two": [1.0, 1e300], "far": [1.0] * 10 + [float(i) for i in range(2, 100)] + [1e18], None: [float(i % 90) for i in range(1000)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in exact_median(df, ["k"], "v", ordered=ordered).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k]["_median"] == pytest.approx(median(vs), rel=1e-12), k
        assert (got[k][ROWS], got[k]["_min"], got[k]["_max"]) == (len(vs), min(vs), max(vs))


def test_median_of_a_group_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") * F.col("id")).cast("decimal(20,2)").alias("v"))
    df = df.unionByName(spark.createDataFrame([("small", Decimal(3)), ("small", Decimal(4))], "k string, v decimal(20,2)"))
    got = {r["k"]: r["_median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {"hot": (499_999**2 + 500_000**2) / 2, "small": 3.5}
