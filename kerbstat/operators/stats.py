"""Statistics over the citation table, and their top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.functions.clock import dow_from_sunday, strict_hour
from kerbstat.operators.aggregates import ROWS, exact_median, money_mean
from kerbstat.operators.scan import in_dates, scan_points
from kerbstat.schema import CODE, DATE, FINE
from kerbstat.session import stage


def _descending(name: str, *ties: str) -> list[Column]:
    """Largest first, nulls before all; ties by the group's keys."""
    return [F.col(name).desc_nulls_first(), *[F.col(t).asc_nulls_last() for t in ties]]


VIOLATION = [CODE, "violation_desc"]
LOCATION = ["precinct", "county"]


def _by_violation(df: DataFrame) -> DataFrame:
    return df.groupBy(*VIOLATION).agg(
        F.count("*").alias("ticket_count"),
        F.countDistinct("precinct").alias("precinct_count"),
        money_mean(F.sum(FINE), F.count(FINE)).alias("avg_fine"),
        F.min(DATE).alias("first_ticket"),
        F.max(DATE).alias("last_ticket"),
    )


def _by_location(df: DataFrame) -> DataFrame:
    return df.groupBy(*LOCATION).agg(
        F.count("*").alias("ticket_count"),
        F.countDistinct(CODE).alias("violation_types"),
        money_mean(F.sum(FINE), F.count(FINE)).alias("avg_fine"),
        F.sum(FINE).alias("total_fines"),
    )


def violation_summary(df: DataFrame) -> DataFrame:
    """Citations, precincts, average fine and first and last date of each violation."""
    return _by_violation(df).orderBy(*_descending("ticket_count", *VIOLATION))


def location_summary(df: DataFrame) -> DataFrame:
    """Citations, violation codes and fines of each precinct and county."""
    return _by_location(df).orderBy(*_descending("ticket_count", *LOCATION))


def temporal_distribution(df: DataFrame) -> DataFrame:
    """Citations by day of the week (Sunday 0) and strict hour, where a time is given, and the number of slots."""
    slots = df.where(F.col("violation_time").isNotNull()).select(
        dow_from_sunday(F.col(DATE)).alias("day_of_week"),
        strict_hour(F.col("violation_time")).alias("hour_of_day"),
    )
    counts = slots.groupBy("day_of_week", "hour_of_day").agg(F.count("*").alias("ticket_count"))
    return with_total(counts, "total_slots").orderBy(
        F.col("day_of_week").asc_nulls_last(), F.col("hour_of_day").asc_nulls_last()
    )


def with_total(rows: DataFrame, total: str) -> DataFrame:
    """Add the number of rows of a small result, staged so that it is computed once."""
    rows = stage(rows, "rows")
    return rows.withColumn(total, F.lit(rows.count()))


def fine_distribution(df: DataFrame) -> DataFrame:
    """Smallest, average, largest and exact median fine of each violation."""
    fines = exact_median(df.where(F.col(FINE).isNotNull()), VIOLATION, FINE)
    return fines.select(
        *VIOLATION,
        F.col("_min").alias("min_fine"),
        money_mean(F.col("_total"), F.col(ROWS)).alias("avg_fine"),
        F.col("_max").alias("max_fine"),
        F.col("_median").alias("median_fine"),
        F.col(ROWS).alias("ticket_count"),
    ).orderBy(*_descending("avg_fine", *VIOLATION))


def _top(groups: DataFrame, keys: list[str], n: int, total: str) -> DataFrame:
    """The ``n`` largest groups, each with the number of all groups."""
    groups = stage(groups, "groups")
    largest = groups.orderBy(*_descending("ticket_count", *keys)).limit(n)
    return largest.withColumn(total, F.lit(groups.count()))


def top_violations(df: DataFrame, n: int = 50) -> DataFrame:
    return _top(_by_violation(df), VIOLATION, n, "total_count")


def hotspots(df: DataFrame, n: int = 50) -> DataFrame:
    return _top(_by_location(df), LOCATION, n, "total_locations")


def heatmap_points(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    violation_code: str | None = None,
    limit: int | None = 1000,
) -> DataFrame:
    """Points of citations in a date range, optionally of one violation; first ones by id, and their number."""
    rows = in_dates(df, start, end)
    if violation_code:
        rows = rows.where(F.col(CODE) == violation_code)
    return with_total(scan_points(rows, [CODE], limit=limit).select("latitude", "longitude", CODE), "point_count")


def class_counts(df: DataFrame, label: str = CODE) -> DataFrame:
    """Rows of each class, largest class first; rows without a class are left out."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("class_rows"))
        .orderBy(*_descending("class_rows", label))
    )


def class_total(df: DataFrame, label: str = CODE) -> DataFrame:
    """Number of distinct classes."""
    return df.agg(F.countDistinct(label).alias("classes"))
