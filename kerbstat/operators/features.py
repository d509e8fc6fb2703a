"""The feature frame: temporal, location and violation columns, cleaning, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbstat.functions import clock, place
from kerbstat.functions.text import flag, has_word, strip, upper_strip
from kerbstat.operators.scan import training_load
from kerbstat.schema import CODE, COLUMN_ROLES, DATE, FINE, UNKNOWN

DEFAULT_HOUR = 12


def add_temporal(df: DataFrame) -> DataFrame:
    """Calendar parts, lenient hour, part of the day and the day and hour flags."""
    day, dow, hour = F.col(DATE), F.col("day_of_week"), F.col("hour")
    return (
        clock.add_lenient_hour(df.withColumn(DATE, clock.as_date(day)), "violation_time")
        .withColumns(
            {
                "year": F.year(day),
                "month": F.month(day),
                "day_of_week": clock.dow_from_monday(day),
                "day_of_month": F.dayofmonth(day),
                "week_of_year": F.weekofyear(day),
                "time_of_day": clock.time_of_day(hour),
            }
        )
        .withColumns(
            {
                "is_weekend": clock.is_weekend(dow),
                "is_rush_hour": clock.is_rush_hour(dow, hour),
                "is_asp_day": clock.is_sweeping_day(dow),
            }
        )
    )


def add_location(df: DataFrame, with_coordinates: bool = False) -> DataFrame:
    """Borough, cleaned precinct and street, street kind flags; with coordinates, the grid cell."""
    street = F.col("street_name_clean")
    out = df.withColumns(
        {
            "borough": place.borough(F.col("county")),
            "precinct_clean": strip(F.col("precinct")),
            "street_name_clean": upper_strip(F.col("street_name")),
        }
    ).withColumns(
        {
            "is_avenue": has_word(street, "AVE", "AVENUE"),
            "is_street": has_word(street, "ST", "STREET"),
            "is_broadway": has_word(street, "BROADWAY"),
        }
    )
    if not with_coordinates:
        return out
    return out.withColumns(
        {
            "lat_grid": place.cell_edge(F.col("latitude")),
            "lon_grid": place.cell_edge(F.col("longitude")),
        }
    ).withColumn("location_cell", place.cell_id(F.col("lat_grid"), F.col("lon_grid")))


def add_violation(df: DataFrame) -> DataFrame:
    """Cleaned code and agency, fine and whether there is one, plate type and its group."""
    return df.withColumns(
        {
            "violation_code_clean": strip(F.col(CODE)),
            "agency": F.coalesce(upper_strip(F.col("issuing_agency")), F.lit(UNKNOWN)),
            "has_fine": flag(F.col(FINE).isNotNull()),
            "fine_amount_clean": F.coalesce(F.col(FINE).cast("double"), F.lit(0.0)),
            "plate_type_clean": upper_strip(F.col("plate_type")),
        }
    ).withColumn("plate_type_grouped", place.plate_group(F.col("plate_type_clean")))


def clean(df: DataFrame, required: tuple[str, ...] = (DATE, CODE)) -> DataFrame:
    """Drop rows without the required columns and fill what is unknown.

    The hour is filled after ``time_of_day`` and ``is_rush_hour`` were taken from it, so a row
    with an unreadable time has hour 12, no part of the day and no rush hour.
    """
    return df.dropna(subset=list(required)).withColumns(
        {
            "hour": F.coalesce(F.col("hour"), F.lit(DEFAULT_HOUR)),
            "precinct_clean": F.coalesce(F.col("precinct_clean"), F.lit(UNKNOWN)),
            "agency": F.coalesce(F.col("agency"), F.lit(UNKNOWN)),
        }
    )


def build_features(df: DataFrame, with_coordinates: bool = False) -> DataFrame:
    """All feature steps over a training load."""
    return (
        df.transform(add_temporal)
        .transform(add_location, with_coordinates)
        .transform(add_violation)
        .transform(clean)
    )


def load_features(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    sample: float | None = None,
    include_coordinates: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Training load and all feature steps."""
    rows = training_load(df, start, end, sample=sample, include_coordinates=include_coordinates, seed=seed)
    return build_features(rows, include_coordinates)


def feature_columns(available: list[str], target: str = CODE) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns that are present and not the target."""

    def usable(role: str) -> list[str]:
        return [c for c in COLUMN_ROLES[role] if c != target and c in available]

    return usable("numeric"), usable("categorical")


def training_frame(df: DataFrame, target: str = CODE) -> DataFrame:
    """Id, features and target of a feature frame."""
    numeric, categorical = feature_columns(df.columns, target)
    return df.select(*COLUMN_ROLES["id_columns"], *numeric, *categorical, target)
