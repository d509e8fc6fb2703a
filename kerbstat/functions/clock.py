"""Hours out of citation time text, and calendar parts.

Two readings of the time text exist side by side on purpose: statistics use the strict one,
features the lenient one. They also number the days of the week differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.functions.text import flag, upper_strip


def strict_hour(text: Column) -> Column:
    """Hour of exactly four digits and A or P; anything else is null.

    Twelve A is 0 and twelve P is 12; otherwise P adds 12, with no check of the range.
    """
    shaped = text.rlike(r"^[0-9]{4}[AP]\z")
    on_clock = F.substring(text, 1, 2).try_cast("int")
    base = F.when(on_clock == 12, 0).otherwise(on_clock)
    return F.when(shaped, base + F.when(text.endswith("P"), 12).otherwise(0)).cast("int")


def add_lenient_hour(df: DataFrame, text: str, hour: str = "hour") -> DataFrame:
    """Hour of the first two characters, shifted by a final A or P, null outside 0..23.

    Surrounding whitespace and case do not matter; at least four characters are needed; text
    with neither letter is read as a 24-hour clock. The steps are arguments of functions, so that
    each is worked out once per row. Spark compiles the projection with such functions apart from
    those above it and in small methods: together they go beyond the 8000 bytes up to which
    HotSpot compiles a method, and run several times slower.
    """

    def number(t: Column) -> Column:
        return F.when(F.length(t) >= 4, F.substring(t, 1, 2).try_cast("int"))

    def shifted(t: Column) -> Column:
        n, last = number(t), F.right(t, F.lit(1))
        return n + F.when((last == "P") & (n != 12), 12).when((last == "A") & (n == 12), -12).otherwise(0)

    def in_day(n: Column) -> Column:
        return F.when(n.between(0, 23), n).cast("int")

    steps = F.transform(F.transform(F.array(upper_strip(F.col(text))), shifted), in_day)
    return df.withColumn(hour, steps[0])


def time_of_day(hour: Column) -> Column:
    """Part of the day; each part includes its last hour (6, 12, 17, 21)."""
    return (
        F.when(hour <= 6, "night")
        .when(hour <= 12, "morning")
        .when(hour <= 17, "afternoon")
        .when(hour <= 21, "evening")
        .when(hour <= 24, "late_night")
    )


def dow_from_sunday(d: Column) -> Column:
    """Sunday 0 .. Saturday 6."""
    return (F.dayofweek(d) - 1).cast("int")


def dow_from_monday(d: Column) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(d).cast("int")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def is_weekend(dow: Column) -> Column:
    return flag(dow >= 5)


def is_rush_hour(dow: Column, hour: Column) -> Column:
    """Monday to Friday, 7-9 or 16-19; an unknown hour or day is no rush hour."""
    return flag((dow < 5) & (hour.between(7, 9) | hour.between(16, 19)))


def is_sweeping_day(dow: Column) -> Column:
    """Days of alternate-side rules: Monday, Tuesday, Thursday, Friday."""
    return flag(dow.isin(0, 1, 3, 4))


def as_date(c: Column) -> Column:
    """A date; text that is none gives null."""
    return c.try_cast("date")
