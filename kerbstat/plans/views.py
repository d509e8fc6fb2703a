"""The seven summary views, and a store that creates and refreshes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.functions.clock import dow_from_sunday, month_start, strict_hour
from kerbstat.functions.place import risk_grid
from kerbstat.functions.text import non_blank
from kerbstat.operators.aggregates import ROWS, additive, group_with_values, money_mean
from kerbstat.operators.scan import with_point
from kerbstat.plans.view_state import ViewState, signed
from kerbstat.schema import CODE, DATE, FINE
from kerbstat.session import remove

COORDINATE = "decimal(18,6)"
FINE_SUM, FINE_COUNT = f"_{FINE}_sum", f"_{FINE}_count"


def _avg_fine() -> Column:
    return money_mean(F.col(FINE_SUM), F.col(FINE_COUNT)).alias("avg_fine")


def risk_cells(df: DataFrame) -> DataFrame:
    cells = {"lat_grid": risk_grid(F.col("latitude")), "lon_grid": risk_grid(F.col("longitude"))}
    return with_point(df).withColumns(cells)


def location_risk_scores(df: DataFrame) -> DataFrame:
    """Citation density of each cell of the three-decimal grid."""
    keys = ["lat_grid", "lon_grid"]
    grouped = group_with_values(
        risk_cells(df).select(*keys, CODE, DATE, FINE),
        keys,
        distinct={"violation_types": CODE, "active_days": DATE},
        mode=("most_common_violation", CODE),
        sums=additive(FINE),
    )
    return finish_location(grouped)


def finish_location(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "lat_grid",
        "lon_grid",
        F.col(ROWS).alias("total_tickets"),
        "violation_types",
        "active_days",
        (F.col(ROWS) / F.nullif("active_days", F.lit(0))).alias("avg_daily_tickets"),
        _avg_fine(),
        "most_common_violation",
    )


def temporal_patterns(df: DataFrame, least: int = 10) -> DataFrame:
    """Citations and average fine by day of the week, strict hour and precinct."""
    slots = time_slots(df).groupBy("day_of_week", "hour_of_day", "precinct")
    return finish_temporal(slots.agg(F.count("*").alias(ROWS), *[agg.alias(c) for c, agg in additive(FINE).items()]), least)


def time_slots(df: DataFrame) -> DataFrame:
    timed = df.where(F.col("violation_time").isNotNull())
    return timed.withColumns({"day_of_week": dow_from_sunday(F.col(DATE)), "hour_of_day": strict_hour(F.col("violation_time"))})


def finish_temporal(grouped: DataFrame, least: int = 10) -> DataFrame:
    kept = grouped.where(F.col(ROWS) >= least)
    return kept.select("day_of_week", "hour_of_day", "precinct", F.col(ROWS).alias("ticket_count"), _avg_fine())


def precinct_stats(df: DataFrame) -> DataFrame:
    """Citations, activity, fines and centre of each precinct and county."""
    keys = ["precinct", "county"]
    placed = df.where(F.col("precinct").isNotNull())
    points = {
        f"_{c}_{name}": agg
        for c in ("latitude", "longitude")
        for name, agg in (("sum", F.sum(F.col(c).cast(COORDINATE))), ("count", F.count(c)))
    }
    grouped = group_with_values(
        placed,
        keys,
        distinct={"unique_violations": CODE, "agencies_active": "issuing_agency"},
        sums={**additive(FINE), **points},
        lows={"first_ticket_date": F.min(DATE)},
        highs={"last_ticket_date": F.max(DATE)},
    )
    return finish_precinct(grouped)


def finish_precinct(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "precinct",
        "county",
        F.col(ROWS).alias("total_tickets"),
        "unique_violations",
        "agencies_active",
        "first_ticket_date",
        "last_ticket_date",
        _avg_fine(),
        F.col(FINE_SUM).alias("total_fines"),
        money_mean(F.col("_latitude_sum"), F.col("_latitude_count")).alias("centroid_lat"),
        money_mean(F.col("_longitude_sum"), F.col("_longitude_count")).alias("centroid_lon"),
    )


def street_stats(df: DataFrame, least: int = 50) -> DataFrame:
    """Citations of each named street within precinct and county."""
    grouped = group_with_values(
        named_streets(df),
        ["street_name_clean", "precinct", "county"],
        distinct={"violation_types": CODE},
        mode=("most_common_violation", CODE),
        sums=additive(FINE),
    )
    return finish_street(grouped, least)


def named_streets(df: DataFrame) -> DataFrame:
    return df.where(non_blank(F.col("street_name"))).withColumn("street_name_clean", F.upper(F.trim("street_name")))


def finish_street(grouped: DataFrame, least: int = 50) -> DataFrame:
    return grouped.where(F.col(ROWS) >= least).select(
        "street_name_clean", "precinct", "county", F.col(ROWS).alias("ticket_count"), "violation_types", _avg_fine(), "most_common_violation"
    )


def violation_stats(df: DataFrame) -> DataFrame:
    """Citations, reach, fines and first and last date of each violation."""
    keys = [CODE, "violation_desc"]
    grouped = group_with_values(
        df,
        keys,
        distinct={"precincts_affected": "precinct", "counties_affected": "county"},
        sums=additive(FINE),
        lows={"min_fine": F.min(FINE), "first_seen": F.min(DATE)},
        highs={"max_fine": F.max(FINE), "last_seen": F.max(DATE)},
    )
    return finish_violation(grouped)


def finish_violation(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        CODE,
        "violation_desc",
        F.col(ROWS).alias("total_tickets"),
        "precincts_affected",
        "counties_affected",
        "min_fine",
        _avg_fine(),
        "max_fine",
        "first_seen",
        "last_seen",
    )


def monthly_trends(df: DataFrame) -> DataFrame:
    """Citations and fines by month, precinct and violation code."""
    return dated(df).groupBy("month", "precinct", CODE).agg(
        F.count("*").alias("ticket_count"), F.sum(FINE).alias("total_fines")
    )


def dated(df: DataFrame) -> DataFrame:
    return df.where(F.col(DATE).isNotNull()).withColumn("month", month_start(F.col(DATE)))


def finish_monthly(grouped: DataFrame) -> DataFrame:
    fines = F.col(FINE_SUM).cast("decimal(20,2)").alias("total_fines")
    return grouped.select("month", "precinct", CODE, F.col(ROWS).alias("ticket_count"), fines)


def agency_stats(df: DataFrame) -> DataFrame:
    """Citations, reach and commonest violation of each agency and county."""
    keys = ["issuing_agency", "county"]
    grouped = group_with_values(
        df.where(F.col("issuing_agency").isNotNull()),
        keys,
        distinct={"violation_types": CODE, "precincts_covered": "precinct"},
        mode=("most_issued_violation", CODE),
        sums=additive(FINE),
    )
    return finish_agency(grouped)


def finish_agency(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "issuing_agency",
        "county",
        F.col(ROWS).alias("total_tickets"),
        "violation_types",
        "precincts_covered",
        _avg_fine(),
        "most_issued_violation",
    )


@dataclass(frozen=True)
class View:
    """How a view is computed, from citations or from stored state, and the order its rows are stored in."""

    compute: Callable[[DataFrame], DataFrame]
    state: ViewState
    finish: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]
    descending: bool = False

    def ordered(self, rows: DataFrame) -> DataFrame:
        """The view's rows in stored order: readers skip row groups on the lookup columns."""
        first, *rest = (F.col(c) for c in self.order)
        lead = first.desc_nulls_first() if self.descending else first.asc_nulls_last()
        return rows.orderBy(lead, *[c.asc_nulls_last() for c in rest])

    def rows(self, citations: DataFrame) -> DataFrame:
        return self.ordered(self.compute(citations))

    def rows_of_state(self, state: DataFrame) -> DataFrame:
        return self.ordered(self.finish(self.state.grouped(state)))


FINES = {FINE: "decimal(30,2)"}
POINTS = {"latitude": "decimal(38,6)", "longitude": "decimal(38,6)"}

VIEWS = {
    "location_risk_scores": View(
        location_risk_scores,
        ViewState(
            risk_cells, ("lat_grid", "lon_grid"), FINES, distinct={"violation_types": CODE, "active_days": DATE},
            mode=("most_common_violation", CODE),
        ),
        finish_location,
        ("lat_grid", "lon_grid"),
    ),
    "temporal_patterns": View(
        temporal_patterns,
        ViewState(time_slots, ("day_of_week", "hour_of_day", "precinct"), FINES),
        finish_temporal,
        ("day_of_week", "hour_of_day", "precinct"),
    ),
    "precinct_stats": View(
        precinct_stats,
        ViewState(
            lambda df: df.where(F.col("precinct").isNotNull()), ("precinct", "county"), {**FINES, **POINTS},
            distinct={"unique_violations": CODE, "agencies_active": "issuing_agency"},
            lows={"first_ticket_date": DATE}, highs={"last_ticket_date": DATE},
        ),
        finish_precinct,
        ("precinct", "county"),
    ),
    "street_stats": View(
        street_stats,
        ViewState(
            named_streets, ("street_name_clean", "precinct", "county"), FINES, distinct={"violation_types": CODE},
            mode=("most_common_violation", CODE),
        ),
        finish_street,
        ("street_name_clean", "precinct", "county"),
    ),
    "violation_stats": View(
        violation_stats,
        ViewState(
            lambda df: df, (CODE, "violation_desc"), FINES,
            distinct={"precincts_affected": "precinct", "counties_affected": "county"},
            lows={"min_fine": FINE, "first_seen": DATE}, highs={"max_fine": FINE, "last_seen": DATE},
        ),
        finish_violation,
        ("total_tickets", CODE, "violation_desc"),
        True,
    ),
    "monthly_trends": View(monthly_trends, ViewState(dated, ("month", "precinct", CODE), FINES), finish_monthly, ("month", "precinct", CODE)),
    "agency_stats": View(
        agency_stats,
        ViewState(
            lambda df: df.where(F.col("issuing_agency").isNotNull()), ("issuing_agency", "county"), FINES,
            distinct={"violation_types": CODE, "precincts_covered": "precinct"}, mode=("most_issued_violation", CODE),
        ),
        finish_agency,
        ("total_tickets", "issuing_agency", "county"),
        True,
    ),
}


class ViewStore:
    """Stored views under one folder, each in versions.

    A version is a parquet folder. It becomes current when its entry, one row in one file, is
    written after it, so a reader sees a whole version or the one before, and a job that dies
    half-way leaves the current version as it was. The newest ``keep`` versions stay, for readers
    that began before a refresh; older ones, and their entries, are removed by the next refresh.

    An ``incremental`` store keeps beside each version the state it was made from, so that
    :meth:`apply` brings a view up to date from changed rows and the state alone.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, incremental: bool = False):
        if keep < 1:
            raise ValueError("at least the current version has to be kept")
        self.incremental = incremental
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep

    def _versions(self, name: str) -> list[str]:
        """Versions with an entry, newest first; a folder that cannot be read is an error."""
        try:
            entries = self.spark.read.schema("version string").parquet(f"{self.root}/{name}/entries/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["version"] for r in entries.collect()), reverse=True)

    def _current(self, name: str) -> str | None:
        return next(iter(self._versions(name)), None)

    def _version(self) -> str:
        return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"

    def _write(self, name: str, citations: DataFrame) -> None:
        if self.incremental:
            self._write_state(name, VIEWS[name].state.rows(signed(citations)))
            return
        version = self._version()
        VIEWS[name].rows(citations).write.parquet(f"{self.root}/{name}/data/{version}")
        self._commit(name, version)

    def _write_state(self, name: str, state: DataFrame) -> None:
        """A version from its state, which is written first and read back."""
        version, view = self._version(), VIEWS[name]
        path = f"{self.root}/{name}/state/{version}"
        state.write.parquet(path)
        written = self.spark.read.schema(state.schema).parquet(path)
        if not written.where(F.col(ROWS) < 0).isEmpty():
            remove(self.spark, path)
            raise ValueError(f"rows are taken out of {name} that it does not hold")
        view.rows_of_state(written).write.parquet(f"{self.root}/{name}/data/{version}")
        self._commit(name, version)

    def _commit(self, name: str, version: str) -> None:
        entry = self.spark.createDataFrame([(version,)], "version string")
        entry.coalesce(1).write.parquet(f"{self.root}/{name}/entries/{version}")
        for old in self._versions(name)[self.keep :]:
            # The entry goes first: a version without one is never read.
            for part in ("entries", "data", "state"):
                remove(self.spark, f"{self.root}/{name}/{part}/{old}")

    def apply(self, name: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Bring a view up to date: ``added`` are new rows, ``removed`` rows that went; a changed row is one of each.

        Reads the changed rows and the current state, not the citations. Rows to be removed are given as they
        were; one that the view does not hold is an error, and the current version then stays.
        """
        version = self._current(name)
        if version is None:
            raise LookupError(f"view {name} has not been created")
        if not self.incremental:
            raise ValueError("the store keeps no state; open it with incremental=True")
        view = VIEWS[name]
        state = self.spark.read.parquet(f"{self.root}/{name}/state/{version}")
        self._write_state(name, view.state.merged(state, view.state.rows(signed(added, removed))))

    def apply_all(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        for name in VIEWS:
            self.apply(name, added, removed)

    def create(self, name: str, citations: DataFrame) -> None:
        """Compute and store a view, unless it is there already."""
        if self._current(name) is None:
            self._write(name, citations)

    def refresh(self, name: str, citations: DataFrame) -> None:
        """Compute a view anew and make it current."""
        self._write(name, citations)

    def create_all(self, citations: DataFrame) -> None:
        for name in VIEWS:
            self.create(name, citations)

    def refresh_all(self, citations: DataFrame) -> None:
        for name in VIEWS:
            self.refresh(name, citations)

    def read(self, name: str) -> DataFrame:
        """The current version of a view."""
        version = self._current(name)
        if version is None:
            raise LookupError(f"view {name} has not been created")
        return self.spark.read.parquet(f"{self.root}/{name}/data/{version}")
