"""Citations from a relational database with a point column, read in parallel over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbstat.schema import CITATION_SCHEMA, POINT
from kerbstat.sources.tables import conform


def jdbc_options(
    url: str,
    table: str,
    first_date: str,
    last_date: str,
    partitions: int,
    fetch_size: int = 50_000,
    point_column: str = "geom",
) -> dict[str, str]:
    """Reader options: a subquery that turns the point into two columns, split by issue date.

    Each partition is one bounded query; rows without a date fall to the first one. Filters
    and column choices on the result go into those queries.
    """
    columns = [c for c in CITATION_SCHEMA.fieldNames() if c not in POINT]
    points = [
        f"ST_Y({point_column}::geometry) AS latitude",
        f"ST_X({point_column}::geometry) AS longitude",
    ]
    return {
        "url": url,
        "dbtable": f"(SELECT {', '.join(columns + points)} FROM {table}) AS citations",
        "partitionColumn": "issue_date",
        "lowerBound": first_date,
        "upperBound": last_date,
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc_citations(spark: SparkSession, *, properties: dict[str, str] | None = None, **where) -> DataFrame:
    """Citations over JDBC; ``where`` holds the arguments of :func:`jdbc_options`."""
    reader = spark.read.format("jdbc").options(**jdbc_options(**where)).options(**(properties or {}))
    return conform(reader.load())
