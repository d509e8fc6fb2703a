"""Citation tables in files or the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kerbstat.schema import CITATION_SCHEMA


def read_citations(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Citations from files; columns go by name and are checked against the declared schema.

    CSV needs a header. Its cells, and those of JSON, are read as text and then converted; see
    :func:`unreadable_cells` for what is lost.
    """
    return conform(read_raw(spark, path, format))


def read_raw(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The files as they are: all columns text for formats that carry no types."""
    reader = spark.read
    if format == "csv":
        reader = reader.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if format == "json":
        reader = reader.schema(", ".join(f"{name} string" for name in CITATION_SCHEMA.fieldNames()))
    return reader.format(format).load(path)


def read_citation_table(spark: SparkSession, name: str) -> DataFrame:
    """Citations from a catalog table."""
    return conform(spark.table(name))


def conform(df: DataFrame) -> DataFrame:
    """Bring a frame to the declared columns and types; a missing column is an error.

    Columns that already have their type pass as they are, so filters still reach the scan. A cell
    that cannot be converted becomes null, and an amount is rounded to the declared decimals.
    """
    missing = [f.name for f in CITATION_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"citation columns missing: {', '.join(missing)}")
    return df.select(*[_converted(df, f).alias(f.name) for f in CITATION_SCHEMA])


def _converted(df: DataFrame, field: T.StructField) -> Column:
    same = df.schema[field.name].dataType == field.dataType
    return F.col(field.name) if same else F.col(field.name).try_cast(field.dataType)


def unreadable_cells(df: DataFrame) -> DataFrame:
    """``(column_name, unreadable_rows, rounded_rows)``: what :func:`conform` turns to null, and what it rounds.

    One scan of the columns whose type is not the declared one.
    """
    changed = [f for f in CITATION_SCHEMA if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    counts, lines = [], []
    for f in changed:
        given, kept = F.col(f.name), _converted(df, f)
        counts.append(F.count_if(given.isNotNull() & kept.isNull()).alias(f"{f.name}_lost"))
        exact = given.try_cast("decimal(38,18)") if isinstance(f.dataType, T.DecimalType) else F.lit(None)
        counts.append(F.count_if(F.coalesce(exact != kept, F.lit(False))).alias(f"{f.name}_rounded"))
        lines.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.col(f"{f.name}_lost").alias("unreadable_rows"),
                F.col(f"{f.name}_rounded").alias("rounded_rows"),
            )
        )
    if not changed:
        return df.sparkSession.createDataFrame([], "column_name string, unreadable_rows bigint, rounded_rows bigint")
    return df.agg(*counts).select(F.inline(F.array(*lines)))
