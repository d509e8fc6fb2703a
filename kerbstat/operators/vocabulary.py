"""Vocabularies: the code of each value of a column, and columns turned into codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from kerbstat.schema import UNKNOWN
from kerbstat.session import stage


def fit_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, value, code)``: the sorted values of each column numbered from 0.

    UNKNOWN is always one of the values and stands for null. All columns are read in one pass;
    each task sends on its distinct values only.
    """
    values = df.select(*columns).unpivot([], columns, "feature", "value")
    known = values.where(F.col("value").isNotNull() & (F.col("value") != "nan"))
    spare = df.sparkSession.createDataFrame([(c, UNKNOWN) for c in columns], "feature string, value string")
    return _number(known.union(spare).distinct())


def fit_labels(df: DataFrame, target: str) -> DataFrame:
    """As :func:`fit_vocabulary` for one target column, without UNKNOWN."""
    values = df.where(F.col(target).isNotNull()).select(
        F.lit(target).alias("feature"), F.col(target).cast("string").alias("value")
    )
    return _number(values.distinct())


def _number(values: DataFrame) -> DataFrame:
    """Number distinct values by order within their column.

    The values are dealt out by range and numbered within each range; what comes before a range is
    added from the ranges' counts. A column with very many values is thus no group of its own.
    """
    ranged = values.select("feature", "value").repartitionByRange("feature", "value")
    placed = stage(ranged.withColumn("_part", F.spark_partition_id()), "values")
    before = Window.partitionBy("feature").orderBy("_part")
    counts = placed.groupBy("feature", "_part").agg(F.count("*").alias("_n"))
    firsts = counts.select("feature", "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_first"))
    within = Window.partitionBy("feature", "_part").orderBy("value")
    numbered = placed.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["feature", "_part"])
    return numbered.select("feature", "value", (F.col("_first") + F.col("_rank")).cast("int").alias("code"))


def encode(df: DataFrame, vocabulary: DataFrame, columns: list[str]) -> DataFrame:
    """Replace columns by their codes; unseen values get the code of UNKNOWN.

    ``vocabulary`` should be staged, so that each join is planned by its measured size. The
    only rows that reach the driver are the UNKNOWN codes, one per column.
    """
    spare = {r["feature"]: r["code"] for r in vocabulary.where(F.col("value") == UNKNOWN).collect()}
    for c in columns:
        codes = vocabulary.where(F.col("feature") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        df = (
            df.join(codes, F.col(c) == F.col("_value"), "left")
            .withColumn(c, F.coalesce(F.col("_code"), F.lit(spare[c])))
            .drop("_value", "_code")
        )
    return df


def encode_target(df: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Add ``label``, the code of the target; rows of unseen classes are left out."""
    codes = labels.select(F.col("value").alias("_value"), F.col("code").alias("label"))
    return df.join(codes, F.col(target) == F.col("_value")).drop("_value")


def unseen_targets(df: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """The classes that :func:`encode_target` leaves out, with their rows."""
    codes = labels.select(F.col("value").alias(target))
    return df.join(codes, target, "left_anti").groupBy(target).agg(F.count("*").alias("class_rows"))


def decode(df: DataFrame, labels: DataFrame, code: str, name: str) -> DataFrame:
    """Add ``name``, the value behind a code column."""
    values = labels.select(F.col("code").alias("_code"), F.col("value").alias(name))
    return df.join(values, F.col(code) == F.col("_code"), "left").drop("_code")
