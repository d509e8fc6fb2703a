"""Scans of a citation table: columns, filters, samples, chunks, table facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import Any
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.schema import CITATION_SCHEMA, DATE, ID, POINT, SCAN_COLUMNS, TRAINING_COLUMNS

Condition = Column | str | None


def keep(df: DataFrame, where: Condition = None, args: dict[str, Any] | None = None) -> DataFrame:
    """Rows that meet a condition: a column, or SQL text with ``:name`` markers bound to ``args``."""
    if where is None:
        return df
    if isinstance(where, Column) or not args:
        return df.where(where)
    name = f"citations_{uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(f"SELECT * FROM {name} WHERE ({where})", args=args)
    finally:
        df.sparkSession.catalog.dropTempView(name)


def scan(
    df: DataFrame,
    columns: list[str] | None = None,
    where: Condition = None,
    args: dict[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Chosen columns of the rows that meet ``where``.

    With a limit the first rows by id come back, so that the answer can be repeated; 0 and
    None mean all rows.
    """
    rows = keep(df, where, args)
    if limit:
        rows = rows.orderBy(ID).limit(limit)
    return rows.select(*(columns or SCAN_COLUMNS))


def scan_points(
    df: DataFrame,
    columns: list[str] | None = None,
    where: Condition = None,
    args: dict[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """As :func:`scan`, with latitude and longitude, for rows with a point only.

    ``where`` narrows the rows with a point as a whole, whatever it contains.
    """
    return scan(with_point(df), (columns or SCAN_COLUMNS) + POINT, where, args, limit)


def with_point(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def in_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows issued on or after ``start`` and before ``end``."""
    if start:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(DATE) < F.lit(end).cast("date"))
    return df


def bernoulli(df: DataFrame, fraction: float | None, seed: int = 42) -> DataFrame:
    """Keep each row with the given chance; 0 and None keep the whole table.

    The draw is a hash of the seed and the row's id, all 128 bits of it, against the fraction
    as exactly as a double states it: the same rows come back however the table is partitioned
    and whenever a task is run again, and the sample does not depend on filters before or after
    it. Samples of different seeds are independent.
    """
    if not fraction:
        return df
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    if fraction == 1:
        return df
    ceiling = f"{int(Fraction(fraction) * 16**32):032x}"
    return df.where(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID))) < ceiling)


def training_load(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    counties: list[str] | None = None,
    sample: float | None = None,
    include_coordinates: bool = False,
    seed: int = 42,
) -> DataFrame:
    """The columns a model is trained from, sampled first and then filtered.

    ``counties`` are raw codes, not boroughs. Asking for coordinates keeps only rows that
    have them.
    """
    rows = in_dates(bernoulli(df, sample, seed), start, end)
    if counties:
        rows = rows.where(F.col("county").isin(counties))
    if include_coordinates:
        return with_point(rows).select(*TRAINING_COLUMNS, *POINT)
    return rows.select(*TRAINING_COLUMNS)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))


def table_info(df: DataFrame, count_nulls: list[str] | None = None) -> DataFrame:
    """Name, type and nullability of each column, in order, from the schema alone.

    Spark does not enforce a declared NOT NULL. ``count_nulls`` names columns whose nulls are
    counted as well, in ``null_rows``, which costs one scan of those columns.
    """
    declared = {f.name: f.nullable for f in CITATION_SCHEMA}
    if count_nulls is None:
        rows = [
            (position, f.name, f.dataType.simpleString(), "YES" if declared.get(f.name, f.nullable) else "NO")
            for position, f in enumerate(df.schema, start=1)
        ]
        columns = "ordinal_position int, column_name string, data_type string, is_nullable string"
        return df.sparkSession.createDataFrame(rows, columns)
    counts = df.agg(
        *[(F.count_if(F.col(f.name).isNull()) if f.name in count_nulls else F.lit(None).cast("bigint")).alias(f.name) for f in df.schema]
    )
    facts = [
        F.struct(
            F.lit(position).alias("ordinal_position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit("YES" if declared.get(f.name, f.nullable) else "NO").alias("is_nullable"),
            F.col(f.name).alias("null_rows"),
        )
        for position, f in enumerate(df.schema, start=1)
    ]
    return counts.select(F.inline(F.array(*facts)))


def adhoc_sql(spark: SparkSession, query: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """A caller's SQL with bound parameters; ``{name}`` in it stands for a frame in ``tables``."""
    return spark.sql(query, args=args, **tables)


def map_chunks(
    df: DataFrame,
    work: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    chunk_size: int = 50_000,
) -> DataFrame:
    """Apply ``work`` to chunks of ``chunk_size`` rows, on the executors.

    Every chunk but the last of a partition is full. A task holds one chunk at a time.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            while size + len(batch) >= chunk_size:
                cut = chunk_size - size
                yield work(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held, size, batch = [], 0, batch.iloc[cut:]
            if len(batch):
                held.append(batch)
                size += len(batch)
        if size:
            yield work(pd.concat(held, ignore_index=True))

    return df.mapInPandas(chunks, schema)


def iter_chunks(df: DataFrame, chunk_size: int = 50_000) -> Iterator[pd.DataFrame]:
    """Chunks of ``chunk_size`` rows for a consumer on the driver, one partition at a time.

    Executors cut the rows into Arrow batches, so that the driver unpacks a batch, not a row, at a time.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    held, size = [], 0
    for row in df.mapInArrow(packed, "batch binary").toLocalIterator():
        table = pa.ipc.open_stream(row["batch"]).read_all()
        while size + len(table) >= chunk_size:
            cut = chunk_size - size
            yield pa.concat_tables([*held, table.slice(0, cut)]).to_pandas(date_as_object=True)
            held, size, table = [], 0, table.slice(cut)
        if len(table):
            held.append(table)
            size += len(table)
    if size:
        yield pa.concat_tables(held).to_pandas(date_as_object=True)
