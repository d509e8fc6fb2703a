"""Tables stored in the order of a key, with a directory of their files.

Each file holds a range of the key, so that an ordered limit opens the first files only, and any chunk of the
ordered table can be read anew without those before it. The directory has, for every file, the smallest and
largest key, the rows, and the rows of all files before it. It is written last and marks the table whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kerbstat.operators.scan import Condition, keep
from kerbstat.schema import ID

FILE_ROWS = 1_000_000


class ClusteredTable:
    """A table under ``root``, ordered by ``key`` (nulls first) and, among equal keys, by a hash of the row."""

    def __init__(self, spark: SparkSession, root: str, key: str = ID):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def write(self, df: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """Deal the rows out by ranges of the key, one file each; a root that exists is refused.

        ``df`` is read twice: once for its size and the ranges' bounds. Equal keys share a file, so that a key is
        never split; keys are expected to be ids, of which each has few rows.
        """
        files = max(1, -(-df.count() // file_rows))
        ranged = df.repartitionByRange(files, F.col(self.key).asc_nulls_first())
        ranged.sortWithinPartitions(*self._order(df.columns)).write.parquet(f"{self.root}/data")
        stored = self._data()
        name = F.substring_index("_metadata.file_path", "/", -1)
        # a file's rows are counted where they lie; what meets afterwards is one row per file
        each = stored.groupBy(name.alias("file")).agg(
            F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.count("*").alias("rows"),
            F.count_if(F.col(self.key).isNull()).alias("without"),
        )
        before = Window.orderBy(F.desc("without"), F.asc_nulls_first("least")).rowsBetween(Window.unboundedPreceding, -1)
        listed = each.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        listed.coalesce(1).write.parquet(f"{self.root}/files")

    def _order(self, columns: list[str]) -> list:
        return [F.col(self.key).asc_nulls_first(), F.xxhash64(*columns).asc()]

    def _data(self, files: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data"] if files is None else [f"{self.root}/data/{name}" for name in files]
        return self.spark.read.parquet(*paths)

    def files(self) -> DataFrame:
        """``(file, least, most, rows, without, before)``: ranges, rows, rows without a key, rows of the files before."""
        return self.spark.read.parquet(f"{self.root}/files")

    def _files_from(self, first: int, stop: int) -> tuple[list[str], int]:
        """The files that hold the rows from place ``first`` up to ``stop``, and the place of the first of them."""
        own = self.files().where((F.col("rows") > 0) & (F.col("before") < stop) & (F.col("before") + F.col("rows") > first))
        rows = own.orderBy("before").select("file", "before").collect()
        return [r["file"] for r in rows], rows[0]["before"] if rows else first

    def rows(self) -> int:
        """Rows of the table, by the directory."""
        return self.files().agg(F.sum("rows")).first()[0] or 0

    def read(self) -> DataFrame:
        return self._data()

    def first(self, limit: int, columns: list[str] | None = None, where: Condition = None, args: dict[str, Any] | None = None) -> DataFrame:
        """The first ``limit`` rows by key that meet ``where``.

        Opens as many files from the front as it takes: those that hold the rows where there is no condition, else
        twice as many as before until they give enough.
        """
        total, reach = self.rows(), limit
        while True:
            files, _ = self._files_from(0, max(1, reach))
            part = keep(self._data(files or None), where, args)
            if where is None or reach >= total or part.limit(limit).count() >= limit:
                ordered = part.orderBy(*self._order(part.columns))
                ordered = ordered.limit(limit) if limit < total else ordered
                return ordered.select(*columns) if columns else ordered
            reach = max(2 * reach, self._rows_of(files) + 1)

    def _rows_of(self, files: list[str]) -> int:
        return self.files().where(F.col("file").isin(files)).agg(F.sum("rows")).first()[0] or 0

    def chunk(self, number: int, size: int = 50_000, columns: list[str] | None = None) -> DataFrame:
        """Rows ``number * size`` up to ``(number + 1) * size`` in the table's order; opens the files that hold them."""
        if number < 0 or size < 1:
            raise ValueError("chunks are numbered from 0 and hold a row at least")
        files, start = self._files_from(number * size, (number + 1) * size)
        if not files:
            part = self._data().limit(0)
        else:
            part = self._data(files)
            part = part.orderBy(*self._order(part.columns)).offset(number * size - start).limit(size)
        return part.select(*columns) if columns else part

    def chunks(self, size: int = 50_000, first: int = 0, columns: list[str] | None = None) -> Iterator[DataFrame]:
        """The chunks from number ``first`` on, each read when it is asked for: a job that broke off goes on there."""
        for number in range(first, -(-self.rows() // size)):
            yield self.chunk(number, size, columns)
