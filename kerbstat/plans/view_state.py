"""Mergeable state of a summary view: what is kept per key and value, so that changed rows are enough for a refresh.

The state holds, for each key and each value of the columns whose distinct values, mode or extremes the view shows, how
many rows there are, with sums and counts of the summed columns. All of these add up: rows that go are counted with
the sign minus one. Distinct counts, modes, smallest and largest values follow from the values whose number is above
zero, so that taking rows out is exact as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.operators.aggregates import ROWS, SET

SIGN = "_sign"


def signed(added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
    """Rows that came, with sign 1, and rows that went, with sign -1."""
    parts = [df.withColumn(SIGN, F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not parts:
        raise ValueError("no changed rows are given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class ViewState:
    """The shape of a view's state.

    ``prepare`` filters rows and adds derived keys; ``sums`` maps summed columns to the type of their sums;
    ``distinct``, ``lows`` and ``highs`` map output names to columns, ``mode`` is an output name and a column.
    """

    prepare: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    sums: dict[str, str]
    distinct: dict[str, str] = field(default_factory=dict)
    mode: tuple[str, str] | None = None
    lows: dict[str, str] = field(default_factory=dict)
    highs: dict[str, str] = field(default_factory=dict)

    @property
    def values(self) -> list[str]:
        """Columns that the state is kept by, beside the keys."""
        return list(dict.fromkeys([*self.distinct.values(), *([self.mode[1]] if self.mode else []), *self.lows.values(), *self.highs.values()]))

    def _value(self, column: str) -> str:
        return f"_by_{column}"

    def rows(self, changes: DataFrame) -> DataFrame:
        """The state of signed rows; each task sends on one row per key and value."""
        taken = {f"_{c}_taken": F.col(c).cast(kind) for c, kind in self.sums.items()}
        prepared = self.prepare(changes).withColumns({**taken, **{self._value(v): F.col(v) for v in self.values}})
        partial = [F.sum(SIGN).alias(ROWS)]
        for c, kind in self.sums.items():
            x = F.col(f"_{c}_taken")
            partial.append(F.sum(F.when(F.col(SIGN) > 0, x).otherwise(-x)).cast(kind).alias(f"_{c}_sum"))
            partial.append(F.coalesce(F.sum(F.when(x.isNotNull(), F.col(SIGN))), F.lit(0)).cast("bigint").alias(f"_{c}_count"))
        names = [self._value(v) for v in self.values]
        if len(names) < 2:
            counted = prepared.groupBy(*self.keys, *names).agg(*partial).withColumn(SET, F.lit(0))
        else:
            sets = [[F.col(c) for c in (*self.keys, name)] for name in names]
            counted = prepared.groupingSets(sets, *self.keys, *names).agg(*partial, F.grouping_id().alias(SET))
            # the mark of a set: one bit per column that it leaves out
            marks = [sum(1 << (len(names) - 1 - j) for j in range(len(names)) if j != i) for i in range(len(names))]
            number = F.create_map(*[F.lit(x) for i, mark in enumerate(marks) for x in (mark, i)])
            counted = counted.withColumn(SET, number[F.col(SET).cast("int")])
        return counted.where(F.col(ROWS) != 0)

    def merged(self, state: DataFrame, changes: DataFrame) -> DataFrame:
        """Two states as one; what comes to nothing is left out."""
        totals = [F.sum(ROWS).alias(ROWS)]
        for c, kind in self.sums.items():
            totals += [F.sum(f"_{c}_sum").cast(kind).alias(f"_{c}_sum"), F.sum(f"_{c}_count").alias(f"_{c}_count")]
        by = [*self.keys, *[self._value(v) for v in self.values], SET]
        both = state.unionByName(changes).groupBy(*by).agg(*totals)
        return both.select(*state.columns).where(F.col(ROWS) != 0)

    def grouped(self, state: DataFrame) -> DataFrame:
        """Per key: number of rows, sums and counts, distinct counts, mode (ties to the smallest), extremes."""
        place = {v: i for i, v in enumerate(self.values)}

        def of(column: str) -> Column:
            return (F.col(SET) == place[column]) & F.col(self._value(column)).isNotNull()

        first = F.col(SET) == 0
        outputs = [F.sum(F.when(first, F.col(ROWS))).alias(ROWS)]
        for c, kind in self.sums.items():
            count, total = F.sum(F.when(first, F.col(f"_{c}_count"))), F.sum(F.when(first, F.col(f"_{c}_sum"))).cast(kind)
            outputs += [F.when(count > 0, total).alias(f"_{c}_sum"), count.alias(f"_{c}_count")]
        outputs += [F.count_if(of(c)).alias(name) for name, c in self.distinct.items()]
        if self.mode:
            name, c = self.mode
            ranked = F.when(of(c), F.struct((-F.col(ROWS)).alias("n"), F.col(self._value(c)).alias("v")))
            outputs.append(F.min(ranked)["v"].alias(name))
        outputs += [F.min(F.when(of(c), F.col(self._value(c)))).alias(name) for name, c in self.lows.items()]
        outputs += [F.max(F.when(of(c), F.col(self._value(c)))).alias(name) for name, c in self.highs.items()]
        return state.groupBy(*self.keys).agg(*outputs)
