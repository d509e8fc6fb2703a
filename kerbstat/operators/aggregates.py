"""Aggregations that stay balanced when one group holds much of the table.

Each task first reduces its rows to counts per group *and* value, one set of counts per value
column, and the shuffle spreads them by both. Only those counts meet per group afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from kerbstat.session import stage

ROWS = "_rows"
SET = "_set"


def money_mean(total: Column, count: Column) -> Column:
    """Average of an exact decimal total, as one double division; null for no values."""
    return total.cast("double") / F.nullif(count, F.lit(0))


def additive(c: str) -> dict[str, Column]:
    """Partial sum and count of a column, to be summed up later."""
    return {f"_{c}_sum": F.sum(c), f"_{c}_count": F.count(c)}


def group_with_values(
    df: DataFrame,
    keys: list[str],
    distinct: dict[str, str],
    mode: tuple[str, str] | None = None,
    sums: dict[str, Column] | None = None,
    lows: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
) -> DataFrame:
    """Group by ``keys`` with exact distinct counts and a mode, in one pass over the rows.

    ``distinct`` maps output name to column, ``mode`` is (output name, column) with ties going
    to the smallest value. ``sums``, ``lows`` and ``highs`` map output names to aggregates of
    the rows that are merged by sum, min and max. ``_rows`` is the number of rows.
    """
    sums, lows, highs = sums or {}, lows or {}, highs or {}
    values = list(dict.fromkeys([*distinct.values(), *([mode[1]] if mode else [])]))
    merged = {ROWS: F.count("*"), **sums, **lows, **highs}
    partial = [agg.alias(name) for name, agg in merged.items()]

    def merge(only: Column | None) -> list[Column]:
        def pick(name: str) -> Column:
            return F.col(name) if only is None else F.when(only, F.col(name))

        return (
            [F.sum(pick(n)).alias(n) for n in [ROWS, *sums]]
            + [F.min(pick(n)).alias(n) for n in lows]
            + [F.max(pick(n)).alias(n) for n in highs]
        )

    if len(values) == 1:
        per_value, of = df.groupBy(*keys, values[0]).agg(*partial), {values[0]: F.lit(True)}
        whole = merge(None)
    else:
        # One set of counts per value column, reduced in the tasks before the one full shuffle.
        per_value = df.groupingSets(
            [[F.col(c) for c in [*keys, v]] for v in values], *keys, *values
        ).agg(*partial, F.grouping_id().alias(SET))
        # grouping_id has one bit per column, set where the column is left out of the set.
        marks = {
            v: sum(1 << (len(values) - 1 - j) for j in range(len(values)) if j != i)
            for i, v in enumerate(values)
        }
        of = {v: F.col(SET) == mark for v, mark in marks.items()}
        whole = merge(of[values[0]])

    outputs = whole + [
        F.count_if(of[v] & F.col(v).isNotNull()).alias(name) for name, v in distinct.items()
    ]
    if mode:
        name, v = mode
        ranked = F.when(of[v] & F.col(v).isNotNull(), F.struct((-F.col(ROWS)).alias("n"), F.col(v).alias("v")))
        outputs.append(F.min(ranked)["v"].alias(name))
    return per_value.groupBy(*keys).agg(*outputs)


#: Different values of a group that one task orders; parts that a range of values is cut into.
ORDERED, PARTS = 65_536, 256


def exact_median(df: DataFrame, keys: list[str], value: str, total: str = "_total", ordered: int = ORDERED) -> DataFrame:
    """Per group: rows, smallest, largest, total and interpolated median of a non-null numeric column.

    The rows are reduced to counts per value, and running counts over a group's values find the middle. Where a group
    has more than ``ordered`` different values, the range that holds the middle is narrowed first: its values are counted
    in ``PARTS`` parts, and the part with the middle is the next range, so that no task orders all values of a group.
    """
    bins = stage(df.groupBy(*keys, value).agg(F.count("*").alias(ROWS), F.sum(value).alias(total)), "bins")
    groups = bins.groupBy(*keys).agg(
        F.sum(ROWS).alias(ROWS), F.min(value).alias("_min"), F.max(value).alias("_max"), F.sum(total).alias(total), F.count("*").alias("_values")
    )
    if (groups.agg(F.max("_values")).first()[0] or 0) <= ordered:
        middle = _middle(bins.withColumn("_all", F.sum(ROWS).over(Window.partitionBy(*keys))), keys, value, F.lit(0))
        return _joined(groups, middle, keys)
    ranges = stage(groups.select(
        *keys, F.col(ROWS).alias("_all"), F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.lit(0).cast("bigint").alias("_before"), "_values"
    ), "ranges")
    while not (wide := ranges.where(F.col("_values") > ordered)).isEmpty():
        ranges = stage(ranges.where(F.col("_values") <= ordered).unionByName(_narrowed(bins, wide, keys, value)), "ranges")
    inside = _within(bins, ranges, keys, value)
    return _joined(groups, _middle(inside, keys, value, F.col("_before")), keys)


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equal keys, null like any other."""
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return both


def _joined(groups: DataFrame, middle: DataFrame, keys: list[str]) -> DataFrame:
    joined = groups.alias("g").join(middle.alias("m"), _same(keys, "g", "m"))
    return joined.select(*[f"g.{c}" for c in groups.columns if c != "_values"], "m._median")


def _within(bins: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The bins inside their group's range, with the range's columns."""
    own = [F.col(f"r.{c}") for c in ranges.columns if c not in keys]
    joined = bins.alias("b").join(ranges.alias("r"), _same(keys, "b", "r"))
    return joined.where(F.col(f"b.{value}").between(F.col("r._lo"), F.col("r._hi"))).select("b.*", *own)


def _narrowed(bins: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each range cut down to the part that holds the middle row, or to the two values on both sides of the middle."""
    place = (F.col(value) - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double") * PARTS
    part = F.least(F.floor(place), F.lit(PARTS - 1)).cast("int")
    parts = _within(bins, ranges, keys, value).groupBy(*keys, "_all", "_before", part.alias("_part")).agg(
        F.sum(ROWS).alias(ROWS), F.count("*").alias("_values"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("_upto", F.col("_before") + F.sum(ROWS).over(upto))  # of the parts, not the values
    first = F.col("_upto") - F.col(ROWS)

    def holds(position: str) -> Column:
        return (first <= F.expr(position)) & (F.expr(position) < F.col("_upto"))

    low, high = holds("(_all - 1) div 2"), holds("_all div 2")
    chosen = placed.where(low | high).withColumns({"_first": first, "_low": low, "_high": high})
    one = F.count("*") == 1
    return chosen.groupBy(*keys, "_all").agg(
        # in two parts: the middle lies between the largest value of the lower and the smallest of the upper one
        F.when(one, F.max("_lo")).otherwise(F.max(F.when(F.col("_low"), F.col("_hi")))).alias("_lo"),
        F.when(one, F.max("_hi")).otherwise(F.max(F.when(F.col("_high"), F.col("_lo")))).alias("_hi"),
        F.when(one, F.max("_first")).otherwise(F.lit(-1)).cast("bigint").alias("_before"),
        F.when(one, F.max("_values")).otherwise(F.lit(2)).cast("bigint").alias("_values"),
    )


def _middle(inside: DataFrame, keys: list[str], value: str, before: Column) -> DataFrame:
    """``(keys, _median)`` from the bins around the middle; ``before`` rows lie below them, or -1: the two values are it."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumns({"_first": before, "_upto": before + F.sum(ROWS).over(upto)})
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")

    def at(position: Column, otherwise: Column) -> Column:
        holds = (F.col("_upto") - F.col(ROWS) <= position) & (position < F.col("_upto"))
        found = F.max(F.when(holds, F.col(value))).cast("double")
        return F.when(F.min("_first") < 0, otherwise.cast("double")).otherwise(found)

    below, above = at(low, F.min(value)), at(high, F.max(value))
    return placed.groupBy(*keys).agg((below + (above - below) * F.lit(0.5)).alias("_median"))
