"""Class filters and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from kerbstat.operators.stats import class_counts
from kerbstat.schema import CODE, ID
from kerbstat.session import stage

#: Leading hex digits of the draw that rows are counted by: 65,536 counts per class at most.
BUCKET_DIGITS = 4


def frequent_classes(df: DataFrame, label: str = CODE, least: int = 10) -> DataFrame:
    """Rows whose class has at least ``least`` rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("class_rows"))
    valid = stage(counts.where(F.col("class_rows") >= least).select(label), "classes")
    return df.join(valid, label, "left_semi")


def rare_class_rows(df: DataFrame, label: str = CODE, least: int = 10) -> DataFrame:
    """How many rows and classes :func:`frequent_classes` takes out."""
    counts = class_counts(df, label).where(F.col("class_rows") < least)
    return counts.agg(
        F.coalesce(F.sum("class_rows"), F.lit(0)).alias("removed_rows"),
        F.count("*").alias("removed_classes"),
    )


def most_frequent(df: DataFrame, label: str, n: int) -> DataFrame:
    """The ``n`` classes with most rows; ties go to the smaller class."""
    counts = df.groupBy(label).agg(F.count("*").alias("class_rows"))
    return counts.orderBy(F.desc("class_rows"), label).limit(n).select(label)


def stratified_split(
    df: DataFrame,
    label: str = CODE,
    key: str = ID,
    test: float = 0.2,
    validation: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per class, ``test`` of the rows, ``validation`` of the rest, and train.

    Rows without a class get no split. The others are ordered within their class by a hash of
    seed and key, and the first ones are taken, so the shares are exact and the split can be
    repeated. No class is ever sorted as a whole: hashes are counted per class and leading
    digits, the counts show which few digits each cut falls into, and only the rows under those
    digits are ranked. The rows themselves are then compared with the cuts of their class,
    without a shuffle.

    The table is read three times, so it should be staged. Two buckets per class are ranked, each about
    one of 16 to the power of ``BUCKET_DIGITS`` of the class's rows.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))
    drawn = df.select(F.col(label).alias("_label"), F.struct(draw.alias("h"), F.col(key).alias("k")).alias("_draw"))
    bucketed = drawn.where(F.col("_label").isNotNull()).withColumn(
        "_bucket", F.substring("_draw.h", 1, BUCKET_DIGITS)
    )

    label_group = Window.partitionBy("_label")
    upto = label_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    test_rows = F.round(F.col("_all") * test)
    wanted = {
        "_test": test_rows,
        "_held": test_rows + F.round((F.col("_all") - test_rows) * validation),
    }
    buckets = (
        bucketed.groupBy("_label", "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumns({"_upto": F.sum("_rows").over(upto), "_all": F.sum("_rows").over(label_group)})
        .withColumns({name: rank.cast("bigint") for name, rank in wanted.items()})
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
    )

    def falls_here(rank: str) -> Column:
        return (F.col("_before") < F.col(rank)) & (F.col(rank) <= F.col("_upto"))

    edges = stage(
        buckets.where(falls_here("_test") | falls_here("_held")).select(
            F.col("_label").alias("_l"), F.col("_bucket").alias("_b"), "_before", *wanted
        ),
        "split-edges",
    )
    same_bucket = (F.col("_label") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    by_draw = Window.partitionBy("_label", "_bucket").orderBy("_draw")
    ranked = bucketed.join(edges, same_bucket).withColumn(
        "_rank", F.col("_before") + F.row_number().over(by_draw)
    )
    cuts = stage(
        ranked.groupBy(F.col("_label").alias("_l")).agg(
            *[F.max(F.when(F.col("_rank") == F.col(n), F.col("_draw"))).alias(f"{n}_cut") for n in wanted]
        ),
        "split-cuts",
    )

    split = (
        F.when(F.col(label).isNull(), F.lit(None))
        .when(F.col("_draw") <= F.col("_test_cut"), "test")
        .when(F.col("_draw") <= F.col("_held_cut"), "validation")
        .otherwise("train")
    )
    return (
        df.withColumn("_draw", F.struct(draw.alias("h"), F.col(key).alias("k")))
        .join(cuts, F.col(label) == F.col("_l"), "left")
        .withColumn("split", split)
        .drop("_l", "_draw", *[f"{n}_cut" for n in wanted])
    )
