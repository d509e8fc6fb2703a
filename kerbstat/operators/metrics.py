"""Classification metrics of any frame with ``label``, ``prediction`` and ``probability``.

``label`` and ``prediction`` are class numbers, ``probability`` an array with one entry per
class. Every metric but the ranks comes from one small table of counts per pair of classes.
Averages of per-class scores are summed in fixed point, so they do not depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.operators.classes import most_frequent
from kerbstat.operators.vocabulary import decode
from kerbstat.session import stage

SCORE = "decimal(20,15)"
TOP_K = (1, 3, 5)


def true_rank(label: str = "label", probability: str = "probability") -> Column:
    """1 plus the classes ahead of the true one; among equals the higher number is ahead.

    Sorting finds how many are larger; the entries after the true one show equals that count.
    """
    scores, true = F.col(probability), F.col(label).cast("int")
    own = F.element_at(scores, true + 1)
    after = F.slice(scores, true + 2, F.size(scores))
    equals_after = F.size(after) - F.size(F.array_remove(after, own))
    return (F.array_position(F.sort_array(scores, asc=False), own) + equals_after).cast("int")


def top_classes(df: DataFrame, k: int = 5, probability: str = "probability") -> DataFrame:
    """Add ``top``: the ``k`` likeliest classes as (probability, code), likeliest first.

    Among equals the higher number comes first. A row without an array has no list, one with a
    shorter array a shorter list; null entries do not count. Built-in functions only: a sorted copy
    gives the ``k`` largest values, and each is looked up from the end, once for each time it occurs.
    """
    scores = F.col(probability)
    found = df.withColumn("_largest", F.slice(F.sort_array(F.array_compact(scores), asc=False), 1, k))
    found = found.withColumn("_backwards", F.reverse(scores))
    for i in range(k):
        # Behind the place of an equal value found before; that value itself is one entry to the left.
        value, before = F.get("_largest", F.lit(i)), F.get("_largest", F.lit(i - 1)) if i else F.lit(None).cast("double")
        past = F.when(value == before, F.col(f"_at_{i - 1}")).otherwise(F.lit(0)) if i else F.lit(0)
        place = past + F.array_position(F.slice("_backwards", past + 1, F.size("_backwards")), value)
        found = found.withColumn(f"_at_{i}", place.cast("int"))
    entries = [
        F.when(
            F.col(f"_at_{i}").isNotNull(),
            F.struct(F.get("_largest", F.lit(i)).alias("probability"), (F.size("_backwards") - F.col(f"_at_{i}")).alias("code")),
        )
        for i in range(k)
    ]
    top = F.when(scores.isNotNull(), F.array_compact(F.array(*entries)))
    return found.withColumn("top", top).select(*df.columns, "top")


def confusion_counts(df: DataFrame) -> DataFrame:
    """Rows of each pair of true and predicted class."""
    return df.groupBy("label", "prediction").agg(F.count("*").alias("pair_rows"))


def accuracy(df: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("label") == F.col("prediction"))
    return df.agg((hits / F.count("*")).alias("accuracy"))


def top_k_accuracy(df: DataFrame, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """``(k, accuracy)`` for each k that does not exceed the number of classes."""
    return _top_k_of(_hit_counts(df, ks).agg(*_total_hits(ks)), ks)


def _hit_counts(df: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Counts per pair of classes, with the rows whose true class is among the k likeliest."""
    return (
        df.select("label", "prediction", true_rank().alias("_rank"), F.size("probability").alias("_classes"))
        .groupBy("label", "prediction")
        .agg(
            F.count("*").alias("pair_rows"),
            F.max("_classes").alias("classes"),
            *[F.count_if(F.col("_rank") <= k).alias(f"hits_{k}") for k in ks],
        )
    )


def _total_hits(ks: tuple[int, ...]) -> list[Column]:
    return [
        F.sum("pair_rows").alias("pair_rows"),
        F.max("classes").alias("classes"),
        *[F.sum(f"hits_{k}").alias(f"hits_{k}") for k in ks],
    ]


def _top_k_of(totals: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("k"), (F.col(f"hits_{k}") / F.col("pair_rows")).alias("accuracy")) for k in ks]
    return totals.select("classes", F.inline(F.array(*rows))).where(F.col("k") <= F.col("classes")).drop("classes")


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs as label or prediction."""
    return per_class_of(confusion_counts(df))


def per_class_of(pairs: DataFrame) -> DataFrame:
    """As :func:`per_class`, from counts per pair; an empty ratio counts as 0.

    Each pair is credited to its true and to its predicted class, which one grouping adds up.
    """
    n, hit = F.col("pair_rows"), F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("bigint")
    credits = F.array(
        F.struct(F.col("label").alias("class"), n.alias("actual"), zero.alias("predicted"), F.when(hit, n).otherwise(zero).alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("actual"), n.alias("predicted"), zero.alias("hits")),
    )
    sums = pairs.select(F.inline(credits)).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")]
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    hits, actual, predicted = F.col("hits"), F.col("actual"), F.col("predicted")
    return sums.select(
        "class",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, actual).alias("recall"),
        ratio(hits * 2, actual + predicted).alias("f1"),
        actual.alias("support"),
    )


def averages(df: DataFrame) -> DataFrame:
    """``(average, precision, recall, f1)``: plain and support-weighted means over classes."""
    return averages_of(per_class(df))


def averages_of(classes: DataFrame) -> DataFrame:
    scores = ("precision", "recall", "f1")
    fixed = {s: F.col(s).cast(SCORE) for s in scores}
    means = classes.agg(
        *[(F.sum(v).cast("double") / F.count("*")).alias(f"macro_{s}") for s, v in fixed.items()],
        *[
            (F.sum(v * F.col("support").cast("decimal(18,0)")).cast("double") / F.sum("support")).alias(f"weighted_{s}")
            for s, v in fixed.items()
        ],
    )
    rows = [
        F.struct(F.lit(kind).alias("average"), *[F.col(f"{kind}_{s}").alias(s) for s in scores])
        for kind in ("macro", "weighted")
    ]
    return means.select(F.inline(F.array(*rows)))


def confusion_top(df: DataFrame, n: int = 20, names: DataFrame | None = None) -> DataFrame:
    """Counts per pair, for the ``n`` most frequent true classes.

    Predictions outside those classes keep their own pairs. With ``names``, a table of ``value`` and
    ``code``, the classes are named too, in ``label_name`` and ``prediction_name``.
    """
    pairs = stage(confusion_counts(df), "pairs")
    totals = pairs.groupBy("label").agg(F.sum("pair_rows").alias("class_rows"))
    largest = totals.orderBy(F.desc("class_rows"), "label").limit(n).select("label")
    top = pairs.join(largest, "label", "left_semi")
    if names is None:
        return top
    for c in ("label", "prediction"):
        top = decode(top, names, c, f"{c}_name")
    return top


def in_most_frequent(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows whose true class is among the ``n`` most frequent ones."""
    return df.join(stage(most_frequent(df, label, n), "classes"), label, "left_semi")


def report(
    df: DataFrame,
    importance: DataFrame | None = None,
    ks: tuple[int, ...] = TOP_K,
    features: int = 15,
    names: DataFrame | None = None,
) -> DataFrame:
    """``(section, name, value)``: overall scores, per-class scores and the leading features.

    The predictions are read once. A top-k score beyond the number of classes is null. Classes go by
    the names in ``names``, a table of ``value`` and ``code``; without it, or without an entry, by number.
    """
    pairs = stage(_hit_counts(df, ks), "pairs")
    classes = per_class_of(pairs).withColumn("shown", F.col("class").cast("string"))
    if names is not None:
        named = decode(classes.drop("shown"), names, "class", "_name")
        classes = named.withColumn("shown", F.coalesce("_name", F.col("class").cast("string")))
    totals = pairs.agg(
        *_total_hits(ks), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("pair_rows"))).alias("hits")
    )

    def lines(frame: DataFrame, *entries: tuple[Column, Column, Column]) -> DataFrame:
        structs = [
            F.struct(s.alias("section"), n.alias("name"), v.cast("double").alias("value")) for s, n, v in entries
        ]
        return frame.select(F.inline(F.array(*structs)))

    overall = F.lit("overall")
    top_k = [
        (overall, F.lit(f"top_{k}_accuracy"), F.when(F.col("classes") >= k, F.col(f"hits_{k}") / F.col("pair_rows")))
        for k in ks
        if k > 1
    ]
    parts = [
        lines(totals, (overall, F.lit("accuracy"), F.coalesce(F.col("hits"), F.lit(0)) / F.col("pair_rows")), *top_k),
        lines(
            averages_of(classes),
            *[(overall, F.concat(F.col("average"), F.lit(f"_{s}")), F.col(s)) for s in ("precision", "recall", "f1")],
        ),
        lines(
            classes,
            *[
                (F.concat(F.lit("class "), F.col("shown")), F.lit(s), F.col(s))
                for s in ("precision", "recall", "f1", "support")
            ],
        ),
    ]
    if importance is not None:
        top = importance.orderBy(F.desc("importance"), "feature").limit(features)
        parts.append(lines(top, (F.lit("feature"), F.col("feature"), F.col("importance"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
