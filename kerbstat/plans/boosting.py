"""Softmax gradient boosting over histograms, for many classes at once.

Every round grows one tree whose leaves hold a value per class. The state of a round is small: a row keeps
its binned features and, every few rounds, its margins; in between these come from the trees. One level of a
tree is one job: tasks sum the first and second derivatives of the softmax loss per node, bin (of all features) and class, as a
product of matrices for each node, and the best split of a node is searched where its tables meet. The driver sees the splits
alone, one a node.

Derivatives are rounded to multiples of 2^-20 and summed as whole numbers, exact in any order: one seed gives one model, whatever the partitions. Rows and features of a tree are drawn by hashes of
seed, round and id.

A split sends a row left if its bin is at or below the cut. Values that are missing have a bin of their own
below all others. A feature with ``max_bins`` different values or fewer has a bin for each; others are cut at
quantiles.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.session import stage

# What tasks run of this module travels with them; executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 20)
#: Second derivatives are at least this.
LEAST_HESSIAN = 2 / UNIT


@dataclass(frozen=True)
class Settings:
    """How to boost. ``stored`` is the number of rounds after which margins are written anew."""

    rounds: int = 200
    depth: int = 8
    rate: float = 0.1
    child_weight: float = 5.0
    subsample: float = 0.8
    colsample: float = 0.8
    ridge: float = 1.0
    max_bins: int = 256
    stored: int = 10
    seed: int = 42


@dataclass
class Tree:
    """A complete binary tree: node ``i`` has children ``2i+1`` (at or below the cut) and ``2i+2``."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, classes: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros((n, classes)))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        number, split = np.arange(len(self.feature)), self.feature >= 0
        deep = int(math.log2(int(np.flatnonzero(split)[-1]) + 1)) + 1 if split.any() else 0
        # A node without a split is its own left child, and all rows go left.
        feature, cut, child = np.where(split, self.feature, 0).astype(np.int64), np.where(split, self.cut, 1 << 16), np.where(split, 2 * number + 1, number)
        node, flat, base = np.zeros(len(bins), np.int64), np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(deep):
            at = feature[node]
            at += base
            right = flat[at] > cut[node]
            node = child[node]
            node += right
        return node


@dataclass
class Boosted:
    """Trees and the edges of the features' bins: bin ``k`` holds values above edge ``k - 1``, up to edge ``k``."""

    features: list[str]
    edges: list[np.ndarray]
    classes: int
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values: 0 where missing, and from 1 on by the edges."""
        columns = [np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v)) for v, e in zip(values.T, self.edges, strict=True)]
        return np.column_stack(columns).astype(np.uint16) if columns else np.zeros((len(values), 0), np.uint16)

    def sizes(self) -> np.ndarray:
        """Bins per feature: the missing one, one up to each edge, and one above."""
        return np.array([len(e) + 2 for e in self.edges], dtype=np.int64)

    def since(self, first: int) -> Boosted:
        """The trees from ``first`` on, all that tasks need beside stored margins."""
        return Boosted([], [], self.classes, self.trees[first:])

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> Iterator[np.ndarray]:
        """Sums of leaf values after each tree from ``first`` on; the array is updated in place."""
        total = np.zeros((len(bins), self.classes)) if start is None else start.copy()
        for tree in self.trees[first:]:
            total += tree.value[tree.leaves(bins)]
            yield total

    def final_margins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        start = start if start is not None and start.shape[1] else None
        total = np.zeros((len(bins), self.classes)) if start is None else start
        for total in self.margins(bins, start, first):
            pass
        return total


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(margins: np.ndarray, label: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """First derivatives of the softmax loss by class, and second ones beside them, in whole units; ``margins`` are overwritten."""
    n, classes = margins.shape
    out = np.empty((n, 2 * classes)) if out is None else out
    p, second = margins, out[:, classes:]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    np.subtract(1, p, out=second)
    second *= p
    second *= 2
    np.maximum(second, LEAST_HESSIAN, out=second)
    p[np.arange(n), label] -= 1
    np.multiply(p, UNIT, out=out[:, :classes])
    second *= UNIT
    return np.rint(out, out=out)


def drawn(key: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Whether a row is in the sample of a round, by a mix of its key's bits with seed and round."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def drawn_features(n: int, seed: int, number: int, share: float) -> np.ndarray:
    rng = np.random.default_rng([seed, number])
    return np.sort(rng.choice(n, max(1, round(share * n)), replace=False))


def matrix_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels, bins and margins of a batch of the staged matrix; margins that are all zero have no columns."""

    def rows(name: str, kind: type) -> np.ndarray:
        column = batch.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        if offsets[0] == offsets[-1]:
            return np.zeros((len(column), 0), kind)
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)

    key, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label"))
    return key, label, rows("bins", np.uint16), rows("margins", np.float64)


MATRIX = "key bigint, label int, bins binary, margins binary"


def packed(key: np.ndarray, label: np.ndarray, bins: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    def binary(x: np.ndarray) -> pa.Array:
        width = x.shape[1] * x.itemsize
        offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])

    columns = [pa.array(key), pa.array(label.astype(np.int32)), binary(bins), binary(margins)]
    return pa.RecordBatch.from_arrays(columns, ["key", "label", "bins", "margins"])


#: Rows that a task works on at once, so that a batch's margins and derivatives stay small.
ROWS = 8_192
#: Rows whose tables are summed together, rows whose derivatives and products stay in the processor's cache, and nodes whose
#: tables travel together.
HELD, PART, BLOCK = 32_768, 2_048, 4


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, labels, bins and margins of about ``HELD`` rows."""
    kept: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            kept.append(matrix_columns(batch.slice(at, HELD)))
            if sum(len(k[0]) for k in kept) >= HELD:
                yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                kept = []
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def in_batches(work: Callable[[pa.RecordBatch], None], batches: Iterator[pa.RecordBatch]) -> Iterator:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield work(whole.slice(at, ROWS))


def bin_edges(frame: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Edges of the features' bins: all values where there are ``max_bins`` at most, else quantiles.

    Both come from sketches of bounded size, in one pass each.
    """
    doubles = frame.select([F.col(c).cast("double").alias(c) for c in features])
    counts = doubles.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in features]).first()
    few = [c for c in features if counts[c] <= 1.2 * max_bins]
    found: dict[str, list[float]] = {}
    if few:
        values = doubles.select(few).unpivot([], few, "feature", "value").where("value is not null and not isnan(value)").distinct()
        for row in values.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
            found[row["feature"]] = row["v"]
    edges = {c: v[:-1] for c, v in found.items() if len(v) <= max_bins}  # the last value is above all edges
    for c in features:
        if c not in few or len(found.get(c, [])) > max_bins:
            shares = [k / max_bins for k in range(1, max_bins)]
            edges[c] = sorted(set(doubles.approxQuantile(c, shares, 0.1 / max_bins)))
    return [np.array(edges.get(c, []), dtype=np.float64) for c in features]


def binned(frame: DataFrame, boosted: Boosted, id_column: str, partitions: int | None = None) -> DataFrame:
    """The matrix: a key per row (a hash of its id), label, bins, and margins of zero, which take no bytes."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in boosted.features]).astype(np.float64)
        key, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "label"))
        return packed(key, label, boosted.bins(values), np.zeros((len(key), 0)))

    columns = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in boosted.features]
    rows = frame.select(F.xxhash64(id_column).alias("_key"), F.col("label").cast("int").alias("label"), *columns)
    return rows.mapInArrow(lambda batches: in_batches(convert, batches), MATRIX)


TABLES = "block int, nodes binary, sums binary"


def level_tables(matrix: DataFrame, boosted: Boosted, tree: Tree, level: int, chosen: np.ndarray, first: int, s: Settings) -> DataFrame:
    """``TABLES`` of a level: per node and bin of the chosen features, the sums of both derivatives over the round's sample.

    ``boosted`` has the trees of the rounds before; those from ``first`` on are not in the stored margins.
    """
    round_, sizes, classes, since = len(boosted.trees), boosted.sizes()[chosen], boosted.classes, boosted.since(first)
    least, starts, width = (1 << level) - 1, np.cumsum(sizes) - sizes, int(sizes.sum())

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        hot, every = np.zeros((PART, width)), np.arange(PART)[:, None]
        for key, label, bins, margins in gathered(batches):
            some = np.flatnonzero(drawn(key, s.seed, round_, s.subsample))
            node = tree.leaves(bins[some])
            order = np.flatnonzero(node >= least)
            order = order[np.argsort((node[order] - least).astype(np.uint16) if level < 16 else node[order], kind="stable")]
            some, node = some[order], node[order]
            columns, both = bins[some][:, chosen] + starts, np.empty((len(some), 2 * classes))
            for at in range(0, len(some), PART):
                own = some[at : at + PART]
                derivatives(since.final_margins(bins[own], margins[own]), label[own], both[at : at + PART])
            edges = [*np.flatnonzero(np.diff(node, prepend=-1)).tolist(), len(node)]
            for start, end in zip(edges, edges[1:], strict=False):
                table = held.get(int(node[start]))
                if table is None:
                    table = held[int(node[start])] = np.zeros((width, 2 * classes))
                for at in range(start, end, PART):
                    own = slice(at, min(at + PART, end))
                    n = own.stop - own.start
                    hot[every[:n], columns[own]] = 1
                    table += hot[:n].T @ both[own]
                    hot[every[:n], columns[own]] = 0
        blocks: dict[int, list[int]] = {}
        for n in sorted(held):
            blocks.setdefault((n - least) // BLOCK, []).append(n)
        for block, nodes in blocks.items():
            sums = np.stack([held.pop(n) for n in nodes]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([np.array(nodes, np.int64).tobytes()], pa.binary()), pa.array([sums], pa.binary())],
                ["block", "nodes", "sums"],
            )

    return matrix.mapInArrow(tables, TABLES)


SPLITS = "node int, feature int, cut int, gain double, below binary, total binary"


def best_split(table: np.ndarray, classes: int, s: Settings) -> tuple[int, float, np.ndarray, np.ndarray]:
    """``(place of the cut, gain, sums up to it, all sums)`` of a feature's sums by bin; the place is -1 without a split."""
    below, total = np.cumsum(table, axis=0)[:-1] / UNIT, table.sum(axis=0) / UNIT

    def value(x: np.ndarray) -> np.ndarray:
        return (x[..., :classes] ** 2 / (x[..., classes:] + s.ridge)).sum(axis=-1)

    above = total - below
    gain = 0.5 * (value(below) + value(above) - value(total))
    weight = np.minimum(below[:, classes:].sum(axis=1), above[:, classes:].sum(axis=1))
    gain = np.where(weight >= s.child_weight, gain, -np.inf)
    cut = int(np.argmax(gain)) if len(gain) else -1
    if cut < 0 or not gain[cut] > 1e-9:
        return -1, 0.0, total, total
    return cut, float(gain[cut]), below[cut], total


def splits_of(tables: DataFrame, boosted: Boosted, chosen: np.ndarray, s: Settings, each: bool = False) -> DataFrame:
    """The best split of every node, or of every node and feature; the cut is -1 without one. Sums are 64-bit floats."""
    sizes, classes = boosted.sizes()[chosen], boosted.classes
    starts, width = np.cumsum(sizes) - sizes, int(sizes.sum())

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """All tables of a few nodes; a task has tables of the nodes that its rows reach."""
        tables: dict[int, np.ndarray] = {}
        for nodes, sums in zip(rows["nodes"], rows["sums"], strict=True):
            numbers = np.frombuffer(nodes, np.int64).tolist()
            for n, own in zip(numbers, np.frombuffer(sums, np.float64).reshape(len(numbers), width, 2 * classes), strict=True):
                tables[n] = tables[n] + own if n in tables else own
        out = []
        for n, table in tables.items():
            found = []
            for f, start, size in zip(chosen.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                own = table[start : start + size]
                bins = np.flatnonzero(own.any(axis=1))
                at, gain, below, total = best_split(own[bins], classes, s)
                found.append((n, f, int(bins[at]) if at >= 0 else -1, gain, below.tobytes(), total.tobytes()))
            out += found if each else [min(found, key=lambda r: (-r[3], r[1], r[2]))]
        return pd.DataFrame(out, columns=["node", "feature", "cut", "gain", "below", "total"])

    return tables.groupBy("block").applyInPandas(search, SPLITS)


def grow(matrix: DataFrame, boosted: Boosted, first: int, s: Settings) -> Tree:
    """The next tree; a level at a time."""
    chosen = drawn_features(len(boosted.features), s.seed, len(boosted.trees), s.colsample)
    tree, k = Tree.empty(s.depth, boosted.classes), boosted.classes

    def settle(node: int, sums: np.ndarray) -> None:
        tree.value[node] = -s.rate * sums[:k] / (sums[k:] + s.ridge)
        tree.cover[node] = sums[k:].sum()

    for level in range(s.depth):
        found = splits_of(level_tables(matrix, boosted, tree, level, chosen, first, s), boosted, chosen, s).toArrow().to_pydict()
        more = False
        for node, feature, cut, gain, below, total in zip(*found.values(), strict=True):  # the level's nodes
            below, total = np.frombuffer(below), np.frombuffer(total)
            settle(node, total)
            if cut >= 0:
                tree.feature[node], tree.cut[node], tree.gain[node], more = feature, cut, gain, True
                settle(2 * node + 1, below)
                settle(2 * node + 2, total - below)
        if not more:
            break
    return tree


def fit_boosted(frame: DataFrame, features: list[str], classes: int, settings: Settings | None = None, id_column: str = "summons_number") -> Boosted:
    """Boost ``settings.rounds`` trees on rows ``(id, features, label)``; the frame is read twice and should be staged."""
    s = settings or Settings()
    boosted = Boosted(features, bin_edges(frame, features, s.max_bins), classes)
    matrix, first = stage(binned(frame, boosted, id_column), "matrix"), 0
    for number in range(s.rounds):
        if number - first == s.stored:
            matrix, first = stage(advanced(matrix, boosted, first), "matrix"), number
        boosted.trees.append(grow(matrix, boosted, first, s))
    return boosted


def first_splits(frame: DataFrame, features: list[str], classes: int, settings: Settings | None = None, id_column: str = "summons_number") -> DataFrame:
    """``(feature, cut, gain)``: what each feature alone would give at the root of the first tree, over all rows.

    ``cut`` is the largest value that goes left; features without a split are left out. One aggregation.
    """
    s = replace(settings or Settings(), subsample=1.0, colsample=1.0)
    boosted = Boosted(features, bin_edges(frame, features, s.max_bins), classes)
    everything = np.arange(len(features))
    tables = level_tables(binned(frame, boosted, id_column), boosted, Tree.empty(1, classes), 0, everything, 0, s)
    found = splits_of(tables, boosted, everything, s, each=True).where("cut >= 0").select("feature", "cut", "gain")
    edges = [(i, k + 1, features[i], float(v)) for i, e in enumerate(boosted.edges) for k, v in enumerate(e)]
    edges += [(i, 0, features[i], None) for i in range(len(features))]  # a split off of the missing ones
    named = frame.sparkSession.createDataFrame(edges, "feature int, cut int, name string, value double")
    return found.join(named, ["feature", "cut"]).select(F.col("name").alias("feature"), F.col("value").alias("cut"), "gain")


def advanced(matrix: DataFrame, boosted: Boosted, first: int) -> DataFrame:
    """The matrix with the trees from ``first`` on added to its margins."""

    since = boosted.since(first)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, label, bins, margins = matrix_columns(batch)
        return packed(key, label, bins, since.final_margins(bins, margins))

    return matrix.mapInArrow(lambda batches: in_batches(add, batches), MATRIX)


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def probabilities(boosted: Boosted) -> Callable[..., Column]:
    """A column function: the classes' chances, from an array of the features' values."""

    @F.pandas_udf("array<double>")
    def chances(values: pd.Series) -> pd.Series:
        bins = boosted.bins(np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(boosted.features))))
        parts = [softmax(boosted.final_margins(bins[i : i + ROWS])) for i in range(0, len(bins), ROWS)]
        return pd.Series([row for part in parts for row in part])

    return chances


def staged_scores(frame: DataFrame, boosted: Boosted, part: str = "split") -> DataFrame:
    """``(part, round, rows, logloss, error)``: the loss and the share of wrong classes after every round, from 1.

    Rows have the features, ``label`` and ``part``. One pass: a task sends on one row per part and round.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str | None, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                parts, label = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
                names, own = np.unique([str(p) if p is not None else "" for p in parts], return_inverse=True)
                bins = boosted.bins(np.stack([np.asarray(v) for v in batch.column(2).to_pylist()]))
                for number, margins in enumerate(boosted.margins(bins), 1):
                    p = softmax(margins)
                    loss = -np.log(np.maximum(p[np.arange(len(label)), label], 1e-16))
                    wrong = p.argmax(axis=1) != label
                    counts = [np.bincount(own, w, len(names)) for w in (np.ones(len(label)), loss, wrong)]
                    for name, entry in zip(names.tolist(), np.column_stack(counts), strict=True):
                        sums[name, number] = sums.get((name, number), 0) + entry
        keys = list(sums)
        values = np.array([sums[k] for k in keys]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array(v) for v in values.T)],
            [part, "round", "n", "loss", "wrong"],
        )

    rows = frame.select(F.col(part).cast("string"), F.col("label").cast("int"), feature_array(boosted.features).alias("values"))
    each = rows.mapInArrow(score, f"{part} string, round int, n double, loss double, wrong double")
    return each.groupBy(part, "round").agg(
        F.sum("n").cast("bigint").alias("rows"), (F.sum("loss") / F.sum("n")).alias("logloss"), (F.sum("wrong") / F.sum("n")).alias("error")
    )


NODES = "round int, node int, feature int, cut int, gain double, cover double, value array<double>"


def nodes_frame(spark: SparkSession, boosted: Boosted) -> DataFrame:
    """Every node of every tree that rows can reach: split nodes with feature, cut, gain; all with cover and value."""
    rows = [
        (number, n, int(t.feature[n]), int(t.cut[n]), float(t.gain[n]), float(t.cover[n]), t.value[n].tolist())
        for number, t in enumerate(boosted.trees) for n in np.flatnonzero(t.cover > 0).tolist()
    ]
    return spark.createDataFrame(rows, NODES)


def from_nodes(nodes: DataFrame, features: list[str], edges: list[np.ndarray], classes: int) -> Boosted:
    """Back from :func:`nodes_frame`."""
    trees: dict[int, list] = {}
    for r in nodes.collect():
        trees.setdefault(r["round"], []).append(r)
    boosted = Boosted(features, edges, classes)
    for number in sorted(trees):
        depth = max(math.floor(math.log2(r["node"] + 1)) for r in trees[number])
        tree = Tree.empty(depth, classes)
        for r in trees[number]:
            n = r["node"]
            tree.feature[n], tree.cut[n], tree.gain[n], tree.cover[n], tree.value[n] = r["feature"], r["cut"], r["gain"], r["cover"], r["value"]
        boosted.trees.append(tree)
    return boosted


def split_importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, importance, splits, gain, cover)`` from the stored nodes, most important first.

    ``gain`` and ``cover`` are means per split; the importance is the mean gain, scaled to sum up to 1.
    """
    spark = nodes.sparkSession
    named = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    own = nodes.where("feature >= 0").groupBy("feature").agg(
        F.count("*").alias("splits"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover")
    )
    table = named.join(own, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("cover", F.lit(0.0)).alias("cover"),
    )
    total = table.agg(F.sum("gain")).first()[0] or 1.0
    shares = table.select("feature", (F.col("gain") / total).alias("importance"), "splits", "gain", "cover")
    return shares.orderBy(F.desc("importance"), "feature")
