"""Random forests over histograms, for many classes at once.

One level of all trees is one job. A task holds its binned rows in the order of their classes and goes through the trees one
after another and through the rows in slices that stay in the processor's cache. Features whose bins come together in few ways
are counted as one, and the sums per feature are taken from those counts. The tables, rows per open node, class and bin, go on
in blocks of a few nodes, and the best split of a block's nodes is searched where its tables meet. The driver sees the splits
alone.

Rows enter as ``(features, label)`` with their number of copies, and what a tree draws of them is a hash of content, seed
and tree. Counts are whole numbers, exact in any order: one seed gives one model, whatever the partitions.

A split sends a row left if its bin is at or below the cut. Values that are missing have a bin of their own below all
others. Trees are complete binary heaps: node ``i`` has children ``2i+1`` and ``2i+2``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.plans.boosting import Boosted, bin_edges
from kerbstat.session import stage

# What tasks run of this module travels with them; executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

#: Rows that a task holds at once, rows that it counts and that it answers at once, and nodes whose tables travel together.
ROWS, SLICE, PART, BLOCK = 1 << 21, 1 << 15, 1 << 9, 8


@dataclass(frozen=True)
class Settings:
    """How to grow; the names and meanings are those of MLlib's forest."""

    numTrees: int = 20
    maxDepth: int = 5
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    subsamplingRate: float = 1.0
    bootstrap: bool = True
    featureSubsetStrategy: str = "auto"
    impurity: str = "gini"
    maxBins: int = 32
    seed: int = 42

    def subset(self, features: int) -> int:
        """Features that are tried at a node."""
        named = {
            "all": features,
            "sqrt": math.ceil(math.sqrt(features)),
            "log2": max(1, math.ceil(math.log2(features))),
            "onethird": math.ceil(features / 3),
        }
        strategy = self.featureSubsetStrategy
        if strategy == "auto":
            strategy = "all" if self.numTrees == 1 else "sqrt"
        if strategy in named:
            return named[strategy]
        return min(int(strategy), features) if strategy.isdigit() else math.ceil(float(strategy) * features)


@dataclass
class Forest:
    """Trees by number and node: feature (-1: none), cut, gain times rows, and rows per class."""

    grid: Boosted
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    @classmethod
    def empty(cls, grid: Boosted, trees: int, depth: int) -> Forest:
        shape = trees, (2 << depth) - 1
        return cls(grid, np.full(shape, -1, np.int16), np.zeros(shape, np.uint16), np.zeros(shape), np.zeros((*shape, grid.classes), np.int64))

    def pruned(self) -> Forest:
        """Without splits whose two leaves predict the same class."""
        feature = self.feature.copy()
        best = self.counts.argmax(axis=2)
        for node in range(feature.shape[1] // 2 - 1, -1, -1):
            left, right = 2 * node + 1, 2 * node + 2
            same = (feature[:, left] < 0) & (feature[:, right] < 0) & (best[:, left] == best[:, right])
            feature[same, node] = -1
        return Forest(self.grid, feature, self.cut, self.gain, self.counts)

    def reached(self) -> np.ndarray:
        """Whether rows can come to a node."""
        found = np.zeros(self.feature.shape, bool)
        found[:, 0] = True
        for node in range(found.shape[1] // 2):
            found[:, 2 * node + 1] = found[:, 2 * node + 2] = found[:, node] & (self.feature[:, node] >= 0)
        return found

    def importance(self) -> np.ndarray:
        """Shares of the features: gains over a tree's splits, scaled to 1 per tree and then over all trees."""
        shares = np.zeros(len(self.grid.features))
        splits = self.reached() & (self.feature >= 0)
        for feature, gain, own in zip(self.feature, self.gain, splits, strict=True):
            each = np.bincount(feature[own], gain[own], len(shares))
            if each.sum() > 0:
                shares += each / each.sum()
        return shares / shares.sum() if shares.sum() > 0 else shares


def mixed(key: np.ndarray, seed: int, number: int) -> np.ndarray:
    """Numbers in [0, 1), by a mix of a key's bits with seed and number."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def chances(copies: int, rate: float, bootstrap: bool) -> tuple[int, np.ndarray]:
    """``(least, cumulated)``: how often a tree draws any of a row's copies, Poisson with replacement and else binomial."""
    mean = copies * rate
    if not bootstrap and rate >= 1:
        return copies, np.ones(1)
    reach = 12 * math.sqrt(mean) + 32
    least, most = max(0, math.floor(mean - reach)), math.ceil(mean + reach)
    k = np.arange(least, (most if bootstrap else min(most, copies)) + 1, dtype=np.float64)
    ratio = mean / (k + 1) if bootstrap else (copies - k) / (k + 1) * (rate / (1 - rate))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio[:-1]))])
    cumulated = np.cumsum(np.exp(logs - logs.max()))
    cumulated /= cumulated[-1]
    return least, cumulated


#: Places of the rows with one number of copies, and their :func:`chances`; later places go before earlier ones.
Alike = list[tuple[np.ndarray | slice, int, np.ndarray]]


def alike(copies: np.ndarray, s: Settings, known: dict[int, tuple[int, np.ndarray]] | None = None) -> Alike:
    """The rows by their number of copies, the most frequent number first and as all rows; ``known`` keeps the chances."""
    known = {} if known is None else known
    numbers, often = np.unique(copies, return_counts=True)
    numbers = numbers[np.argsort(-often, kind="stable")].tolist()
    for n in numbers:
        if n not in known:
            known[n] = chances(n, s.subsamplingRate, s.bootstrap)
    return [(np.flatnonzero(copies == n) if i else slice(None), *known[n]) for i, n in enumerate(numbers)]


def times(at: np.ndarray, cumulated: np.ndarray) -> np.ndarray:
    """How many of ``cumulated`` are at or below each number; the first few, nearly all that there are, by comparison."""
    few = cumulated[:5]
    found = (at >= few[0]).view(np.uint8)
    for c in few[1:]:
        found += at >= c
    out = found.astype(np.float64)
    more = np.flatnonzero(found == len(few))
    if len(more):
        out[more] = np.searchsorted(cumulated, at[more], side="right")
    return out


def weights(key: np.ndarray, groups: Alike, number: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    at, out = mixed(key, seed, number), np.empty(len(key))
    for own, least, cumulated in groups:
        out[own] = times(at[own], cumulated) + least
    return out


def bin_matrix(frame: DataFrame, grid: Boosted, partitions: int | None = None) -> DataFrame:
    """``(key, label, copies, bins)``: rows that are equal in features and label are one, with their number."""
    kind = np.uint8 if grid.sizes().max(initial=0) <= 256 else np.uint16
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in grid.features]
    rows = frame.select(F.col("label").cast("int").alias("label"), *values)
    own = ["label", *grid.features]
    counted = rows.groupBy(*own).agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64(*own))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in grid.features]
            bins = np.ascontiguousarray(grid.bins(np.column_stack(values)).astype(kind)) if values else np.zeros((batch.num_rows, 0), kind)
            offsets = pa.py_buffer(np.arange(len(bins) + 1, dtype=np.int32) * np.int32(bins.shape[1] * bins.itemsize))
            packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, offsets, pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), batch.column("copies"), packed], ["key", "label", "copies", "bins"])

    dealt = counted.repartition(partitions, "key") if partitions else counted
    return dealt.mapInArrow(convert, "key bigint, label int, copies bigint, bins binary")


def held(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, labels, copies and bins of up to ``ROWS`` rows, or of a batch that is larger."""

    def packed(column: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)

    def joined(kept: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, label, copies = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in kept]) for c in ("key", "label", "copies"))
        return key, label, copies, np.concatenate([packed(b.column("bins")) for b in kept])

    kept, n = [], 0
    for batch in batches:
        if kept and n + batch.num_rows > ROWS:
            yield joined(kept)
            kept, n = [], 0
        kept.append(batch)
        n += batch.num_rows
    if n:
        yield joined(kept)


#: A code per row, and per code and feature the place of the feature's bin among all bins.
Group = tuple[np.ndarray, np.ndarray]


def joint_codes(bins: np.ndarray, sizes: np.ndarray, limit: int) -> list[Group]:
    """Groups of features whose bins come together in ``limit`` ways at most among the rows; a feature alone may have more."""
    groups: list[Group] = []
    starts, some = np.cumsum(sizes) - sizes, slice(None, None, max(1, len(bins) >> 15))

    def joined(code: np.ndarray, ways: int, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        both = code.astype(np.int64) * size + own
        return both, np.flatnonzero(np.bincount(both, minlength=ways * size))

    def numbered(both: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        place = np.zeros(n, np.uint16 if len(found) <= 1 << 16 else np.int32)
        place[found] = np.arange(len(found))
        return place[both]

    for f in np.argsort(-sizes, kind="stable").tolist():
        size, own = int(sizes[f]), bins[:, f]
        for i, (code, ways) in enumerate(groups):
            n = len(ways)
            if n * size > 64 * limit or len(joined(code[some], n, own[some], size)[1]) > limit:
                continue
            both, found = joined(code, n, own, size)
            if len(found) <= limit:
                groups[i] = numbered(both, found, n * size), np.column_stack([ways[found // size], starts[f] + found % size])
                break
        else:
            found = np.flatnonzero(np.bincount(own, minlength=size))
            groups.append((numbered(own, found, size), (starts[f] + found)[:, None]))
    return groups


TABLES = "tree int, block int, nodes binary, kind string, counts binary"


def level_tables(matrix: DataFrame, forest: Forest, level: int, open_: np.ndarray, s: Settings) -> DataFrame:
    """``TABLES``: rows per node, class and bin (of all features, one after another), of the open nodes of a level."""
    sizes, classes = forest.grid.sizes(), forest.grid.classes
    kind = np.uint8 if sizes.max(initial=0) <= 256 else np.uint16
    features, cuts = forest.feature, forest.cut

    def of_tree(number: int, rows_of: list[tuple], groups: list[Group], hot: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes = np.flatnonzero(open_[number])
        if not len(nodes):
            return
        n, place = len(nodes), np.full(open_.shape[1], -1, np.int64)
        place[nodes] = np.arange(n)
        feature, cut = features[number].astype(np.int64), cuts[number]
        inner = feature[: (1 << level) - 1]
        closed = bool((inner < 0).any() or (place[len(inner) : 2 * len(inner) + 1] < 0).any())
        tables = [np.zeros((classes, n, len(ways))) for _, ways in groups]
        for key, label, bins, groups_of, codes in rows_of:
            drawn = weights(key, groups_of, number, s.seed)
            rows = np.flatnonzero(drawn > 0)
            base, flat = rows * bins.shape[1], bins.ravel()
            node = np.zeros(len(rows), np.int64)
            for _ in range(level):
                tested = feature[node]
                if closed and (tested < 0).any():
                    goes = np.flatnonzero(tested >= 0)
                    rows, base, node, tested = rows[goes], base[goes], node[goes], tested[goes]
                tested += base
                right = flat[tested] > cut[node]
                node *= 2
                node += 1
                node += right
            at = place[node]
            if closed and (at < 0).any():
                goes = np.flatnonzero(at >= 0)
                rows, at = rows[goes], at[goes]
            if not len(rows):
                continue
            weight, first, last = drawn[rows], int(label[0]), int(label[-1])
            if last > first:
                at += (label[rows].astype(np.int64) - first) * n
            for code, table in zip(codes, tables, strict=True):
                ways = table.shape[2]
                cell = at * ways
                cell += code[rows]
                table[first : last + 1] += np.bincount(cell, weight, (last - first + 1) * n * ways).reshape(-1, n, ways)
        if not any(t.any() for t in tables[:1]):
            return
        sums = [t if h is None else t @ h for t, (_, h) in zip(tables, hot, strict=True)]
        most = max(t.max() for t in sums)
        small = next(k for k in ("u1", "u2", "u4", "i8") if most <= np.iinfo(k).max)
        whole = np.zeros((n, classes, int(sizes.sum())), small)
        for (columns, _), own in zip(hot, sums, strict=True):
            whole[:, :, columns] = own.transpose(1, 0, 2)
        blocks = range(0, n, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(blocks), pa.int32()),
                pa.array([b // BLOCK for b in blocks], pa.int32()),
                pa.array([nodes[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
                pa.array([small] * len(blocks), pa.string()),
                # Mostly zeros and small numbers: a tenth or so of their size.
                pa.array([pa.compress(whole[b : b + BLOCK].tobytes(), "lz4_raw", asbytes=True) for b in blocks], pa.binary()),
            ],
            ["tree", "block", "nodes", "kind", "counts"],
        )

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, label, copies, bins in held(batches, kind):
            order = np.argsort(label.astype(np.uint16) if classes <= 1 << 16 else label, kind="stable")
            key, label, copies, bins = key[order], label[order], copies[order], np.ascontiguousarray(bins[order])
            # Codes must be few beside the rows of a class and node, as each is counted and added to its bins.
            ways = len(key) // (4 * len(np.unique(label)) * max(int(open_.sum(axis=1).max()), 1))
            groups = joint_codes(bins, sizes, min(1024, ways))
            hot = []
            for _, ways in groups:
                columns = np.unique(ways)
                spread = None
                if ways.shape[1] > 1:
                    spread = np.zeros((len(ways), len(columns)))
                    spread[np.arange(len(ways))[:, None], np.searchsorted(columns, ways)] = 1
                hot.append((columns, spread))
            known: dict[int, tuple[int, np.ndarray]] = {}
            parts = [slice(at, at + SLICE) for at in range(0, len(key), SLICE)]
            rows_of = [(key[p], label[p], bins[p], alike(copies[p], s, known), [code[p] for code, _ in groups]) for p in parts]
            for number in range(len(open_)):
                yield from of_tree(number, rows_of, groups, hot)

    return matrix.mapInArrow(tables, TABLES)


SPLITS = "tree int, node int, feature int, cut int, gain double, below binary, total binary"


def value(x: np.ndarray, impurity: str) -> np.ndarray:
    """Minus rows times impurity, but for what depends on the number of rows of all parts alone; classes are axis 1."""
    n = x.sum(axis=1)
    if impurity == "gini":
        return (x * x).sum(axis=1) / np.maximum(n, 1)
    return (x * np.log2(np.maximum(x, 1))).sum(axis=1) - n * np.log2(np.maximum(n, 1))


def best_splits(table: np.ndarray, tried: np.ndarray, sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """``(feature, cut, gain, rows per class up to the cut)`` of each node; feature -1 without a split."""
    n = len(table)
    feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    below = np.zeros((n, table.shape[1]), np.int64)
    start = 0
    for f, size in enumerate(sizes.tolist()):
        own = table[:, :, start : start + size]
        start += size
        nodes = np.flatnonzero(tried[:, f])
        if not len(nodes):
            continue
        left = np.cumsum(own[nodes], axis=2)
        total, left = left[:, :, -1:].astype(np.float64), left[:, :, :-1].astype(np.float64)
        right = total - left
        rows = total.sum(axis=1)
        found = value(left, s.impurity) + value(right, s.impurity) - value(total, s.impurity)
        fewest = np.minimum(left.sum(axis=1), right.sum(axis=1))
        fits = (fewest >= max(s.minInstancesPerNode, 1)) & (found >= s.minInfoGain * rows)
        found = np.where(fits, found, 0.0)
        at = found.argmax(axis=1)
        most = found[np.arange(len(nodes)), at]
        better = np.flatnonzero((most > gain[nodes]) & (most > 1e-9))
        own = nodes[better]
        feature[own], cut[own], gain[own] = f, at[better], most[better]
        below[own] = left[better, :, at[better]].astype(np.int64)
    return feature, cut, gain, below


def splits_of(tables: DataFrame, grid: Boosted, s: Settings) -> DataFrame:
    """The best split of every node over the features that are drawn for it."""
    sizes, classes = grid.sizes(), grid.classes
    count = s.subset(len(sizes))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["tree"].iloc[0])
        nodes = np.frombuffer(rows["nodes"].iloc[0], np.int64)
        table = np.zeros((len(nodes), classes, int(sizes.sum())), np.int64)
        for small, counts in zip(rows["kind"], rows["counts"], strict=True):
            plain = pa.decompress(counts, table.size * np.dtype(small).itemsize, "lz4_raw")
            table += np.frombuffer(plain, small).reshape(table.shape)
        tried = np.zeros((len(nodes), len(sizes)), bool)
        for own, node in zip(tried, nodes.tolist(), strict=True):
            own[np.random.default_rng([s.seed, number, node]).choice(len(sizes), count, replace=False)] = True
        feature, cut, gain, below = best_splits(table, tried, sizes, s)
        total = table[:, :, : sizes[0]].sum(axis=2)
        return pd.DataFrame(
            {
                "tree": number, "node": nodes, "feature": feature, "cut": cut, "gain": gain,
                "below": [x.tobytes() for x in below], "total": [x.tobytes() for x in total],
            }
        )

    return tables.groupBy("tree", "block").applyInPandas(search, SPLITS)


def fit_forest(frame: DataFrame, features: list[str], classes: int, settings: Settings, partitions: int | None = None) -> Forest:
    """Grow ``settings.numTrees`` trees on rows ``(features, label)``; the frame is read more than once and should be staged."""
    s = settings
    grid = Boosted(features, bin_edges(frame, features, s.maxBins), classes)
    matrix = stage(bin_matrix(frame, grid, partitions), "bins")
    forest = Forest.empty(grid, s.numTrees, s.maxDepth)
    open_ = np.zeros(forest.feature.shape, bool)
    open_[:, 0] = True

    def wanted(counts: np.ndarray) -> bool:
        """Whether a node may have a split: two classes, and rows for two leaves."""
        return (counts > 0).sum() > 1 and counts.sum() >= 2 * s.minInstancesPerNode

    for level in range(s.maxDepth):
        found = splits_of(level_tables(matrix, forest, level, open_, s), grid, s).toArrow().to_pydict()
        open_ = np.zeros_like(open_)
        for t, node, feature, cut, gain, below, total in zip(*found.values(), strict=True):  # the open nodes
            below, total = np.frombuffer(below, np.int64), np.frombuffer(total, np.int64)
            forest.counts[t, node] = total
            if feature >= 0:
                left, right = 2 * node + 1, 2 * node + 2
                forest.feature[t, node], forest.cut[t, node], forest.gain[t, node] = feature, cut, gain
                forest.counts[t, left], forest.counts[t, right] = below, total - below
                open_[t, left], open_[t, right] = wanted(below), wanted(total - below)
        if not open_.any():
            break
    return forest.pruned()


def probabilities(forest: Forest) -> Callable[..., Column]:
    """A column function: the classes' chances, from an array of the features' values.

    Each tree gives the shares of the classes in a row's leaf; the forest gives their mean.
    """
    grid, features, cuts = forest.grid, forest.feature, forest.cut
    leaves = forest.reached() & (features < 0)
    rows = np.cumsum(leaves.ravel()).reshape(leaves.shape) - 1
    counts = forest.counts[leaves].astype(np.float64)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    number = np.arange(features.shape[1])
    trees = []
    for feature, cut, row in zip(features, cuts, rows, strict=True):
        split = feature >= 0
        deep = int(math.log2(int(np.flatnonzero(split)[-1]) + 1)) + 1 if split.any() else 0
        # A node without a split is its own left child, and all rows go left.
        tested = np.where(split, feature, 0).astype(np.int64), np.where(split, cut.astype(np.int64), 1 << 16)
        trees.append((deep, *tested, np.where(split, 2 * number + 1, number), row))

    def answers(bins: np.ndarray) -> np.ndarray:
        total, places = np.zeros((len(bins), grid.classes)), np.empty((len(trees), len(bins)), np.int64)
        flat, base = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for place, (deep, feature, cut, child, row) in zip(places, trees, strict=True):
            node = np.zeros(len(bins), np.int64)
            for _ in range(deep):
                at = feature[node]
                at += base
                right = flat[at] > cut[node]
                node = child[node]
                node += right
            place[:] = row[node]
        part = np.empty((PART, grid.classes))
        for at in range(0, len(bins), PART):
            own = total[at : at + PART]
            for place in places:
                own += np.take(shares, place[at : at + PART], axis=0, out=part[: len(own)], mode="clip")
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def found(values: pd.Series) -> pd.Series:
        bins = grid.bins(np.stack(values.to_numpy())) if len(values) else np.zeros((0, len(grid.features)), np.uint16)
        return pd.Series([row for at in range(0, len(bins), 8 * PART) for row in answers(bins[at : at + 8 * PART])], dtype=object)

    return found


def nodes_frame(spark: SparkSession, forest: Forest) -> DataFrame:
    """Every node that rows can reach: tree, node, feature (-1: a leaf), cut, gain, and rows per class as 64-bit integers."""
    tree, node = np.nonzero(forest.reached())
    columns = [pa.array(x.astype(np.int32)) for x in (tree, node, forest.feature[tree, node], forest.cut[tree, node])]
    counts = pa.array([x.astype("<i8").tobytes() for x in forest.counts[tree, node]], pa.binary())
    table = pa.Table.from_arrays([*columns, pa.array(forest.gain[tree, node]), counts], ["tree", "node", "feature", "cut", "gain", "counts"])
    return spark.createDataFrame(table)


NODES = "tree int, node int, feature int, cut int, gain double, counts binary"


def from_nodes(nodes: DataFrame, grid: Boosted) -> Forest:
    """Back from :func:`nodes_frame`."""
    table = nodes.select("tree", "node", "feature", "cut", "gain", "counts").toArrow()
    tree, node, feature, cut, gain = (table.column(c).to_numpy() for c in ("tree", "node", "feature", "cut", "gain"))
    forest = Forest.empty(grid, int(tree.max()) + 1, int(math.log2(int(node.max()) + 1)))
    forest.feature[tree, node], forest.cut[tree, node], forest.gain[tree, node] = feature, cut, gain
    forest.counts[tree, node] = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8").reshape(len(tree), -1)
    return forest
