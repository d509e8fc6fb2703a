"""Near-duplicates by SimHash: fingerprints, a vantage-point tree over them, exact pairs, components.

A vantage-point tree cuts the Hamming space: a node has a point and a radius, fingerprints within the
radius go to the inner child. The leaves are shards. Two fingerprints within ``max_bits`` of each other
either share a shard or lie on two sides of a boundary that one of them is near to; by the triangle
inequality it is enough to send the outer ones within ``max_bits`` of a radius to the inner side as
visitors, and visitors to every child that the bound does not exclude. Each shard then compares its own
rows with each other and with its visitors, bit by bit. The result is exact whatever the tree; the tree,
fitted on a bounded sample, only decides how much is compared.

Equal fingerprints are one node, so that groups of copies of any size cost nothing. A shard larger than
``BLOCK`` is compared in blocks by several tasks. A task passes on at most one edge per row it holds
(to the first row of the local class), never all pairs.

Nulls and edge cases: a null text counts as empty; a text without a word has fingerprint zero and is
linked like any other; fewer words than a shingle give one shingle of all words; a null id keeps its row
and takes the component's smallest id; repeated rows get a row each; an empty table gives no rows.
Only the id and the text are read, so other columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kerbstat.llm.common import bounded_sample, components, merge_labels, star_edges
from kerbstat.session import stage

#: Rows that the tree is fitted on: so many per shard, and at most (16 MB). Rows that a shard has at least, rows of a block.
#: Around the middle of 64 bits a shell of two bits on either side holds more than a third of prints without structure, so
#: every level makes 1.4 times as many visitors; smaller shards still cost less than comparing more prints.
PER_SHARD, SAMPLE, SHARD, BLOCK = 16, 1 << 21, 2_048, 8_192
SEED = 42
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: a bit is 1 if it is set in more than half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    planes = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the 64 bits as a long; ``text_hash`` tells rows with one id apart."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    picked = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column)
    )
    return picked.mapInArrow(compute, "doc_id bigint, text_hash bigint, fp bigint")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


class VantageTree:
    """A complete tree of vantage points; node ``i`` has children ``2i+1`` (inner) and ``2i+2``."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.points = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radii = np.zeros(len(self.points), dtype=np.int16)
        members = [sample]
        for node in range(len(self.points)):
            own = members[node]
            if len(own):
                distances = hamming(own, own[0])
                self.points[node], self.radii[node] = own[0], int(np.median(distances))
                inner = distances <= self.radii[node]
                members += [own[inner], own[~inner]]
            else:
                members += [own, own]

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The shard of each fingerprint."""
        node = np.zeros(len(fps), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (hamming(fps, self.points[node]) > self.radii[node])
        return node - len(self.points)

    def visits(self, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, shard)`` of the other shards in which a row may find one that is not sent to it."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        visitor = np.zeros(len(fps), dtype=bool)
        for _ in range(self.depth):
            distance, radius = hamming(fps[row], self.points[node]).astype(np.int16), self.radii[node]
            outside = distance > radius
            to_inner = ~outside | (distance <= radius + bits)
            to_outer = outside | (visitor & (distance > radius - bits))
            inner_visits = visitor | outside
            row = np.concatenate([row[to_inner], row[to_outer]])
            node = np.concatenate([2 * node[to_inner] + 1, 2 * node[to_outer] + 2])
            visitor = np.concatenate([inner_visits[to_inner], visitor[to_outer]])
        return row[visitor], node[visitor] - len(self.points)


def linked_stars(home: np.ndarray, other: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links of ``home`` x ``other`` join, one per row at most."""
    nodes, where = np.unique(np.concatenate([home, other]), return_inverse=True)
    left, right = where[: len(home)], where[len(home) :]
    label = np.arange(len(nodes))
    step = max(1, 1_000_000 // max(1, len(other)))
    for i in range(0, len(home), step):
        a, b = np.nonzero(hamming(home[i : i + step, None], other[None, :]) <= bits)
        label = merge_labels(label, left[a + i], right[b])
    return star_edges(nodes, label)


def depth_for(total: int, shard_rows: int = SHARD) -> int:
    """Levels of a tree for so many fingerprints."""
    return max(0, min(int(math.log2(max(1, total / shard_rows))), int(math.log2(SAMPLE // PER_SHARD))))


def link_edges(distinct: DataFrame, max_bits: int, shard_rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: edges that connect exactly what links at ``max_bits`` or fewer bits connect.

    ``distinct`` has one row per fingerprint, in a column ``fp``. The tree's depth follows the table, up to
    ``SAMPLE / PER_SHARD`` shards; larger tables have larger shards. The sample, the first rows by hash, is bounded; so is
    the tree, and with it the table of shard sizes that comes to the driver.
    """
    total = distinct.count()
    depth = depth_for(total, shard_rows)
    picked = bounded_sample(distinct, "fp", PER_SHARD << depth, total).toPandas()["fp"]
    sample = picked.to_numpy(dtype=np.int64).view(np.uint64)
    tree = VantageTree(sample, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard = tree.visits(fps, max_bits)
            shards = np.concatenate([tree.homes(fps), shard])
            roles = np.concatenate([np.zeros(len(fps), bool), np.ones(len(row), bool)])
            rows = np.concatenate([fps, fps[row]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(roles), pa.array(rows)], ["shard", "visitor", "fp"])

    placed = distinct.select("fp").mapInArrow(place, "shard bigint, visitor boolean, fp bigint")
    sizes = np.zeros((1 << depth, 2), dtype=np.int64)
    for shard, visitor, n in placed.groupBy("shard", "visitor").count().collect():
        sizes[shard, int(visitor)] = n
    blocks = np.maximum(1, -(-sizes // block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row goes to every pair of blocks it takes part in: (own i, own j >= i) and (own i, visiting j)."""
        for batch in batches:
            shard, visitor = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).to_numpy(zero_copy_only=False)
            own, visiting = blocks[shard, 0], blocks[shard, 1] * (sizes[shard, 1] > 0)
            part = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            part %= np.where(visitor, np.maximum(visiting, 1), own)
            copies = np.where(visitor, own, own + visiting)
            at = np.repeat(np.arange(len(fps)), copies)
            k = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            mine, is_visitor = part[at], visitor[at]
            with_own = ~is_visitor & (k < own[at])
            i = np.where(is_visitor, k, np.where(with_own, np.minimum(mine, k), mine))
            j = np.where(is_visitor, own[at] + mine, np.where(with_own, np.maximum(mine, k), k))
            second = is_visitor | (with_own & (k < mine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (shard[at], i, j, second, fps[at])], ["shard", "i", "j", "second", "fp"]
            )

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps, second = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64), rows["second"].to_numpy(dtype=bool)
        home = fps[~second]
        a, b = linked_stars(home, home if key[1] == key[2] else fps[second], max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = placed.mapInArrow(deal, "shard bigint, i bigint, j bigint, second boolean, fp bigint")
    return dealt.groupBy("shard", "i", "j").applyInPandas(pairs, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, root)`` of every row.

    ``component_id`` is the smallest id in the component; ``root`` names the component by its
    smallest fingerprint.
    """
    marked, named = components_of(docs, shingle, max_bits, id_column, text_column)
    named = named.select("fp", "root", F.col("first.doc_id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def components_of(
    docs: DataFrame, shingle: int, max_bits: int, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and ``(fp, root, first)`` per fingerprint.

    ``first`` is the component's first document, by id with nulls last, then by the hash of its text.
    Rows are reduced to one per fingerprint before anything is joined.
    """
    marked = stage(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = stage(marked.groupBy("fp").agg(F.min(order).alias("own")), "distinct")
    roots = components(link_edges(distinct, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root")
    )
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("own").alias("least"))
    return marked, rooted.join(smallest, "root", "left").select("fp", "root", F.coalesce("least", "own").alias("first"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``; all columns as they came.

    Of rows with one id and one text, one stays. A component without any id keeps one document.
    """
    _, named = components_of(docs, shingle, max_bits)
    first = named.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"),
    )
    kept = rows.alias("r").join(
        first.alias("f"), F.expr("r._id <=> f._id and r._hash = f._hash"), "left_semi"
    )
    return kept.dropDuplicates(["_id", "_hash"]).select("_row.*")
