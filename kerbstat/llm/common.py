"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbstat.session import stage

#: The six white-space characters of ASCII: space and \\x09 to \\x0D.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, as an array."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def running_ends(lengths: Column, block: int = 256) -> Column:
    """Prefix sums of an array, in blocks, so that long arrays do not cost their square."""

    def grow(part: Column, first: Column) -> Column:
        sums = F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 2, F.size(sums))

    def blocks(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
        zero = F.lit(0).cast("bigint")

        def joined(ps: Column) -> Column:
            totals = F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
            firsts = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
            return let(firsts, lambda f: F.flatten(F.transform(ps, lambda p, b: grow(p, F.get(f, b)))))

        return let(parts, joined)

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, blocks(xs)).otherwise(F.array().cast("array<bigint>")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def bounded_sample(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """The rows of a table of ``total`` rows whose column hashes lowest, ``rows`` at most, in that order.

    A bound on the hash takes about as many rows from every task, so that no task sorts more than it has
    to and few reach the one that cuts the sample to size.
    """
    low = F.shiftrightunsigned(F.xxhash64(column), 2)
    bound = min(1.0, 1.1 * rows / max(1, total))
    return df.select(column).where(low <= F.lit(int(bound * (2**62 - 1)))).orderBy(low, column).limit(rows)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of ``a[i]`` and ``b[i]``; a class is named by its smallest member."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (label[label] != label).any():
            label = label[label]


def star_edges(nodes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not its class's first, with that first: as many rows as nodes at most."""
    rest = np.flatnonzero(label != np.arange(len(label)))
    return nodes[rest], nodes[label[rest]]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a bigint, b bigint)``; the root is the smallest node reachable.

    Alternating stars: every edge is re-hung on the smallest neighbour, first of its larger and then of
    its smaller end, until all edges are spokes of a root. A round is two aggregations and two joins on
    the edges, never a list of neighbours, so that a hub is no group in memory. Each round is staged.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        facts = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if facts["n"] == 0 or (facts["n"], facts["x"]) == seen:
            break
        seen = facts["n"], facts["x"]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        spokes = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        hung = low.select("a", F.col("m").alias("b"))
        e = stage(spokes.unionByName(hung).distinct(), "edges")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def slices(batch: pa.RecordBatch, text: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text at most (one row at least)."""
    lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = ends[at] - lengths[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


#: Bytes of words (digits, letters, everything beyond ASCII), with A-Z lower-cased; all else is a blank.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def translated(texts: pa.StringArray, to: bytes = PLAIN) -> pa.StringArray:
    """Texts with each byte replaced by its entry of ``to``, which maps ASCII to ASCII."""
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    begins = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begins[0] : begins[-1]]
    new = np.frombuffer(to, dtype=np.uint8)[data]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(begins - begins[0]), pa.py_buffer(new))


def coded_words(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of :data:`PLAIN` texts (the empty one may be among them), the word at each place, its text."""
    split = pa.compute.ascii_split_whitespace(translated(texts))
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    place = coded.indices.to_numpy(zero_copy_only=False)
    empty = pa.compute.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = place != empty
    return coded.dictionary, place[real], text[real]
