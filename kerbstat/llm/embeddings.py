"""Near-duplicate vectors by product quantisation.

1. Vectors of one label and length are comparable; exact copies become one entry with a count.
2. On a bounded sample, k-means fits coarse centroids, and codebooks per subspace for what is left after
   subtracting the centroid. Every entry is then indexed: its list, its codes, and its exact quantisation error.
3. Every entry queries the lists that can hold a link. A vector within distance ``t`` can lie across a
   boundary between two lists only if the two are within ``t`` of that boundary together, so that one of
   them is within ``t / 2``; of ``t`` the share ``reach`` is asked for. At 1/2, the default, and above this
   loses nothing, whatever the vectors and their length; below, links may be lost.
4. In a list, distances come from a table lookup per subspace. As each entry's quantisation error is known,
   the triangle inequality tells which entries cannot link; the rest get their exact cosine. An entry carries
   the set of lists it probes: a link counts for the query, and for the entry too unless that probes the
   query's list and finds the link there itself.

Lists that are hot are dealt out in blocks of ``BLOCK`` entries by ``BLOCK`` queries. A task returns a count
per query and per entry and at most one edge per entry (to the first of the local class), never its pairs.

Nulls and edge cases: a vector that is null or zero, or holds null or non-finite components, or has a null
label links with nothing and is its own component; vectors of different lengths do not link; a null id is
kept, and a component takes its smallest id that is not null; repeated rows are copies and link with each
other; an empty table gives no rows; only the id, the vector and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kerbstat.llm.common import bounded_sample, components, merge_labels, star_edges
from kerbstat.session import stage

#: Sampled entries, entries aimed at per list of a label, subspaces, codewords, rounds of k-means.
SAMPLE, LIST, SUBSPACES, CODEWORDS, ROUNDS = 32_768, 1_024, 8, 64, 8
#: Entries, and queries, of a list that one task compares.
BLOCK = 4_096


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, begun at rows spread over the input; the same for the same rows."""
    k = max(1, min(k, len(rows)))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)[0]
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and all squared distances."""
    squares = np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None, :], 0)
    return squares.argmin(1), squares


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids and codebooks for unit vectors of one length."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @staticmethod
    def fit(units: np.ndarray, lists: int) -> Quantiser:
        size = units.shape[1]
        edges = np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int).tolist()
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        centres = k_means(units, lists)
        rest = units - centres[nearest(units, centres)[0]]
        return Quantiser(centres, [k_means(rest[:, a:b], CODEWORDS) for a, b in cuts], cuts)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        own, _ = nearest(units, self.centres)
        rest = units - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], book)[0] for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1)
        told = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - told) ** 2).sum(1))

    def probes(self, units: np.ndarray, within: float) -> np.ndarray:
        """For each row (rows) whether a list's (columns) side of the boundary begins within a distance of it."""
        own, squares = nearest(units, self.centres)
        apart = np.sqrt(nearest(self.centres, self.centres)[1])
        excess = squares - squares[np.arange(len(units)), own][:, None]
        return excess <= 2 * within * apart[own] + 1e-9

    def distances(self, units: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries (rows) to coded entries (columns), by lookups."""
        rest = units - self.centres[centre]
        total = np.zeros((len(units), len(codes)))
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += nearest(rest[:, a:b], book)[1][:, codes[:, s]]
        return np.sqrt(total)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def entries(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``(vec_id, label, vec)``: the components as bytes of doubles; null for vectors that link with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for vector, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = None
                if vector and label is not None and None not in vector:
                    row = np.array(vector, dtype=np.float64) + 0.0  # no negative zeros
                    row = row if np.isfinite(row).all() and row.any() else None
                packed.append(None if row is None else scaled(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "vec"])

    picked = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vec"),
    )
    return picked.mapInArrow(pack, "vec_id bigint, label bigint, vec binary")


def scaled(row: np.ndarray) -> np.ndarray:
    """The row, by a power of two where its squares would leave the range of doubles."""
    exponent = int(np.frexp(np.abs(row).max())[1])
    return np.ldexp(row, -exponent) if abs(exponent) > 400 else row


def near_vectors(
    vectors: DataFrame, least: float = 0.93, reach: float = 0.5, id_column: str = "vec_id",
    vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK, list_size: int = LIST,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector, linked at cosine ``least`` or more."""
    marked = stage(entries(vectors, id_column, vector_column, label_column), "vectors")
    distinct = marked.where("vec is not null").groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.length("vec") / 8), "distinct")
    facts = distinct.agg(F.count("*").alias("n"), F.count_distinct("label", "size").alias("groups")).first()
    sampled = bounded_sample(distinct, "vec", SAMPLE, facts["n"]).toPandas()["vec"]
    lists = min(-(-facts["n"] // (list_size * max(1, facts["groups"]))), max(1, len(sampled) // 32))
    quantisers = {
        int(size): Quantiser.fit(unit(stacked(sampled[sampled.map(len) == 8 * size])), lists) for size in sorted({len(v) // 8 for v in sampled})
    }
    bound = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9

    def quantiser(size: int) -> Quantiser:
        """The one for vectors of this length; without any in the sample, a single list about nothing."""
        if size in quantisers:
            return quantisers[size]
        return Quantiser(np.zeros((1, size)), [np.zeros((1, size))], [(0, size)])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An entry's own row, with codes, and a query row for every list it probes."""
        for batch in batches:
            for size, rows in batch.groupby(batch["vec"].map(len) // 8):
                tool, units = quantiser(int(size)), unit(stacked(rows["vec"]))
                own, codes, error = tool.encode(units)
                probed = tool.probes(units, bound * reach)
                row, at = np.nonzero(probed)
                base = rows[["label", "node", "copies", "vec"]].assign(home=own)
                sets = [p.tobytes() for p in np.packbits(probed, axis=1)]
                yield pd.concat(
                    [
                        base.assign(size=int(size), list=own, query=False, codes=[c.tobytes() for c in codes], error=error, probed=sets),
                        base.iloc[row].assign(size=int(size), list=at, query=True, codes=None, error=0.0, probed=None),
                    ]
                )[["label", "size", "list", "query", "node", "copies", "vec", "codes", "error", "home", "probed"]]

    schema = (
        "label bigint, size bigint, list bigint, query boolean, node bigint, copies bigint, vec binary, codes binary, error double, "
        "home bigint, probed binary"
    )
    indexed = distinct.select("label", "node", "copies", "vec").mapInPandas(index, schema)
    keys = ["label", "size", "list"]
    sizes = indexed.groupBy(*keys).agg(
        F.ceil(F.sum(F.when(F.col("query"), 0).otherwise(1)) / block).alias("own"), F.ceil(F.sum(F.when(F.col("query"), 1).otherwise(0)) / block).alias("asking")
    )
    spread = F.xxhash64("node")
    mine = F.pmod(spread, F.greatest(F.lit(1), F.when(F.col("query"), F.col("asking")).otherwise(F.col("own"))))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("query"), F.col("own")).otherwise(F.col("asking")) - 1)
    dealt = indexed.join(sizes, keys).where("own > 0 and asking > 0").withColumn("mine", mine).withColumn("other", F.explode(others))
    i, j = F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")), F.when(F.col("query"), F.col("mine")).otherwise(F.col("other"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tool, centre = quantiser(int(key[1])), int(key[2])
        own, asking = rows[~rows["query"]], rows[rows["query"]]
        if own.empty or asking.empty:
            return pd.DataFrame({"node": [], "links": [], "first": []}, dtype=np.int64)
        entry, question = stacked(own["vec"]), stacked(asking["vec"])
        norms, asked_norms = np.sqrt((entry**2).sum(1)), np.sqrt((question**2).sum(1))
        codes = np.frombuffer(b"".join(own["codes"]), dtype=np.uint8).reshape(len(own), -1)
        sets = np.frombuffer(b"".join(own["probed"]), dtype=np.uint8).reshape(len(own), -1)
        home, asked_copies = asking["home"].to_numpy(), asking["copies"].to_numpy()
        limit = bound + own["error"].to_numpy() + 1e-9
        nodes, where = np.unique(np.concatenate([own["node"], asking["node"]]), return_inverse=True)
        left, right = where[: len(own)], where[len(own) :]
        copies, label, links = own["copies"].to_numpy(), np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
        step = max(1, 500_000 // len(own))
        for at in range(0, len(asking), step):
            part = question[at : at + step]
            a, b = np.nonzero(tool.distances(unit(part), centre, codes) <= limit)
            other = left[b] != right[a + at]
            a, b = a[other], b[other]
            cosine = np.einsum("ij,ij->i", part[a], entry[b]) / (asked_norms[a + at] * norms[b])
            a, b = a[cosine >= least], b[cosine >= least]
            np.add.at(links, right[a + at], copies[b])
            lone = (sets[b, home[a + at] >> 3] >> (7 - (home[a + at] & 7))) & 1 == 0  # the entry does not ask back
            np.add.at(links, left[b[lone]], asked_copies[a[lone] + at])
            label = merge_labels(label, right[a + at], left[b])
        rest, first = star_edges(nodes, label)
        return pd.concat(
            [
                pd.DataFrame({"node": nodes, "links": links, "first": nodes})[links > 0],
                pd.DataFrame({"node": rest, "links": 0, "first": first}),
            ]
        )

    found = dealt.withColumn("i", i).withColumn("j", j).drop("own", "asking", "mine", "other").groupBy(*keys, "i", "j")
    found = stage(found.applyInPandas(compare, "node bigint, links bigint, first bigint"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    named = distinct.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "vec", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root")
    )
    least_ids = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least_ids, "root").select("label", "vec", "links", "least_id")
    rows = marked.join(named, ["label", "vec"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    return rows.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
