"""Ranked lexical search: MaxScore over block indexes, with bounds for pairs of terms.

A term's impact in a document is ``w * ((10^9 tf) div (1000 tf + 20 m))``, all in 64-bit integers; a document's
score for an item is the sum over the item's terms. The best ``k`` per item are exact.

1. Items are handled in blocks of ``ITEM_CHARS`` characters, so that the terms a task holds are bounded. One
   pass over the documents keeps, for blocks of ``BLOCK`` documents where they lie, the inverted lists of the
   items' terms; counts of documents and terms come from these.
2. The index. An item's terms are paired by weight, heaviest first. For every block it holds the impacts, each
   term's largest, and for each pair the intersection of the two lists with the largest joint impact (0 where
   nothing holds both). The rows of an intersection are kept where they are few beside the two lists.
3. The search, block by block. A document outside a pair's lists gains nothing from it; one outside the
   intersection gains the larger of the two single maxima at most; any document the largest of those and the
   joint maximum, which is below the sum of the two. A plan chooses for each pair to read both lists, the intersection alone, or
   nothing, by the bound it takes away for the rows it reads, until documents not read cannot reach the threshold.
   Candidates are then scored pair by pair and dropped as soon as the bounds of the pairs left do not lift them
   to it. Blocks whose bounds stay below it are skipped.

The threshold of an item begins as the ``k``-th best score of a bounded sample of blocks and rises within a task.
It never exceeds the true ``k``-th best score, so nothing is lost. A task passes on ``k`` rows an item at most,
and the ranks are taken over these.

Nulls and edge cases: a null text has no terms and does not count as a document; a null id is kept and comes
last among equal scores; repeated rows are documents each, and rank behind each other; an item without terms, or
whose terms no document holds, has no rows; repeated items have their ranks each, and a null item id is kept;
an empty table gives no rows. Only the ids and the texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from kerbstat.llm.common import PLAIN, coded_words, slices
from kerbstat.session import stage

TOP = 50
#: Characters of items handled in one pass, documents and postings of a block, blocks of the sample (by a
#: checksum), bytes of text at once.
ITEM_CHARS, BLOCK, POSTINGS, SAMPLE_BLOCKS, SLICE = 4_000_000, 4_096, 1_000_000, 8, 4 << 20
#: The rows of an intersection are kept if the two lists have this many times as many.
FEW = 8
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Items:
    """A block of items: ids, and per item the numbers of its terms in ``terms``, once each."""

    ids: list[int | None]
    terms: list[str]
    of: list[np.ndarray]

    @classmethod
    def from_texts(cls, ids: list[int | None], texts: list[str | None]) -> Items:
        words = [sorted({w.decode() for w in (t or "").encode().translate(PLAIN).split()}) for t in texts]
        terms = sorted(set().union(*words)) if words else []
        number = {w: i for i, w in enumerate(terms)}
        return cls(ids, terms, [np.array([number[w] for w in own], dtype=np.int64) for own in words])


#: A block's inverted lists, and its index.
BLOCKS = (
    "key bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, term array<int>, "
    "row array<int>, tf array<int>, held array<int>, df array<bigint>"
)
INDEX = (
    "key bigint, ids array<bigint>, held array<int>, starts array<int>, row array<int>, impact array<bigint>, "
    "joint array<bigint>, both_starts array<int>, both array<int>, kept array<boolean>"
)
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def one_row(schema: str, values: list) -> pa.RecordBatch:
    """A batch of one row, of numbers and arrays."""
    names, columns = [], []
    for field, value in zip(schema.split(", "), values, strict=True):
        name, kind = field.split()
        names.append(name)
        if kind.startswith("array<"):
            entries = pa.array(value, _KINDS[kind[6:-1]]) if isinstance(value, np.ndarray) else value
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries))
        else:
            columns.append(pa.array([int(value)], _KINDS[kind]))
    return pa.RecordBatch.from_arrays(columns, names)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of batches, by column name; null ids as the largest number."""
    for batch in batches:
        for at in range(batch.num_rows):
            columns = zip(batch.schema.names, batch.columns, strict=True)
            lists = {n: c.slice(at, 1) for n, c in columns}
            yield {
                n: pc.fill_null(c.flatten(), _NO_ID).to_numpy(zero_copy_only=False) if n == "ids"
                else c.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[0].as_py()
                for n, c in lists.items()
            }


def inverted(docs: DataFrame, items: Items, block: int = BLOCK) -> DataFrame:
    """One row per block of documents: ids, numbers of terms, and postings ``(term, row, tf)`` by term and row.

    ``n_docs`` and ``n_terms`` count documents with a term, and terms; ``held`` and ``df`` are the block's terms
    and how many of its documents hold each.
    """
    vocabulary = pa.array(items.terms, pa.string())

    def build(parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        firsts = np.cumsum([0] + [len(p[1]) for p in parts[:-1]])
        term, tf = np.concatenate([p[2] for p in parts]), np.concatenate([p[4] for p in parts])
        row = np.concatenate([p[3] + first for p, first in zip(parts, firsts, strict=True)])
        order = np.lexsort((row, term))
        held, df = np.unique(term, return_counts=True)
        term, row, tf = (x[order].astype(np.int32) for x in (term, row, tf))
        key = crc32(b"".join(x.tobytes() for x in (lengths, term, row, tf)))
        return one_row(BLOCKS, [key, (lengths > 0).sum(), lengths.sum(), ids, lengths, term, row, tf, held, df])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        rows = postings = 0
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                for at in range(0, batch.num_rows, block):
                    some = batch.slice(at, block)
                    words, place, text = coded_words(pc.fill_null(some.column(1), "").cast(pa.string()))
                    lengths = np.bincount(text, minlength=some.num_rows)
                    number = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                    number = number.astype(np.int64)[place] if len(place) else np.zeros(0, np.int64)
                    asked = number >= 0
                    keys, tf = np.unique(text[asked] * len(vocabulary) + number[asked], return_counts=True)
                    row, term = np.divmod(keys, max(1, len(vocabulary)))
                    if parts and (rows + some.num_rows > block or postings + len(keys) > POSTINGS):
                        yield build(parts)
                        parts, rows, postings = [], 0, 0
                    parts.append((some.column(0), lengths, term, row, tf))
                    rows, postings = rows + some.num_rows, postings + len(keys)
        if parts:
            yield build(parts)

    return docs.mapInArrow(collect, BLOCKS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """A term's weight by how many of ``n_docs`` documents hold it."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + 50 * length * n_docs // max(1, n_terms)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def pairs_of(items: Items, weight: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All pairs ``(a, b)``, a < b, and per item the numbers of its pairs; ``b`` is -1 for a term left over.

    Terms of no weight add nothing and are left out.
    """
    number: dict[tuple[int, int], int] = {}
    of = []
    for own in items.of:
        own = own[weight[own] > 0]
        own = own[np.lexsort((own, -weight[own]))].tolist()
        chosen = [(min(x), max(x)) for x in zip(own[::2], own[1::2], strict=False)] + [(x, -1) for x in own[len(own) // 2 * 2 :]]
        of.append(np.array([number.setdefault(p, len(number)) for p in chosen], dtype=np.int64))
    return np.array(list(number), dtype=np.int64).reshape(-1, 2), of


def index_blocks(blocks: DataFrame, weight: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Impacts of every block, and for each pair the largest joint impact and the rows that hold both, where few."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in rows_of(batches):
            lengths, term, row, tf, held = (one[c].astype(np.int64) for c in ("lengths", "term", "row", "tf", "held"))
            impact = impacts(weight[term], tf, lengths[row], n_docs, n_terms)
            starts = np.searchsorted(term, np.append(held, len(weight)))
            joint, kept, both = join_pairs(pairs, held, starts, row, impact, len(lengths), len(weight))
            ends = np.cumsum([0] + [len(x) for x in both])
            ids = pa.array(one["ids"], mask=one["ids"] == _NO_ID)
            yield one_row(INDEX, [one["key"], ids, held, starts, row, impact, joint, ends, np.concatenate([row[:0], *both]), kept])

    return blocks.select("key", "ids", "lengths", "term", "row", "tf", "held").mapInArrow(index, INDEX)


def join_pairs(
    pairs: np.ndarray, held: np.ndarray, starts: np.ndarray, row: np.ndarray, impact: np.ndarray, docs: int, terms: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per pair the largest joint impact, whether its rows are kept, and these rows."""
    slot = np.full(terms + 1, -1)
    slot[held] = np.arange(len(held))
    joint, kept = np.zeros(len(pairs), np.int64), np.ones(len(pairs), bool)
    both = [row[:0]] * len(pairs)
    beside = np.zeros(docs, np.int64)
    for p in np.flatnonzero((slot[pairs] >= 0).all(axis=1)):
        (a, b), (c, d) = (starts[s : s + 2] for s in slot[pairs[p]])
        beside[row[a:b]] = impact[a:b]
        other = beside[row[c:d]]
        hit = np.flatnonzero(other)
        beside[row[a:b]] = 0
        if len(hit):
            joint[p] = (other[hit] + impact[c:d][hit]).max()
            kept[p] = FEW * len(hit) <= b - a + d - c
            both[p] = row[c:d][hit] if kept[p] else row[:0]
    return joint, kept, both


class Block:
    """An index row, with the bounds of its pairs."""

    def __init__(self, one: dict[str, np.ndarray], pairs: np.ndarray, terms: int) -> None:
        self.ids, held, self.starts, self.row, self.impact, joint, self.both_starts, self.both, self.kept = (
            one[c] for c in ("ids", "held", "starts", "row", "impact", "joint", "both_starts", "both", "kept")
        )
        slot = np.full(terms + 1, len(held))  # the last entry, of no rows, is that of an absent term
        slot[held] = np.arange(len(held))
        self.starts = np.append(self.starts, self.starts[-1:])
        self.slots = slot[pairs]
        most = np.zeros(len(held) + 1, np.int64)
        most[:-1] = np.maximum.reduceat(self.impact, self.starts[:-2]) if len(held) else 0
        size = np.diff(self.starts)
        self.lone = most[self.slots].max(axis=1)  # of a document with one of the two at most
        self.most = np.maximum(self.lone, joint)
        self.sizes = size[self.slots].sum(axis=1)
        self.both_sizes = np.diff(self.both_starts)

    def plan(self, own: np.ndarray, least: int) -> np.ndarray | None:
        """Per pair 0 (read nothing), 1 (the intersection) or 2 (both lists); None if no document can reach ``least``."""
        choice, unseen = np.zeros(len(own), np.int64), self.most[own].astype(np.float64)
        if unseen.sum() < least:
            return None
        lone, sizes, both_sizes, kept = self.lone[own], self.sizes[own], self.both_sizes[own], self.kept[own]
        while unseen.sum() >= least and (choice < 2).any():
            by_both = np.where(kept & (choice == 0), unseen - lone, 0) / (1 + both_sizes)
            by_all = np.where(choice < 2, unseen, -1) / (1 + sizes)
            if by_both.max() > by_all.max():
                p = int(by_both.argmax())
                choice[p], unseen[p] = 1, lone[p]
            else:
                p = int(by_all.argmax())
                choice[p], unseen[p] = 2, 0
        return choice

    def search(self, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, scores)`` of the documents that reach ``least``, which is positive."""
        none = np.zeros(0, np.int64)
        if (choice := self.plan(own, least)) is None:
            return none, none
        member = np.zeros(len(self.ids), bool)
        for p, how in zip(own.tolist(), choice.tolist(), strict=True):
            if how == 1:
                member[self.both[self.both_starts[p] : self.both_starts[p + 1]]] = True
            elif how == 2:
                for s in self.slots[p]:
                    member[self.row[self.starts[s] : self.starts[s + 1]]] = True
        found, score = np.flatnonzero(member), np.zeros(len(self.ids), np.int64)
        own = own[np.argsort(-self.most[own], kind="stable")]
        left = self.most[own].sum() - np.cumsum(self.most[own])
        for p, rest in zip(own.tolist(), left.tolist(), strict=True):
            for s in self.slots[p].tolist():
                a, b = self.starts[s], self.starts[s + 1]
                if b - a > 16 * len(found):
                    at = np.minimum(np.searchsorted(self.row[a:b], found), b - a - 1)
                    hit = self.row[a:b][at] == found
                    score[found[hit]] += self.impact[a:b][at[hit]]
                else:
                    score[self.row[a:b]] += self.impact[a:b]
            found = found[score[found] + rest >= least]
            if not len(found):
                break
        return found, score[found]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    return np.lexsort((ids, -scores))[:k]


def search_blocks(index: DataFrame, pairs: np.ndarray, of: list[np.ndarray], terms: int, least: np.ndarray, k: int) -> DataFrame:
    """``(item, doc_id, score)``: for each item (its number) what may be among the best ``k``, ``k`` a task at most."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = least.copy()
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(of)
        for one in rows_of(batches):
            block = Block(one, pairs, terms)
            for item, own in enumerate(of):
                rows, scores = block.search(own, int(bound[item])) if len(own) else (own, own)
                if len(rows):
                    ids, scores = np.append(top[item][0], block.ids[rows]), np.append(top[item][1], scores)
                    keep = best(ids, scores, k)
                    top[item] = ids[keep], scores[keep]
                    if len(keep) == k:
                        bound[item] = max(bound[item], top[item][1][-1])
        counts = [len(ids) for ids, _ in top]
        ids = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in top)])
        scores = np.concatenate([np.zeros(0, np.int64), *(scores for _, scores in top)])
        item = np.repeat(np.arange(len(of)), counts)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_items(docs: DataFrame, items: Items, k: int, block: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` for one block of items."""
    blocks = stage(inverted(docs, items, block), "inverted")
    sums = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = sums["docs"] or 0, sums["terms"] or 0
    each = blocks.select(F.explode(F.arrays_zip("held", "df")).alias("t")).groupBy("t.held").agg(F.sum("t.df").alias("df"))
    df = np.zeros(len(items.terms), np.int64)
    for term, n in each.collect():  # the terms of one block of items at most
        df[term] = n
    weight = weights(df, n_docs)
    pairs, of = pairs_of(items, weight)
    index = stage(index_blocks(blocks, weight, pairs, n_docs, n_terms), "index")
    least = np.ones(len(items.of), np.int64)
    chosen = [r["key"] for r in index.select("key").orderBy("key").limit(SAMPLE_BLOCKS).collect()]
    first = ranked(search_blocks(index.where(F.col("key").isin(chosen)), pairs, of, len(weight), least, k), k)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one number an item
        least[r["item"]] = r["score"]
    return ranked(search_blocks(index, pairs, of, len(weight), least, k), k)


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, item_chars: int = ITEM_CHARS,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    read = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-chars // item_chars))
    parts = []
    for n in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == n).orderBy("item_id", "text").collect()
        block_items = Items.from_texts([r["item_id"] for r in own], [r["text"] for r in own])
        names = docs.sparkSession.createDataFrame(list(enumerate(block_items.ids)), "item bigint, item_id bigint")
        found = search_items(read, block_items, k, block)
        parts.append(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
