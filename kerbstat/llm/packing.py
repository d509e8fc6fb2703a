"""Packing documents into sequences of a fixed length: shortest pack first over the length histogram.

1. Documents are tokenised where they lie. A document longer than a sequence is cut into full pieces and
   a rest; only lengths and checksums of pieces go on (the ids too, if asked for).
2. The histogram of piece lengths, at most as many rows as a sequence has tokens, comes to the driver.
   Lengths are placed longest first, each onto the shortest pack with room, updating counts of packing
   patterns: identical packs are one pattern with a count, so this does not grow with the documents.
3. Pieces are ranked within their length and look up the pattern, and so the sequence and the offset,
   that their rank falls to. Ranks are counted per length and chunk of rows, with the offsets of chunks
   added, and these summed in two steps, so that a length that a third of all pieces share is not one group.
   Token ids take no part in this: they are joined to their places once, by the row's key.

Nulls and edge cases: a null text counts as empty, and an empty document is its end id alone; a null id
is kept; repeated rows are packed each; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from kerbstat.llm.common import slices
from kerbstat.session import stage

SEQUENCE, END_ID = 4096, 2
#: Pieces in a chunk that is ranked as one group, and chunks whose counts are summed as one group.
CHUNK, CHUNKS = 2_000, 1_000
#: Words whose ids a worker keeps; bytes of text that it tokenises at once.
CACHE, SLICE = 300_000, 4 << 20


class WordTokenizer:
    """Ids of whole texts by way of their words.

    For tokenizers that never join what white space parts, as ``word_bpe_49k.json``, the ids of a text are
    those of its words in order. Each distinct word of a batch is encoded once and frequent ones are kept.
    Where the tokenizer's normaliser is NFC and lower-casing, a word of letters in NFC needs only the
    latter, and a full stop or comma behind it is a token of its own.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        spec = json.loads(self.own.to_str())
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.end = spec["model"]["end_of_word_suffix"]
        self.lowers = kinds == ["NFC", "Replace", "Lowercase"] and bool(self.end)
        bytes_of_words = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = self.own.normalizer, self.own.pre_tokenizer
        self.bare = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_of_words])
        vocabulary = self.own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if self.end and token.endswith(self.end)]] = True
        self.marks = {c: self.own.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.begins = np.zeros(1, dtype=np.int64)

    def lists(self, texts: list[str], steps: tuple) -> list[list[int]]:
        """Ids of texts, with the tokenizer's own steps before the merges or with the bare ones."""
        if not texts:
            return []
        self.own.normalizer, self.own.pre_tokenizer = steps
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def key(self, word: str) -> tuple[str, int, bool]:
        """``(stem, mark, bare)``: what to encode, the id that follows it or -1, and whether it is normalised."""
        stem, mark = (word[:-1], self.marks[word[-1]]) if word[-1] in ".," else (word, -1)
        if self.lowers and stem.isalpha() and is_normalized("NFC", stem) and "Σ" not in stem and "İ" not in stem:
            return stem.lower(), mark, True
        return word, -1, False

    def learn(self, keys: list[tuple[str, int, bool]]) -> None:
        """Encode the stems that are not known yet."""
        plain = list(dict.fromkeys(stem for stem, _, bare in keys if bare and stem not in self.known))
        other = list(dict.fromkeys(stem for stem, _, bare in keys if not bare and stem not in self.known))
        # A token with the end-of-word suffix ends a word, so that many words can be encoded as one text.
        joined = [" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
        new = np.fromiter(chain.from_iterable(self.lists(joined, self.bare)), dtype=np.uint32)
        lists = self.lists(other, self.whole)
        begins = [self.begins, len(self.ids) + np.flatnonzero(self.ends[new]) + 1]
        begins.append(len(self.ids) + len(new) + np.cumsum([len(x) for x in lists], dtype=np.int64))
        self.known |= {stem: len(self.known) + k for k, stem in enumerate(plain + other)}
        self.ids = np.concatenate([self.ids, new, np.fromiter(chain.from_iterable(lists), dtype=np.uint32)])
        self.begins = np.concatenate(begins)
        if len(self.begins) != len(self.known) + 1:
            raise ValueError("the tokenizer does not end each word with its suffix")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one entry more than texts)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        entries = coded.dictionary.to_pylist()
        keys = [self.key(w) if w else ("", -1, False) for w in entries]
        if len(self.known) > CACHE:
            self.forget()
        self.learn(keys)
        index = np.array([self.known[stem] for stem, _, _ in keys], dtype=np.int64)
        mark = np.array([m for _, m, _ in keys], dtype=np.int64)
        sizes = self.begins[index + 1] - self.begins[index] + (mark >= 0)
        word = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        where = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.begins[index][word], counts)
        marked = np.flatnonzero(mark[word] >= 0)
        where[ends[marked + 1] - 1] = 0
        ids = self.ids[where] if len(where) else np.zeros(0, dtype=np.uint32)
        ids[ends[marked + 1] - 1] = mark[word[marked]]
        first_word = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, ends[first_word]


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, kept between tasks."""
    return WordTokenizer(path)


def pieces_of(
    docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``: one row per piece."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids, begins = tokenizer.encode(pc.fill_null(batch.column(1), "").cast(pa.string()))
                sizes = np.diff(begins) + 1
                flat = np.full(len(ids) + len(sizes), end_id, dtype="<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
                pieces = -(-sizes // sequence)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
                length = np.minimum(sequence, sizes[doc] - start)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(doc)), *(pa.array(x) for x in (start, length, np.array(crc, np.int64), sizes[doc]))]
                if with_ids:
                    offsets = pa.array(np.append(first, len(flat)).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, count)`` patterns: lengths longest first, each onto the pack with the most room."""
    room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # free tokens -> (linked lengths, packs)
    most, done = 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room[most]:
                most -= 1
            if most < length:
                break
            pack, packs = room[most].pop()
            taken = min(left, packs)
            if taken < packs:
                room[most].append((pack, packs - taken))
            (room[most - length] if most > length else done).append(((length, pack), taken))
            left -= taken
        each = sequence // length  # a new pack is the one with the most room until it is full
        for pieces, packs in ((each, left // each), (left % each, 1)):
            if pieces and packs:
                pack, rest = (), sequence - pieces * length
                for _ in range(pieces):
                    pack = (length, pack)
                (room[rest] if rest else done).append((pack, packs))
                most = max(most, rest)
    patterns = []
    for pack, packs in done + [p for free in sorted(room) for p in room[free]]:
        lengths = []
        while pack:
            length, pack = pack
            lengths.append(length)
        patterns.append((tuple(reversed(lengths)), packs))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, first sequence, offset)`` ordered by rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, packs in patterns:
        offset = 0
        for length in lengths:
            found[length].append((used[length], sequence, offset))
            used[length] += packs
            offset += length
        sequence += packs
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def places_before(counts: DataFrame) -> DataFrame:
    """``(length, _chunk, _first)``: how many pieces of the length the chunks before have."""
    block = F.floor(F.col("_chunk") / CHUNKS)
    blocks = counts.groupBy("length", block.alias("_block")).agg(F.sum("_n").alias("_own"))
    by_block = Window.partitionBy("length").orderBy("_block")
    blocks = blocks.select("length", "_block", (F.sum("_own").over(by_block) - F.col("_own")).alias("_before"))
    within = Window.partitionBy("length", "_block").orderBy("_chunk")
    inner = counts.withColumn("_block", block).withColumn("_first", F.sum("_n").over(within) - F.col("_n"))
    return inner.join(blocks, ["length", "_block"]).select("length", "_chunk", (F.col("_first") + F.col("_before")).alias("_first"))


def place(pieces: DataFrame, sequence: int = SEQUENCE, chunk_rows: int = CHUNK) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``pieces`` is read several times and should be staged.

    Ids, where there are any, need a column ``_key`` that tells rows apart, which is left out of the result.
    """
    if "ids" in pieces.columns:
        placed = place(pieces.select("_key", *[c for c in pieces.columns if c not in ("ids", "_key")]), sequence, chunk_rows)
        narrow = placed.select("_key", "sequence_id", "offset")
        return pieces.join(narrow, "_key").select(*[c for c in pieces.columns if c != "_key"], "sequence_id", "offset")
    chunks = max(1, -(-pieces.count() // chunk_rows))
    keyed = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)).cast("int"))
    counts = stage(keyed.groupBy("length", "_chunk").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    lookup = slots(shortest_pack_first(histogram, sequence))
    within = Window.partitionBy("length", "_chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("_rank", F.row_number().over(within).cast("bigint") - 1).join(places_before(counts), ["length", "_chunk"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_rank")).alias("_rank"))
    at = pieces.columns.index("length")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at, batch.num_columns - 1))
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine, table = length == one, lookup[int(one)]
                k = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                where[mine], offset[mine] = table[k, 1] + rank[mine] - table[k, 0], table[k, 2]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where), pa.array(offset)], names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset)`` of every piece."""
    pieces = pieces_of(docs, tokenizer_path, sequence, end_id, with_ids)
    return place(stage(pieces.withColumn("_key", F.monotonically_increasing_id()) if with_ids else pieces, "pieces"), sequence)


def sequences(packed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``(sequence_id, pieces, used, padded)``: a sequence filled to a power of two is left at that."""
    by = packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("used"))
    exact = F.expr("bit_count(used) = 1")
    return by.withColumn("padded", F.when(exact, F.col("used")).otherwise(F.lit(sequence)))
