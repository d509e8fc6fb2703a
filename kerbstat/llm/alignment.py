"""Alignment of two tokenizers: lockstep vectorised merging of the token ends of whole batches.

Tokenizer A is a byte-level BPE, tokenizer B a piece model that puts a blank before the text; both encode to the
same bytes, space and text, where a document has tokens at all. A byte offset at which tokens of both end is a
cut; cuts part the tokens into groups, and every pair of an A and a B token of one group is a link.

1. Texts are encoded where they lie. The state of a batch is one vector per pointer: the next A and B token of
   each document. A step compares the ends of all documents' tokens at once, emits a cut with its group for
   those that meet, and advances the pointers that are behind; documents at their end are taken out. The links of the groups
   are counted per document and pair of ids, and staged with the document's row.
2. A pair's count is the number of documents that hold it linked, by a grouped count of the staged pairs; an A
   id's best count is the largest of its pairs.
3. Documents are summed over their links where they lie, by the ``KNOWN`` most frequent pairs (a bounded
   broadcast). The other pairs stay with their row as a list and get their counts by a join, where Spark splits
   hot keys.

Nulls and edge cases: a text that is null or empty, or whose tokens do not give back its bytes, has no tokens:
zeros and an empty hash; a null id is kept; repeated rows are documents each; special tokens' strings inside
texts are plain text; an empty table gives no rows; only the id and the text are read. A group's links are held as
different pairs of ids with their numbers, so a long run without a cut stays small.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kerbstat.llm.common import slices
from kerbstat.session import stage

#: Most frequent pairs that a task holds; bytes of text aligned, and encoded, at once; links of a group listed one by one.
KNOWN, SLICE, ENCODED, LISTED = 262_144, 2 << 20, 1 << 20, 4_096
# How this kind of byte-level BPE splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, then in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteEncoder:
    """Ids by a byte-level BPE file, special tokens off. ``bytes_of`` are the tokens' bytes by id.

    Where ids follow the order of the merges, as in the public files, ranks are ids, and the encoding is the
    same by the faster of the two libraries; otherwise the file's own library encodes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        coded = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if token not in special}
        names = coded | {i: s.encode() for s, i in special.items()}
        self.bytes_of = pa.array([names.get(i, b"") for i in range(max(names) + 1)], pa.binary())
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        plain = (spec["pre_tokenizer"] or {}) | {"trim_offsets": None}
        plain_split = plain == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}
        in_order = [vocabulary.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        if plain_split and in_order and not spec["normalizer"] and not spec["model"]["dropout"]:
            ranks = {token: i for i, token in coded.items()}
            encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [np.frombuffer(encoding.encode_to_numpy(t), dtype=np.uint32) for t in texts]
        else:
            full = Tokenizer.from_file(path)
            full.encode_special_tokens = True
            self.encode = lambda texts: [np.array(e.ids, dtype=np.uint32) for e in full.encode_batch_fast(texts, add_special_tokens=False)]


class PieceEncoder:
    """Ids by a sentencepiece model. ``bytes_of`` are the pieces' bytes by id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def own(i: int) -> bytes:
            piece = model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

        self.bytes_of = pa.array([own(i) for i in range(model.get_piece_size())], pa.binary())
        self.encode = lambda texts: [np.array(ids, dtype=np.uint32) for ids in model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> tuple[ByteEncoder, PieceEncoder]:
    """One pair per worker process, kept between tasks."""
    return ByteEncoder(a_path), PieceEncoder(b_path)


def encode_both(texts: list[str], pair: tuple[ByteEncoder, PieceEncoder]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A and B ids of each text; both are empty if the text is, or if either does not give back its bytes."""
    given = [b" " + t.encode() if t else b"" for t in texts]
    ids = [pair[0].encode([" " + t for t in texts]), pair[1].encode(texts)]
    right = np.array([len(g) > 0 for g in given])
    for own, side in zip(pair, ids, strict=True):
        back = own.bytes_of.take(pa.array(np.concatenate([np.zeros(0, np.uint32), *side])))
        data = back.buffers()[2].to_pybytes() if len(back) else b""
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(back).to_numpy(zero_copy_only=False), dtype=np.int64)])
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in side])])].tolist()
        right &= [data[a:b] == g for a, b, g in zip(cuts[:-1], cuts[1:], given, strict=True)]
    none = np.zeros(0, np.uint32)
    a_ids, b_ids = ([x if ok else none for x, ok in zip(side, right.tolist(), strict=True)] for side in ids)
    return a_ids, b_ids


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    """Groups ``(first A, behind A, first B, behind B)`` of all documents, in order.

    ``a_end`` and ``b_end`` are the byte offsets of token ends, counted through the batch; ``a_first`` and
    ``b_first`` say where each document's tokens begin, with one entry more than documents.
    """
    some = np.flatnonzero(np.diff(a_first))
    i, j, stop = a_first[some].copy(), b_first[some].copy(), a_first[some + 1]
    i0, j0 = i.copy(), j.copy()
    groups = [np.zeros((0, 4), np.int64)]
    while len(i):
        a, b = a_end[i], b_end[j]
        i += a <= b
        j += b <= a
        met = np.flatnonzero(a == b)
        if len(met):
            at, to = i[met], j[met]
            groups.append(np.column_stack([i0[met], at, j0[met], to]))
            i0[met], j0[met] = at, to
            if (at == stop[met]).any():
                left = i < stop
                i, j, i0, j0, stop = i[left], j[left], i0[left], j0[left], stop[left]
    found = np.concatenate(groups)
    return found[np.argsort(found[:, 0], kind="stable")]


def group_links(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, pair, links)`` of all groups; a pair is ``a * width + b``."""
    n_a, n_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    product = n_a * n_b
    small = np.flatnonzero(product <= LISTED)
    of = np.repeat(small, product[small])
    k = np.arange(len(of)) - np.repeat(np.cumsum(product[small]) - product[small], product[small])
    across = np.divmod(k, n_b[of])
    pair = a_ids[groups[of, 0] + across[0]].astype(np.int64) * width + b_ids[groups[of, 2] + across[1]]
    found = [(of, pair, np.ones(len(of), np.int64))]
    for g in np.flatnonzero(product > LISTED).tolist():
        (a, m), (b, n) = (np.unique(ids[s:e], return_counts=True) for ids, (s, e) in ((a_ids, groups[g, :2]), (b_ids, groups[g, 2:])))
        found.append((np.full(len(a) * len(b), g), (a.astype(np.int64)[:, None] * width + b).ravel(), np.outer(m, n).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def written(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, tables: list[pa.Array]) -> pa.Array:
    """Every token's id and the mark behind it, groups in order: A ids, then B ids.

    ``tables`` have the ids' texts ending in a comma, a bar and a semicolon.
    """
    size = len(tables[0])
    out = np.zeros(len(a_ids) + len(b_ids), np.int64)
    at_a = np.arange(len(a_ids)) + np.repeat(groups[:, 2], groups[:, 1] - groups[:, 0])
    at_b = np.arange(len(b_ids)) + np.repeat(groups[:, 1], groups[:, 3] - groups[:, 2])
    out[at_a], out[at_b] = a_ids, b_ids
    out[at_a[groups[:, 1] - 1]] += size
    out[at_b[groups[:, 3] - 1]] += 2 * size
    return pa.concat_arrays(tables).take(pa.array(out))


def align_batch(texts: list[str], pair: tuple[ByteEncoder, PieceEncoder], width: int, tables: list[pa.Array]) -> tuple:
    """Per text: A tokens, B tokens, groups, links, hash; and a list of pairs of ids with the links of each."""
    sizes = np.cumsum([len(t) for t in texts]) // ENCODED
    encoded = [encode_both([t for t, s in zip(texts, sizes, strict=True) if s == k], pair) for k in np.unique(sizes)]
    lists = [[ids for part in encoded for ids in part[side]] for side in (0, 1)]
    firsts = [np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in lists]
    a_ids, b_ids = (np.concatenate([np.zeros(0, np.uint32), *ids]) for ids in lists)
    ends = [np.cumsum(pc.binary_length(own.bytes_of).to_numpy()[ids], dtype=np.int64) for own, ids in zip(pair, (a_ids, b_ids), strict=True)]
    groups = lockstep(*ends, *firsts)
    text_of = np.searchsorted(firsts[0], groups[:, 0], side="right") - 1
    n_groups = np.bincount(text_of, minlength=len(texts))
    marks = written(groups, a_ids, b_ids, tables)
    marks_first = firsts[0] + firsts[1]
    offsets = np.frombuffer(marks.buffers()[1], np.int32)[: len(marks) + 1] if len(marks) else np.zeros(1, np.int32)
    data = memoryview(marks.buffers()[2]) if len(marks) else memoryview(b"")
    cuts = offsets[marks_first]
    hashes = [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    group, code, links = group_links(groups, a_ids, b_ids, width)
    span = len(pair[0].bytes_of) * width
    keys, inverse = np.unique(text_of[group] * span + code, return_inverse=True)
    times = np.bincount(inverse, links, len(keys)).astype(np.int64)
    owner, code = np.divmod(keys, span)
    n_links = np.bincount(owner, times, len(texts)).astype(np.int64)
    return np.diff(firsts[0]), np.diff(firsts[1]), n_groups, n_links, hashes, np.searchsorted(owner, np.arange(len(texts) + 1)), code, times


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``: pairs of linked ids, and links of each."""
    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<bigint>, times array<bigint>"
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = encoders(a_path, b_path)
        width = len(pair[1].bytes_of)
        most = max(len(own.bytes_of) for own in pair)
        tables = [pa.array([b"%d%c" % (i, mark) for i in range(most)], pa.binary()) for mark in b",|;"]
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                texts = pc.fill_null(batch.column(1), "").cast(pa.string()).to_pylist()
                *numbers, hashes, offsets, code, times = align_batch(texts, pair, width, tables)
                offsets = pa.array(offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code, times)]
                columns = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(hashes, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(align, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``(pair, n, best)``: documents that hold a pair linked, and whether no pair of its A id has more."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    a = F.floor(F.col("pair") / width)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row per A id
    return stage(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def frequent_pairs(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, ``limit`` at most, in order, with their counts and marks."""
    bins = counts.groupBy("n").count().orderBy(F.desc("n")).limit(limit).collect()
    total, least = 0, None
    for n, pairs in bins:
        total += pairs
        if total > limit:
            break
        least = n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    known = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    return known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, known: int = KNOWN, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document."""
    width = len(encoders(a_path, b_path)[1].bytes_of)
    rows = stage(aligned(docs, a_path, b_path, id_column, text_column), "aligned")
    counts = pair_counts(rows, width)
    codes, n, best = frequent_pairs(counts, known)
    told = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "n_best bigint, count_sum bigint, rare array<struct<pair:bigint,k:bigint>>"
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = pc.fill_null(pc.list_value_length(batch.column("pairs")), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(codes, pairs), max(0, len(codes) - 1))
            hit = codes[at] == pairs if len(codes) else np.zeros(len(pairs), bool)
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, owner[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, owner[hit], times[hit] * n[at[hit]])
            entries = pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit])], ["pair", "k"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))])
            rare = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)
            columns = [*(batch.column(c) for c in told), pa.array(n_best), pa.array(count_sum), rare]
            yield pa.RecordBatch.from_arrays(columns, [*told, "n_best", "count_sum", "rare"])

    partial = stage(rows.mapInArrow(total, schema).withColumn("row", F.monotonically_increasing_id()), "totals")
    asked = partial.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.k")
    more = asked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum")
    )
    whole = partial.drop("rare").join(more, "row", "left")
    zero = F.lit(0).cast("bigint")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256",
    )
