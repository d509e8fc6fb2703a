"""Packing against whole-text tokenisation, and its invariants."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kerbstat.llm import packing
from kerbstat.llm.queries import op4_packing
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(PATH)


def whole_ids(text):
    full = whole_ids.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    return [*full.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs):
    """Pieces cover every document once, sequences are gapless, checksums are those of the ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc, text in docs:
        ids = whole_ids(text)
        for start in range(0, len(ids), 4096):
            piece = np.array(ids[start : start + 4096], dtype="<u4")
            want[doc, len(ids)].append((start, len(piece), zlib.crc32(piece.tobytes())))
    got = {k: sorted((r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()}
    assert got == {k: sorted(v) for k, v in want.items()}
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence), sum(r["length"] for r in rows)


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = op4_packing(spark, SMALL)
    assert df.columns == COLUMNS
    n, total = check(df.collect(), docs)
    assert n <= -(-total // 4096) + max(2, n // 50)


def test_edge_rows(spark, tmp_path):
    docs = [(1, None), (2, ""), (2, ""), (None, "x y"), (4, "A " * 9000), (5, "<|endoftext|> it's é.\x1c\x85 ..,"), (5, "other")]
    rows = [(d, t, 1, "z") for d, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, length int, offset string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op4_packing(spark, str(tmp_path)).collect(), docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_packing(spark, str(tmp_path)).count() == 0


def test_blocks_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 3)
    docs = [(i % 40, "word " * (1 + i % 3)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = packing.place(packing.stage(packing.pieces_of(frame, PATH), "pieces"), chunk_rows=10).collect()
    taken = defaultdict(list)
    for r in rows:
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 400 and len(taken) == 1
    at = 0
    for offset, length in sorted(taken.popitem()[1]):
        assert offset == at
        at += length


def test_many_chunks_and_ids(spark):
    docs = [(i, "word " * (1 + i % 7)) for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    keyed = packing.pieces_of(frame, PATH, with_ids=True).withColumn("_key", packing.F.monotonically_increasing_id())
    pieces = packing.stage(keyed, "pieces")
    rows = packing.place(pieces, chunk_rows=20).collect()
    check(rows, docs)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)
    padded = packing.sequences(packing.place(pieces, chunk_rows=20)).collect()
    assert all(r["padded"] == (r["used"] if r["used"] & (r["used"] - 1) == 0 else 4096) for r in padded)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.text("aAé.,' \tΣİ<|3", max_size=30)), max_size=6))
def test_words_give_the_ids_of_whole_texts(tokenizer, texts):
    ids, begins = tokenizer.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [whole_ids(t)[:-1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1))
def test_patterns_use_the_histogram_up(histogram):
    used, total = defaultdict(int), 0
    for lengths, packs in packing.shortest_pack_first(histogram, 64):
        assert sum(lengths) <= 64
        total += packs
        for length in lengths:
            used[length] += packs
    assert used == histogram
    assert total <= 2 * -(-sum(n * length for length, n in histogram.items()) // 64)  # no two packs fit into one


def test_equal_short_lengths_fill_sequences():
    assert packing.shortest_pack_first({10: 1000}, 64) == [((10,) * 6, 166), ((10,) * 4, 1)]
