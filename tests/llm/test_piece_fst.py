"""The piece transducer against the sentencepiece library, for BPE and for unigram weights."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from kerbstat.llm import piece_fst
from kerbstat.llm.queries import op10_piece_transducer
from tests.conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "  lead   trail  ", "tab\tnew\nline", "▁", "a▁b ▁▁c", "<s>x</s><unk><0x0A>", "ｆｕｌｌ ﬁ é é\xa0x",
    "日本語 テキスト 🙂🙂 \x00", "aaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 3000, "x" * 3000, "mississippi bananas 1234567 http://example.com/a_b?c=d&e",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return piece_fst.PieceTransducer(PATH)


def encoded(machine, texts):
    ids, begins = machine.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]


def check(rows, texts, library):
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text)
        assert r["n_pieces"] == len(ids) and r["n_byte_pieces"] == sum(library.is_byte(i) for i in ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert r["decoded_crc32"] == zlib.crc32(library.decode(ids).encode()) and r["round_trip"]


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op10_piece_transducer(spark, SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, texts, library)


def test_edge_rows(spark, library, tmp_path):
    rows = [*enumerate(TEXTS), (None, "x y"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id bigint, text string, ids string, n_pieces int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(op10_piece_transducer(spark, str(tmp_path)).collect(), {**dict(enumerate(TEXTS)), None: "x y"}, library)
    decoded = piece_fst.decode_documents(piece_fst.encode_documents(docs, PATH, with_ids=True), PATH).collect()
    assert {(r["doc_id"], r["text"]) for r in decoded} == {(d, (t or "").replace("▁", " ")) for d, t in rows}


def test_query_returns_the_ids(spark, library, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in op10_piece_transducer(spark, str(tmp_path)).collect()}
    assert got == {d: library.encode(t or "") for d, t in enumerate(TEXTS)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op10_piece_transducer(spark, str(tmp_path)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("abehinorst ▁.", max_size=40), st.text("aeiou", max_size=40)), max_size=5))
def test_ids_are_those_of_the_library(machine, library, texts):
    assert encoded(machine, texts) == [library.encode(t) for t in texts]


def test_random_joined_pieces(machine, library):
    rng = random.Random(7)
    names = list(machine.ids)
    texts = ["".join(rng.choice(names) for _ in range(rng.randrange(1, 6))).replace(piece_fst.MARK, " ") for _ in range(3000)]
    assert encoded(machine, texts) == [library.encode(t) for t in texts]


def test_unigram_weights(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    rng = random.Random(3)
    for piece in proto.pieces:
        if piece.type == piece.NORMAL:
            piece.score = -rng.uniform(5, 15)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    machine, library = piece_fst.PieceTransducer(str(path)), SentencePieceProcessor(model_file=str(path))
    words = [w for t in TEXTS if t and len(t) < 200 for w in t.split(" ")] + ["thhaingon", "unbelievable", "erlyhandtion"]
    texts = [w for w in words if w.isascii() and w.isprintable()]
    assert encoded(machine, texts) == [library.encode(t) for t in texts]
