"""Alignment of two tokenizers against plain sets of offsets, one document at a time."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from kerbstat.llm import alignment
from kerbstat.llm.queries import op12_token_alignment, tokenizer_path
from tests.conftest import SMALL

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encode():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    alphabet = alignment.byte_alphabet()

    def both(text):
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        return a_ids, b_ids, a_bytes, b_bytes

    return both


def plain(rows, encode):
    """The contract's columns of every row."""
    found, counts = [], Counter()
    for _, text in rows:
        a, b, a_bytes, b_bytes = encode(text or "")
        given = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != given or b"".join(b_bytes) != given:
            found.append(None)
            continue
        ends = [{0: 0}, {0: 0}]
        for own, tokens in zip(ends, (a_bytes, b_bytes), strict=True):
            at = 0
            for k, token in enumerate(tokens):
                at += len(token)
                own[at] = k + 1
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups = [(a[ends[0][p] : ends[0][q]], b[ends[1][p] : ends[1][q]]) for p, q in zip(cuts, cuts[1:], strict=False)]
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        found.append((len(a), len(b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        top = sum(k for p, k in links.items() if counts[p] == best[p[0]])
        total = sum(k * counts[p] for p, k in links.items())
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), top, total, hashlib.sha256(said.encode()).hexdigest()))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


ROWS = [
    (0, None), (1, ""), (2, " "), (3, "plain words, twice: plain words"), (4, "</s><s>[INST] <|endoftext|> <unk> <0x41>"),
    (5, "has ▁ its own mark"), (6, "größe ñandú 漢字 \U0001f600​ é"), (7, "-" * 5_000 + "=" * 777 + " " * 300 + "a" * 999),
    (8, "\t\n  two\r\n\r\n   lines  "), (9, "nul \x00 and \x7f"), (None, "no id"), (3, "plain words, twice: plain words"),
    (10, "long text of words and 12345 numbers " * 4_000), (11, "  "), (12, "ﬁ ½ ① Ⅷ"),
]


@pytest.mark.parametrize("known", [0, 5, alignment.KNOWN])
def test_edge_rows(spark, encode, known):
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in ROWS], "doc_id bigint, text string, n_a int, pairs string")
    got = alignment.align_documents(docs, tokenizer_path(A), tokenizer_path(B), known=known)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(ROWS, encode), key=key)


def test_encoder_gives_the_librarys_ids(encode):
    own, _ = alignment.encoders(tokenizer_path(A), tokenizer_path(B))
    texts = [" " + (t or "") for _, t in ROWS]
    assert [x.tolist() for x in own.encode(texts)] == [encode(t[1:])[0] for t in texts]


def test_lockstep_of_random_ends():
    rng = np.random.default_rng(5)
    lists, expected = [[], []], []
    firsts, base = [[0], [0]], 0
    for _ in range(200):
        size = int(rng.integers(0, 60))
        own = [sorted({*rng.integers(1, size + 1, rng.integers(0, size + 1)).tolist(), size}) if size else [] for _ in (0, 1)]
        for side in (0, 1):
            lists[side] += [base + e for e in own[side]]
            firsts[side].append(len(lists[side]))
        a, b = (firsts[side][-2] for side in (0, 1))
        for cut in sorted(set(own[0]) & set(own[1])):
            to = firsts[0][-2] + own[0].index(cut) + 1, firsts[1][-2] + own[1].index(cut) + 1
            expected.append((a, to[0], b, to[1]))
            a, b = to
        base += size
    got = alignment.lockstep(*(np.array(x, np.int64) for x in (*lists, *firsts)))
    assert got.tolist() == [list(x) for x in expected]


def test_large_groups_are_counted_by_distinct_ids():
    groups = np.array([[0, 100, 0, 90], [100, 101, 90, 92]])
    a, b = np.arange(101, dtype=np.uint32) % 3, np.arange(92, dtype=np.uint32) % 2
    of, code, links = alignment.group_links(groups, a, b, 10)
    want = Counter((g, int(x) * 10 + int(y)) for g, (i, j, k, n) in enumerate(groups) for x in a[i:j] for y in b[k:n])
    found = Counter()
    for g, c, n in zip(of.tolist(), code.tolist(), links.tolist(), strict=True):
        found[g, c] += n
    assert found == want and len(of) == 6 + 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_documents(docs, tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_whole_table(spark, encode):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op12_token_alignment(spark, SMALL).collect()), key=key)
    assert got == sorted(plain(rows, encode), key=key)
