"""Language-model scores against a plain trie with escapes and exclusion, one byte at a time."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbstat.llm import ppm
from kerbstat.llm.queries import op9_ppm_score
from tests.conftest import SMALL


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\x0b\f\r":
        lowered = lowered.replace(white, " ")
    return [w for w in lowered.split(" ") if w]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def expected(rows):
    count, trie = Counter(), defaultdict(Counter)
    for doc, text in rows:
        if not held(doc):
            count.update([*plain_words(text), None])
            data = b"\xff" * 3 + (text or "").encode() + b"\xff"
            for i in range(3, len(data)):
                for k in range(4):
                    trie[data[i - k : i]][data[i]] += 1
    n, v = sum(count.values()), len(count)

    def code(context, symbol):
        p, out = 1.0, set()
        for k in range(3, -1, -1):
            known = {s: c for s, c in trie.get(context[3 - k :], {}).items() if s not in out}
            total = sum(known.values()) + len(known)
            if symbol in known:
                return math.log10(p * known[symbol] / total)
            if known:
                p *= len(known) / total
            out |= set(known)
        return math.log10(p / (256 - len(out)))

    result = []
    for doc, text in rows:
        tokens = [*plain_words(text), None]
        data = b"\xff" * 3 + (text or "").encode() + b"\xff"
        base = sum(math.log10((count[t] + 1) / (n + (v + 1))) for t in tokens)
        score = sum(code(data[i - 3 : i], data[i]) for i in range(3, len(data)))
        result.append((doc, held(doc), len(tokens), sum(count[t] > 0 for t in tokens), n, base, score))
    return result


def check(df, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 3))
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(expected(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("known", [ppm.KNOWN, 50])
def test_whole_table(spark, known):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 4000")
    check(ppm.score_documents(docs, known=known), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "A a\x0bb", "é \U0001f600 unseen bytes", "a" * 50_000, "b " * 9000, "long" * 30 + " x", "zq"])]
    rows += [(None, "a b"), (3, rows[3][1]), (3, "another"), *[(i, f"q{i} words of training {i}") for i in range(20, 40)]]
    assert {held(d) for d, _ in rows} == {True, False}
    spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id bigint, text string, score int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op9_ppm_score(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check(df, rows)


def test_nothing_to_learn_from(spark, tmp_path):
    only = next(i for i in range(100) if held(i))
    check(ppm.score_documents(spark.createDataFrame([(only, "some text")], "doc_id bigint, text string")), [(only, "some text")])
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_ppm_score(spark, str(tmp_path)).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        third = np.where(rng.random((256, 256)) < rng.choice([0.0, 0.01, 0.3]), rng.integers(1, 9, (256, 256)), 0)
        order1 = third.sum(axis=0) + np.where(rng.random(256) < 0.1, 3, 0)
        order0 = order1 + np.where(rng.random(256) < 0.2, 5, 0)
        first, symbol = np.divmod(np.arange(65536), 256)
        logs = ppm.log_probabilities(first, symbol, third.ravel(), np.stack([order1, order0]))
        sums = (10.0**logs).reshape(256, 256).sum(axis=1)
        full = (order0 > 0).all()
        assert np.all(sums <= 1 + 1e-9)
        assert full or np.allclose(sums, 1)
