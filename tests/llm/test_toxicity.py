"""Toxicity: compression lengths against one window at a time, held-out accuracy, edge cases."""

from __future__ import annotations

import random
from zlib import crc32

import pyarrow as pa
import pytest
import zstandard

from kerbstat.llm import toxicity
from kerbstat.llm.queries import op11_toxicity
from tests.conftest import SMALL

WORDS = "the river runs past old stone houses and many green fields where people walk in summer light".split()
BAD = ["vilecreature", "rottenfool", "wretchedpig"]


def texts(n, seed=1, bad=0.3):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randrange(20, 60))
        toxic = rng.random() < bad
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rows = texts(400)
    return toxicity.fit_texts([t for _, t, _ in rows], [x for *_, x in rows], [i % 2 for i, *_ in rows])


def plain_gain(word: bytes, model) -> int:
    """One window with a fresh compressor for each dictionary."""
    lengths = [len(toxicity.compressor(d).compress(b" " + word + b" " + model.carrier)) for d in (model.ordinary, model.toxic)]
    return lengths[0] - lengths[1]


def test_counts_are_those_of_single_windows(model):
    cases = ["", "The RIVER, runs! rottenfool rottenfool wretchedpig", "x" * 500 + " vilecreature" * 2, "ñandú größe 漢字 " * 3]
    own = toxicity.comparer(model.ordinary, model.toxic, model.carrier)
    found = toxicity.window_counts(pa.array(cases), own)
    for text, counts in zip(cases, found.tolist(), strict=True):
        words = text.encode().translate(toxicity.PLAIN).split()
        gains = {w: max(plain_gain(p, model) for p in toxicity.pieces(w)) for w in words}
        assert counts == [len(words)] + [sum(g >= least for g in gains.values()) for least in toxicity.GAINS]


def test_pieces_cover_a_long_word():
    word = bytes(range(48, 58)) * 30
    parts = toxicity.pieces(word)
    assert max(map(len, parts)) <= toxicity.WIDTH and b"".join(p[: toxicity.WIDTH // 2] for p in parts[:-1]) + parts[-1] == word


def test_dictionaries_share_their_beginning(model):
    assert len(model.ordinary) == len(model.toxic)
    assert model.ordinary[: -toxicity.CONTENT] == model.toxic[: -toxicity.CONTENT]
    assert all(w.encode() in model.toxic for w in BAD)
    assert not any(w.encode() in model.ordinary for w in BAD)
    zstandard.ZstdCompressionDict(model.toxic)


def test_held_out_accuracy(model):
    rows = texts(300, seed=7)
    own = toxicity.comparer(model.ordinary, model.toxic, model.carrier)
    scores = model.scores(toxicity.window_counts(pa.array([t for _, t, _ in rows]), own))
    right = sum((s >= toxicity.LEAST) == x for s, (*_, x) in zip(scores, rows, strict=True))
    assert right >= 0.98 * len(rows)


def write(spark, folder, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id bigint, text string, toxic string, score double")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_query_learns_from_labels_alone(spark, tmp_path):
    rows = texts(300, seed=3)
    labels = [(i, 0, int(x) if crc32(str(i).encode()) % 4 != 2 else 1 - int(x)) for i, _, x in rows]  # held-out ones are wrong
    extra = [(None, "rottenfool " * 5), (5, rows[5][1]), (9_000, None), (9_001, ""), (9_002, "river " * 60_000 + "vilecreature"), (9_002, "river")]
    write(spark, tmp_path, [(i, t) for i, t, _ in rows] + extra, labels + [(None, 1, 1), (3, 1, None)])
    got = op11_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: x for i, _, x in rows}
    for r in got:
        assert r["held_out"] == (crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [r for r in got if r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) >= 0.97 * len(known)
    assert {r["n_windows"] for r in got if r["doc_id"] in (9_000, 9_001)} == {0}
    assert sorted(r["n_windows"] for r in got if r["doc_id"] == 9_002) == [1, 60_001]
    same = [r for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0]["score"] == same[1]["score"]


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(0, 1, 1)], 1.0), ([(0, 1, 0), (1, 0, None)], 0.0)])
def test_without_labels_of_one_class(spark, tmp_path, labels, score):
    write(spark, tmp_path, [(0, "rottenfool"), (1, None)], labels)
    assert [round(r["score"], 6) for r in op11_toxicity(spark, str(tmp_path)).collect()] == [score] * 2


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [(0, 1, 1), (1, 1, 0)])
    assert op11_toxicity(spark, str(tmp_path)).count() == 0


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_toxicity(spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["n_windows"] == len((docs[i] or "").encode().translate(toxicity.PLAIN).split())
