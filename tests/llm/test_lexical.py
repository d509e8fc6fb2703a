"""Ranked lexical search against plain sums over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kerbstat.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain(docs, items, k):
    held = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
                for w in set(words(text)) if c[w]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def found(spark, docs, items, **how):
    left = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, score int, rank string")
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    got = lexical.search(left, right, **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    shares = [1 / (1 + i) for i in range(120)]
    return [(i, " ".join(rng.choices(vocabulary, shares, k=rng.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("block", [7, 64, 5_000])
@pytest.mark.parametrize("k", [1, 10])
def test_random_corpus(spark, block, k):
    docs, rng = corpus(400, 3), random.Random(4)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(125)], k=rng.randrange(1, 30)))) for i in range(25)]
    assert found(spark, docs, items, k=k, block=block) == plain(docs, items, k)


def test_edge_rows(spark):
    docs = [
        (0, None), (1, ""), (2, "?! --"), (3, "Alpha BETA beta ÄÄ"), (3, "Alpha BETA beta ÄÄ"), (None, "alpha beta"), (None, "alpha beta"),
        (9, "alpha beta"), (4, "alpha beta"), (5, "gamma " * 50_000), (6, "漢字 ää ÄÄ x\x00y"), (-7, "alpha beta"),
    ]
    items = [(0, "alpha beta"), (0, "alpha beta"), (1, None), (2, "absent"), (None, "gamma x"), (3, "ÄÄ y"), (4, "alpha alpha, Alpha!")]
    assert found(spark, docs, items) == plain(docs, items, 50)
    assert found(spark, docs, items, k=2, block=3, item_chars=10) == plain(docs, items, 2)


def test_nothing_to_search(spark):
    assert found(spark, [], [(0, "alpha")]) == []
    assert found(spark, [(0, "alpha")], []) == []
    assert found(spark, [(0, "alpha"), (1, "alpha")], [(0, "alpha")]) == plain([(0, "alpha"), (1, "alpha")], [(0, "alpha")], 50)


def index_of(docs, items):
    """One block, without Spark."""
    held = [Counter(words(t)) for _, t in docs]
    term_of = {w: i for i, w in enumerate(items.terms)}
    postings = sorted((term_of[w], row, n) for row, c in enumerate(held) for w, n in c.items() if w in term_of)
    term, row, tf = (np.array(x, np.int64) for x in zip(*postings, strict=True))
    lengths = np.array([sum(c.values()) for c in held])
    kept, df = np.unique(term, return_counts=True)
    all_df = np.zeros(len(items.terms), np.int64)
    all_df[kept] = df
    n_docs, n_terms = int((lengths > 0).sum()), int(lengths.sum())
    weight = lexical.weights(all_df, n_docs)
    pairs, of = lexical.pairs_of(items, weight)
    impact = lexical.impacts(weight[term], tf, lengths[row], n_docs, n_terms)
    starts = np.searchsorted(term, np.append(kept, len(weight)))
    joint, few, both = lexical.join_pairs(pairs, kept, starts, row, impact, len(docs), len(weight))
    ends = np.cumsum([0] + [len(x) for x in both])
    one = {"ids": np.arange(len(docs)), "held": kept, "starts": starts, "row": row, "impact": impact, "joint": joint}
    return lexical.Block(one | {"both_starts": ends, "both": np.concatenate(both), "kept": few}, pairs, len(weight)), of, (joint, pairs, term, row, impact)


def test_pair_bounds_and_plans():
    docs = corpus(600, 11)
    rng = random.Random(12)
    items = lexical.Items.from_texts(list(range(30)), [" ".join(rng.choices([f"w{j}" for j in range(120)], k=20)) for _ in range(30)])
    block, of, (joint, pairs, term, row, impact) = index_of(docs, items)
    own = {}
    for t, r, x in zip(term.tolist(), row.tolist(), impact.tolist(), strict=True):
        own.setdefault(t, {})[r] = x
    for p, (a, b) in enumerate(pairs.tolist()):
        common = own.get(a, {}).keys() & own.get(b, {}).keys()
        assert joint[p] == max((own[a][r] + own[b][r] for r in common), default=0)
    tighter = skipped = 0
    for pair_ids in of:
        terms = {t for p in pair_ids for t in pairs[p].tolist() if t >= 0}
        scores = np.array([sum(own.get(t, {}).get(r, 0) for t in terms) for r in range(len(docs))])
        singles = sum(max(own.get(t, {0: 0}).values()) for t in terms)
        tighter += block.most[pair_ids].sum() < singles
        for least in (1, int(np.quantile(scores, 0.5)) + 1, int(np.quantile(scores, 0.99)) + 1, int(scores.max()), int(scores.max()) + 1):
            rows, got = block.search(pair_ids, least)
            assert rows.tolist() == np.flatnonzero(scores >= least).tolist()
            assert got.tolist() == scores[scores >= least].tolist()
            choice = block.plan(pair_ids, least)
            skipped += choice is not None and (choice < 2).any()
    assert tighter > 0 and skipped > 0
