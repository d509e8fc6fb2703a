"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from kerbstat.llm import simhash
from kerbstat.llm.queries import op5_simhash_near_dedup
from tests.conftest import SMALL

WHITE = " \t\n\x0b\f\r"


def plain_words(text):
    return plain_words_cased("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_words_cased(text):
    out, word = [], ""
    for ch in text or "":
        if ch in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out + [word] if word else out


def plain_fingerprint(text):
    words = plain_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        known = [x for x in (d, least.get(r)) if x is not None]
        least[r] = min(known) if known else None
    return [least[find(i)] for i in range(len(ids))]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components([d for d, _ in rows], fps)
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps, strict=True)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_whole_table_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(op5_simhash_near_dedup(spark, SMALL)) == expected(rows)


def test_edge_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "ONE  two"), (6, "Ünï ÉCOLE x y z"),
        (None, "one\x0btwo"), (8, long), (9, long + " tail"), (10, "a b c d"), (10, "another text with id ten"),
    ]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, fp int, component_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert result(op5_simhash_near_dedup(spark, str(tmp_path))) == expected(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    components = {c for _, _, c in expected(rows)}
    assert kept.count() >= len(components)
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} >= {(1, None), (4, "one two"), (8, long)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_simhash_near_dedup(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("shard", "block"), [(16, 7), (64, 8192), (4096, 50)])
def test_tree_and_blocks_lose_no_pair(spark, shard, block):
    """Clusters that straddle boundaries, with tiny shards and blocks."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(rng.randrange(12)):
            c ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(c)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.link_edges(distinct, 2, shard, block)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = plain_components(signed, fps)
    assert [roots.get(f, f) for f in signed] == want


def test_visits_are_bounded_by_the_triangle():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    tree = simhash.VantageTree(fps[:1000], 6)
    row, shard = tree.visits(fps, 2)
    assert len(row) < 8 * len(fps)
    assert len(set(zip(row.tolist(), shard.tolist(), strict=True))) == len(row)


def test_depth_follows_the_table():
    depths = [simhash.depth_for(n) for n in (0, 1, 32_768, 100_000, 8_000_000, 10**9, 10**12)]
    assert depths == [0, 0, 4, 5, 11, 17, 17]


def test_copies_of_a_print_at_eight_million():
    """Prints without structure, which is the worst case, and the tree that eight million of them get."""
    rng = np.random.default_rng(1)
    depth = simhash.depth_for(8_000_000)
    tree = simhash.VantageTree(rng.integers(0, 2**64, simhash.PER_SHARD << depth, dtype=np.uint64), depth)
    fps = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    row, _ = tree.visits(fps, 2)
    assert 1 + len(row) / len(fps) < 30
