"""Near-duplicate vectors against brute force, and recall of the index."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kerbstat.llm import embeddings
from kerbstat.llm.queries import op3_pq_near_dedup
from tests.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, least=0.93):
    ok = []
    for i, v, label in rows:
        v = None if v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, dtype=np.float64)
        ok.append(v)
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            u, v = ok[a], ok[b]
            if u is None or v is None or rows[a][2] != rows[b][2] or len(u) != len(v):
                continue
            if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least_id = {}
    for i in range(n):
        known = [x for x in (rows[i][0], least_id.get(find(i))) if x is not None]
        least_id[find(i)] = min(known) if known else None
    out = [(rows[i][0], links[i], least_id[find(i)], rows[i][0] is not None and rows[i][0] == least_id[find(i)]) for i in range(n)]
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(op3_pq_near_dedup(spark, SMALL)) == expected(rows)


def test_edge_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, nan], 0), (5, [1.0, None], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None),
        (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0], 1), (None, [1.0, 2.1], 0),
        (12, [1.0, 2.0, 0.0], 0), (13, [0.0, 1.0], 2), (None, [0.0, 1.0], 2), (None, [0.0, 1.0], 3), (14, [1e-38, 2e-38], 0), (15, [1e38, 2e38], 0),
    ]
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node int, links string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert result(op3_pq_near_dedup(spark, str(tmp_path))) == expected(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op3_pq_near_dedup(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("block", "list_size"), [(20, 50), (4096, 30)])
def test_clusters_across_lists_and_blocks(spark, block, list_size):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.27])).astype(np.float32).tolist(), int(k % 2)))
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert result(embeddings.near_vectors(df, reach=1.0, block=block, list_size=list_size)) == want
    got = result(embeddings.near_vectors(df, block=block, list_size=list_size))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_links_along_few_directions_count_at_both_ends(spark):
    """Copies moved towards another cluster, all along one line, with lists that cut it in many places."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        ends = embeddings.unit(rng.normal(size=(2, 384)))
        for share in rng.random(100):
            blend = share * ends[0] + (1 - share) * ends[1]
            rows.append((len(rows), blend.astype(np.float32).tolist(), int(k % 2)))
    rows += [(len(rows) + i, v, label) for i, (_, v, label) in enumerate(rows[::50])]
    got = result(embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA), block=40, list_size=20))
    assert got == expected(rows)


def test_lookup_distances_are_those_of_the_decoded_entries():
    rng = np.random.default_rng(1)
    units = embeddings.unit(rng.normal(size=(400, 20)))
    tool = embeddings.Quantiser.fit(units, 4)
    own, codes, error = tool.encode(units)
    for c in range(4):
        members = own == c
        decoded = tool.centres[c] + np.concatenate([book[codes[members, s]] for s, book in enumerate(tool.books)], axis=1)
        assert np.allclose(tool.distances(units[:9], c, codes[members]), np.sqrt(((units[:9, None] - decoded[None]) ** 2).sum(-1)))
        assert np.allclose(error[members], np.sqrt(((units[members] - decoded) ** 2).sum(1)))
