"""Tables in the order of a key: limits and chunks, and which files they open."""

from __future__ import annotations

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from kerbstat.operators import scan
from kerbstat.session import work_dir
from kerbstat.sources.clustered import ClusteredTable


@pytest.fixture(scope="module")
def table(spark, citations):
    own = ClusteredTable(spark, f"{work_dir(spark)}/clustered-{uuid4().hex}")
    own.write(citations, file_rows=500)
    return own


def files_of(df):
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_the_directory(table, citations):
    files = table.files().orderBy("before").collect()
    assert len(files) == 12 and sum(r["rows"] for r in files) == table.rows() == citations.count()
    assert [r["before"] for r in files] == [sum(x["rows"] for x in files[:i]) for i in range(len(files))]
    assert all(a["most"] < b["least"] for a, b in zip(files, files[1:], strict=False))


def test_a_limit_opens_the_first_files(table, citations):
    got = table.first(700, ["summons_number", "plate_id"])
    want = scan.scan(citations, ["summons_number", "plate_id"], limit=700)
    assert got.collect() == want.collect()
    first = [r["file"] for r in table.files().orderBy("before").collect()]
    assert 1 < len(files_of(got)) <= 3 and files_of(got) == set(first[: len(files_of(got))])


@pytest.mark.parametrize(("where", "args", "limit"), [("county = :c", {"c": "K"}, 50), ("violation_code = '7'", None, 10), ("county = 'none'", None, 5)])
def test_a_limit_with_a_condition(table, citations, where, args, limit):
    got = table.first(limit, ["summons_number"], where, args)
    assert got.collect() == scan.scan(citations, ["summons_number"], where, args, limit).collect()
    if args:
        assert len(files_of(got)) < 12


def test_a_limit_beyond_the_table(table, citations):
    assert table.first(10**9).count() == citations.count()
    assert table.first(10**9, where="county IS NOT NULL").count() == citations.where("county IS NOT NULL").count()


def test_chunks_are_those_of_the_ordered_table(table, citations):
    ids = [r[0] for r in citations.select("summons_number").orderBy("summons_number").collect()]
    parts = [[r[0] for r in c.collect()] for c in table.chunks(1_300, columns=["summons_number"])]
    assert [len(p) for p in parts] == [1_300] * 4 + [800] and sum(parts, []) == ids


def test_a_chunk_is_read_anew_without_those_before(spark, table):
    before = table.chunk(3, 700).collect()
    again = ClusteredTable(spark, table.root)  # as after a restart
    part = again.chunk(3, 700)
    assert part.collect() == before and len(files_of(part)) <= 3
    assert [c.count() for c in again.chunks(700, first=8)] == [400]
    assert again.chunk(99, 700).isEmpty()
    with pytest.raises(ValueError, match="numbered from 0"):
        again.chunk(-1)


def test_nulls_and_repeated_keys(spark):
    own = ClusteredTable(spark, f"{work_dir(spark)}/clustered-{uuid4().hex}", key="k")
    rows = [(None, i) for i in range(7)] + [(i // 5, i) for i in range(60)] + [(3, 15)] * 4
    own.write(spark.createDataFrame(rows, "k int, v int"), file_rows=10)
    whole = [tuple(r) for r in own.chunk(0, 1_000).collect()]
    assert [k for k, _ in whole] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k)) and sorted(whole, key=str) == sorted(rows, key=str)
    assert sum(([tuple(r) for r in c.collect()] for c in own.chunks(9)), []) == whole
    assert [tuple(r) for r in own.first(5).collect()] == whole[:5]


def test_an_empty_table_and_a_second_write(spark, citations):
    own = ClusteredTable(spark, f"{work_dir(spark)}/clustered-{uuid4().hex}")
    own.write(citations.limit(0))
    assert own.rows() == 0 and own.first(5).isEmpty() and own.chunk(0).isEmpty() and list(own.chunks()) == []
    with pytest.raises(Exception, match="(?i)exist"):
        own.write(citations.limit(1))
    assert own.read().where(F.lit(True)).isEmpty()
