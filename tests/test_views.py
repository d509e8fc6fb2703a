from __future__ import annotations

import datetime
import shutil
from decimal import Decimal
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from kerbstat.plans.views import VIEWS, ViewStore
from kerbstat.session import work_dir


@pytest.fixture
def store(spark):
    return ViewStore(spark, f"{work_dir(spark)}/store-{uuid4().hex}")


def test_round_trip_in_stored_order(store, citations):
    store.create("precinct_stats", citations)
    back = store.read("precinct_stats")
    assert back.exceptAll(VIEWS["precinct_stats"].compute(citations)).count() == 0
    keys = [(r["precinct"], r["county"]) for r in back.collect()]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] is None, k[1]))


def test_create_leaves_an_existing_view(store, citations):
    store.create("monthly_trends", citations)
    rows = store.read("monthly_trends").count()
    store.create("monthly_trends", citations.limit(0))
    assert store.read("monthly_trends").count() == rows


def test_refresh_switches_and_spares_readers(store, citations):
    store.create("agency_stats", citations.where("issuing_agency = 'P'"))
    old = store.read("agency_stats")
    store.refresh("agency_stats", citations)
    new = store.read("agency_stats")
    assert {r[0] for r in old.select("issuing_agency").distinct().collect()} == {"P"}
    assert new.select("issuing_agency").distinct().count() > 1


def test_unfinished_version_is_not_read(spark, store, citations):
    store.create("violation_stats", citations)
    rows = store.read("violation_stats").count()
    spark.range(5).write.parquet(f"{store.root}/violation_stats/data/99999999T000000000000-x")
    assert store.read("violation_stats").count() == rows


def test_old_versions_are_removed(spark, store, citations):
    few = citations.limit(10)
    for _ in range(store.keep + 2):
        store.refresh("monthly_trends", few)
    assert len(store._versions("monthly_trends")) == store.keep
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store.root}/monthly_trends/data")
    folders = {r["path"].split("/data/")[1].split("/")[0] for r in data.select("path").collect()}
    assert folders == set(store._versions("monthly_trends"))


def test_an_unreadable_store_is_an_error(spark, store, citations):
    store.create("monthly_trends", citations.limit(10))
    broken = ViewStore(spark, "nosuchscheme://somewhere/views")
    with pytest.raises(Exception, match="(?i)scheme"):
        broken.create("monthly_trends", citations)


@pytest.fixture
def incremental(spark):
    return ViewStore(spark, f"{work_dir(spark)}/store-{uuid4().hex}", incremental=True)


def same(one, two):
    assert one.columns == two.columns and [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.mark.parametrize("name", list(VIEWS))
def test_changed_rows_are_enough(incremental, citations, name):
    third = F.pmod(F.xxhash64("summons_number"), F.lit(3))
    first, second = citations.where(third != 0), citations.where(third == 0)
    incremental.create(name, first)
    same(incremental.read(name), VIEWS[name].compute(first))
    incremental.apply(name, added=second)
    same(incremental.read(name), VIEWS[name].compute(citations))
    incremental.apply(name, removed=first)
    same(incremental.read(name), VIEWS[name].compute(second))
    incremental.apply(name, removed=second)
    assert incremental.read(name).isEmpty()


def test_a_changed_row_goes_and_comes(spark, incremental):
    schema = "violation_code string, violation_desc string, precinct string, county string, fine_amount decimal(10,2), issue_date date"
    day = datetime.date(2024, 1, 1)

    def rows(*some):
        return spark.createDataFrame(some, schema)

    kept = ("7", None, "1", None, None, None)
    last = ("7", None, "2", "K", Decimal("65.00"), day)
    incremental.create("violation_stats", rows(kept, last, last))
    incremental.apply("violation_stats", added=rows(("7", None, None, "Q", Decimal("35.00"), None)), removed=rows(last))
    r = incremental.read("violation_stats").first().asDict()
    assert (r["total_tickets"], r["precincts_affected"], r["counties_affected"], r["min_fine"], r["max_fine"]) == (3, 2, 2, Decimal("35.00"), Decimal("65.00"))
    assert r["avg_fine"] == 50.0 and r["first_seen"] == r["last_seen"] == day
    incremental.apply("violation_stats", removed=rows(last, ("7", None, None, "Q", Decimal("35.00"), None)))
    r = incremental.read("violation_stats").first().asDict()
    assert (r["total_tickets"], r["avg_fine"], r["min_fine"], r["first_seen"]) == (1, None, None, None)


def test_rows_that_are_not_there_cannot_go(spark, incremental, citations):
    few = citations.limit(20)
    incremental.create("monthly_trends", few)
    before = incremental.read("monthly_trends").collect()
    with pytest.raises(ValueError, match="does not hold"):
        incremental.apply("monthly_trends", removed=few.withColumn("violation_code", F.lit("none")))
    assert incremental.read("monthly_trends").collect() == before


def test_apply_reads_the_state_and_the_changes_alone(spark, incremental, citations, tmp_path):
    citations.write.parquet(f"{tmp_path}/whole")
    incremental.create("agency_stats", spark.read.parquet(f"{tmp_path}/whole"))
    shutil.rmtree(f"{tmp_path}/whole")  # a read of the table would fail
    incremental.apply("agency_stats", added=citations.limit(0))
    same(incremental.read("agency_stats"), VIEWS["agency_stats"].compute(citations))


def test_apply_needs_state(store, citations):
    with pytest.raises(LookupError):
        store.apply("agency_stats", citations)
    store.create("agency_stats", citations.limit(5))
    with pytest.raises(ValueError, match="incremental"):
        store.apply("agency_stats", citations)


def test_missing_view(store):
    with pytest.raises(LookupError):
        store.read("street_stats")
