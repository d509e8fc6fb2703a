from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerbstat.operators import scan
from kerbstat.schema import ALL_COLUMNS, CITATION_SCHEMA, ID, SCAN_COLUMNS, TRAINING_COLUMNS
from kerbstat.session import stage, work_dir
from kerbstat.sources.relational import jdbc_options
from kerbstat.sources.tables import conform, read_citations, read_raw, unreadable_cells


def test_column_lists():
    assert len(ALL_COLUMNS) == 19 and len(SCAN_COLUMNS) == 13 and len(TRAINING_COLUMNS) == 11
    assert len(CITATION_SCHEMA) == 21


def test_conform_checks_columns(citations):
    with pytest.raises(ValueError, match="county"):
        conform(citations.drop("county"))
    text = citations.withColumn("fine_amount", F.col("fine_amount").cast("string"))
    assert conform(text).schema["fine_amount"].dataType == CITATION_SCHEMA["fine_amount"].dataType


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, citations, format):
    path = f"{work_dir(spark)}/formats-{format}-{id(citations)}"
    sample = citations.orderBy(ID).limit(50)
    writer = sample.write.mode("overwrite")
    (writer.option("header", "true") if format == "csv" else writer).format(format).save(path)
    back = read_citations(spark, path, format).orderBy(ID)
    # CSV cannot tell blanks at the ends of text from the separator's padding, nor '' from null.
    columns = [ID, "issue_date", "violation_code", "precinct", "latitude", "fine_amount"]
    assert back.select(columns).collect() == sample.orderBy(ID).select(columns).collect()


@pytest.mark.parametrize("format", ["csv", "json"])
def test_text_formats_go_by_name_and_count_what_is_lost(spark, citations, format):
    path = f"{work_dir(spark)}/shuffled-{format}-{id(citations)}"
    texts = citations.orderBy(ID).limit(20).select([F.col(c).cast("string") for c in reversed(citations.columns)])
    first = texts.orderBy(ID).first()[ID]
    bad = texts.withColumns(
        {
            "issue_date": F.when(F.col(ID) == first, "someday").otherwise(F.col("issue_date")),
            "fine_amount": F.when(F.col(ID) == first, "1.239").otherwise(F.col("fine_amount")),
        }
    )
    writer = bad.write.mode("overwrite")
    (writer.option("header", "true") if format == "csv" else writer).format(format).save(path)
    back = {r[ID]: r for r in read_citations(spark, path, format).collect()}
    for r in citations.orderBy(ID).limit(20).collect():
        if r[ID] != first:
            assert back[r[ID]]["issue_date"] == r["issue_date"] and back[r[ID]]["violation_code"] == r["violation_code"]
    assert back[first]["issue_date"] is None and str(back[first]["fine_amount"]) == "1.24"
    lost = {r["column_name"]: tuple(r)[1:] for r in unreadable_cells(read_raw(spark, path, format)).collect()}
    assert lost["issue_date"] == (1, 0) and lost["fine_amount"] == (0, 1) and lost["latitude"] == (0, 0)


def test_filters_and_columns_reach_the_files(spark, conf, citations):
    conf("spark.sql.maxMetadataStringLength", "10000")
    path = f"{work_dir(spark)}/pushed-{id(citations)}"
    citations.write.mode("overwrite").parquet(path)
    rows = scan.in_dates(read_citations(spark, path), "1995-01-01", "1996-01-01")
    rows = scan.scan_points(rows, ["violation_code"], where="county = :c", args={"c": "K"})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for part in ("IsNotNull(latitude)", "GreaterThanOrEqual(issue_date", "LessThan(issue_date", "EqualTo(county,K)"):
        assert part in plan
    assert "plate_id" not in plan and "street_name" not in plan


def test_or_stays_inside_the_point_filter(citations):
    rows = scan.scan_points(citations, [ID], where="county = 'K' OR precinct = '1'")
    assert rows.where("latitude IS NULL").count() == 0


def test_bound_parameters_are_values(citations):
    assert scan.scan(citations, [ID], "county = :c", {"c": "K' OR '1'='1"}).count() == 0


def test_limit_is_ordered_and_zero_means_all(citations):
    first = [r[0] for r in scan.scan(citations, [ID], limit=5).collect()]
    everything = sorted(r[0] for r in citations.select(ID).collect())
    assert first == everything[:5]
    assert scan.scan(citations, [ID], limit=0).count() == len(everything)


def test_every_fraction_below_one_is_honoured(citations):
    n = citations.count()
    assert n - scan.bernoulli(citations, 0.9999999999).count() <= 1
    assert n - scan.bernoulli(citations, 1 - 2**-53).count() <= 1
    assert scan.bernoulli(citations, 2**-40).count() <= 1
    assert scan.bernoulli(citations, 0.5).count() == pytest.approx(n / 2, rel=0.1)


def test_table_info_reads_no_rows_by_default(citations):
    plan = scan.table_info(citations)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and scan.table_info(citations).count() == 21
    some = {r["column_name"]: r["null_rows"] for r in scan.table_info(citations, ["county"]).collect()}
    assert some["county"] == citations.where("county is null").count() and some["precinct"] is None


def test_sample_is_repeatable_and_commutes_with_filters(citations):
    ids = {r[0] for r in scan.bernoulli(citations, 0.2).select(ID).collect()}
    again = {r[0] for r in scan.bernoulli(citations.repartition(7), 0.2).select(ID).collect()}
    assert ids == again and 0.17 < len(ids) / citations.count() < 0.23
    filtered = {r[0] for r in scan.bernoulli(citations.where("county = 'K'"), 0.2).select(ID).collect()}
    assert filtered == ids & {r[0] for r in citations.where("county = 'K'").select(ID).collect()}
    other = {r[0] for r in scan.bernoulli(citations, 0.2, seed=7).select(ID).collect()}
    assert other != ids
    assert scan.bernoulli(citations, 0).count() == scan.bernoulli(citations, None).count() == citations.count()
    assert scan.bernoulli(citations, 1).count() == citations.count()
    with pytest.raises(ValueError):
        scan.bernoulli(citations, 1.5)


def test_training_load_columns(citations):
    assert scan.training_load(citations).columns == TRAINING_COLUMNS
    placed = scan.training_load(citations, include_coordinates=True)
    assert placed.columns == [*TRAINING_COLUMNS, "latitude", "longitude"]
    assert placed.count() == citations.where("latitude IS NOT NULL").count()


def test_chunks_on_executors_are_full(citations):
    import pandas as pd

    rows = citations.repartition(3).select(ID)
    sizes = scan.map_chunks(rows, lambda c: pd.DataFrame({"n": [len(c)]}), "n bigint", 700)
    got = [r[0] for r in sizes.collect()]
    assert sum(got) == citations.count()
    assert max(got) == 700 and sum(n < 700 for n in got) <= 3


def test_chunks_on_the_driver(citations):
    sizes = [len(c) for c in scan.iter_chunks(citations.select(ID, "county"), 2500)]
    assert sizes == [2500, 2500, 1000]


def test_adhoc_sql(spark, citations):
    got = scan.adhoc_sql(spark, "SELECT count(*) FROM {t} WHERE county = :c", {"c": "K"}, t=citations).first()[0]
    assert got == citations.where("county = 'K'").count()


def test_jdbc_options():
    options = jdbc_options("jdbc:postgresql://h/db", "tickets", "2020-01-01", "2024-01-01", 64)
    assert options["partitionColumn"] == "issue_date" and options["numPartitions"] == "64"
    assert "ST_Y(geom::geometry) AS latitude" in options["dbtable"]
    assert options["fetchsize"] == "50000"


def test_staged_table_is_measured(spark):
    staged = stage(spark.range(100), "numbers")
    assert staged.count() == 100
    assert staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
