"""Work folders and staged tables."""

from __future__ import annotations

import pytest

from checks.registry import QUERIES
from kerbstat import session
from kerbstat.plans.model import FOREST


def folders(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session.work_dir(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath().getName()) for f in system.listStatus(path)}


def test_staged_tables_go_with_their_job(spark):
    before = folders(spark)
    with session.staging(spark):
        assert session.stage(spark.range(5), "inside").count() == 5
        assert folders(spark) - before
    assert folders(spark) == before
    session.stage(spark.range(5), "outside")
    assert any(name.startswith("outside-") for name in folders(spark) - before)


def test_staged_tables_go_when_a_job_fails(spark):
    before = folders(spark)
    with pytest.raises(ValueError), session.staging(spark):
        session.stage(spark.range(5), "failed")
        raise ValueError
    assert folders(spark) == before


@pytest.mark.parametrize(
    ("folder", "shared", "default_fs", "good"),
    [
        ("hdfs://n/x", False, "file:///", True), ("s3a://b/x", False, "file:///", True), ("file:///tmp/x", False, "file:///", False),
        ("/tmp/x", False, "file:///", False), ("/tmp/x", False, "hdfs://n", True), ("file:///mnt/x", True, "file:///", True),
    ],
)
def test_node_local_folders_are_told_apart(folder, shared, default_fs, good):
    assert session.reachable(folder, shared, default_fs) is good


def test_a_shared_mount_serves_a_cluster(spark, monkeypatch):
    own = session.work_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")  # all that tells it from a local session
    assert session.work_dir(spark) == own
    with session.staging(spark):
        assert session.stage(spark.range(5), "inside").count() == 5


def test_folders_that_do_not_give_back_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    own = session.work_dir(spark)
    monkeypatch.setattr(session, "gives_back", lambda _, folder: folder.rstrip("/") != own)
    assert session.work_dir(spark).endswith("/kerbstat-work")
    monkeypatch.setattr(session, "gives_back", lambda _, folder: False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(spark)


def test_trial_of_a_folder(spark, tmp_path):
    (tmp_path / "file").touch()
    assert not session.gives_back(spark, f"file://{tmp_path}/file/below")
    assert session.gives_back(spark, f"file://{tmp_path}/whole")
    assert not list((tmp_path / "whole").iterdir())
    short = tmp_path / "short"
    part = type(spark.range(0)).count
    with pytest.MonkeyPatch.context() as patch:  # a part that another machine keeps
        patch.setattr(type(spark.range(0)), "count", lambda df: part(df) - 1)
        assert not session.gives_back(spark, f"file://{short}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of 400 line items."""
    root, day = f"file://{tmp_path_factory.mktemp('tables')}", "timestamp'1995-03-01' + make_dt_interval(cast(id % 500 as int))"
    tables = {
        "lineitem": ["id div 4 AS l_orderkey", "id % 90 AS l_partkey", "id % 60 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber",
                     "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", f"{day} AS l_shipdate"],
        "orders": ["id AS o_orderkey", f"{day} AS o_orderdate"],
        "part": ["id AS p_partkey", "concat('B', id % 5) AS p_brand"],
    }
    for name, columns in tables.items():
        spark.range(400).selectExpr(*columns).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize(
    "query",
    ["clustered_limit", "clustered_limit_where", "clustered_chunk", "confusion_topn", "csv_roundtrip", "encoded_features", "encoded_target",
     "fine_distribution", "heatmap_points", "hotspots_top", "metric_report", "rare_class_filter"],
)
def test_queries_that_stage_run_on_a_cluster_with_a_shared_mount(spark, folder, query, monkeypatch):
    local = sorted(map(str, QUERIES[query](spark, folder).collect()))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    assert sorted(map(str, QUERIES[query](spark, folder).collect())) == local


@pytest.mark.parametrize("query", ["feature_importance", "feature_importance_facts", "model_info", "model_info_facts", "saved_model_facts"])
def test_forests_run_on_a_cluster_with_a_shared_mount(spark, folder, query, monkeypatch):
    monkeypatch.setitem(FOREST, "numTrees", 3)
    local = sorted(map(str, QUERIES[query](spark, folder).collect()))
    assert local
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    assert sorted(map(str, QUERIES[query](spark, folder).collect())) == local
