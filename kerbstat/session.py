"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "kerbstat", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the job brings its own."""
    settings = {
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        # Beyond 8000 bytes HotSpot leaves a method uncompiled; Spark then does better to split it.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``, where the job names one, else one in the warehouse.

    A local session without the setting gets a temporary folder. On a cluster a path of the local file system may be a
    mount that all machines share or a folder of one machine; a trial tells (:func:`gives_back`), once a session, unless
    ``spark.kerbstat.workDirIsShared`` is true, which says that the named path is such a mount. A cluster session without
    a folder that passes is refused.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    one_process = local and not context.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and local:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kerbstat-"))
        named = context.getCheckpointDir()
    declared = spark.conf.get("spark.kerbstat.workDirIsShared", "false") == "true"
    default_fs = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    if named and (reachable(named, one_process or declared, default_fs) or gives_back(spark, named)):
        return named.rstrip("/")
    spare = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kerbstat-work"
    if reachable(spare, one_process, default_fs) or gives_back(spark, spare):
        return spare
    raise ValueError(f"executors do not share {named or spare}; name a folder that all can reach in spark.checkpoint.dir")


_GIVES_BACK: dict[tuple[str, str], bool] = {}


def gives_back(spark: SparkSession, folder: str) -> bool:
    """Whether a small table that the executors write to a folder is whole when it is read; tried once a session.

    What executors write to a disk of their own is not there when the driver lists the folder.
    """
    tried = spark.sparkContext.applicationId, folder
    if tried not in _GIVES_BACK:
        path, parts = f"{folder.rstrip('/')}/trial-{uuid4().hex}", spark.sparkContext.defaultParallelism
        try:
            spark.range(0, parts, 1, parts).write.parquet(path)
            _GIVES_BACK[tried] = spark.read.schema("id bigint").parquet(path).count() == parts
            remove(spark, path)
        except (PySparkException, Py4JJavaError):
            _GIVES_BACK[tried] = False
    return _GIVES_BACK[tried]


def reachable(folder: str, local_is_shared: bool, default_fs: str = "file:///") -> bool:
    """Whether every executor is known to reach a folder; one without a scheme is in the default file system."""
    scheme = urlparse(folder).scheme or urlparse(default_fs).scheme
    return local_is_shared or scheme not in ("", "file")


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A job: what :func:`stage` writes inside is removed at the end.

    Frames that a job returns may still read staged tables. Write or collect them inside; without a
    surrounding ``staging`` the folders stay until the work folder is cleared.
    """
    folders: list[str] = []
    token = _STAGED.set(folders)
    try:
        yield
    finally:
        _STAGED.reset(token)
        for folder in folders:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The read-back survives lost executors, is not recomputed by later passes, and carries its
    measured size: Catalyst broadcasts it in a join only below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, where adaptive
    execution splits hot keys. Inside :func:`staging` the folder goes when the job ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid4().hex}"
    folders = _STAGED.get()
    if folders is not None:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a small input, one with fewer partitions than there are cores.

    A large input has more splits than cores and passes as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
