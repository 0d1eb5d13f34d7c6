"""Session helpers: one place for the engine settings the library relies on."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidewatch", checkpoint_dir: str | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the web UI off.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the cluster
    manager and AQE's partition coalescing decide.  Tests pass ``local[*]`` and 8.
    ``checkpoint_dir``: a folder that all executors share.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where a local session names none, a folder in its warehouse.  On a cluster the
    setting is required: a folder of the driver's machine is not the executors'.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(path)
    return path


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tidewatch/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One computation (a reliable RDD checkpoint would compute twice unless cached),
    columnar files that later scans prune, and nothing kept on executors: a lost
    executor costs a re-read, not a recomputation of the lineage.  The files stay
    until ``release`` removes those of this application.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{getattr(_SCOPE, 'folder', '')}{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under this application's part of the checkpoint folder."""
    return f"{_own_folder(spark)}/{name}"


_SCOPE = threading.local()   # the folder of this thread's ``passing_tables``, if any
_OPEN, _LOCK = [], threading.Lock()  # per open ``passing_tables`` of all threads: the setting that its end restores, if it is the last
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_tables(spark: SparkSession):
    """What ``cut_lineage`` writes inside goes at the end, shuffle files as soon as the write that made them is done.

    For a step that is repeated many times over (a column of M9), so that the disk
    holds one round and not all.  Frames made inside are dead afterwards.
    """
    outer = getattr(_SCOPE, "folder", "")
    _SCOPE.folder = f"passing-{uuid.uuid4().hex}/"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, _SCOPE.folder))
    with _LOCK:  # the setting is the session's, and splits are fitted by several threads
        _OPEN.append(_OPEN[0] if _OPEN else spark.conf.get(CLEANUP, None))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        _SCOPE.folder = outer
        with _LOCK:
            before = _OPEN.pop()
            if not _OPEN:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote, once nothing reads it any more."""
    spark, own = df.sparkSession, _own_folder(df.sparkSession)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(own).toUri().getPath() + "/" in path.toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables this application wrote; frames read from them are dead afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
