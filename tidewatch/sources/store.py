"""Tables prepared once per application and input, read by every later job.

A prepared table lives under the application's part of the shared checkpoint
folder.  Its name holds a digest of the input files' paths, sizes and times, so
changed input is prepared anew and another session never reads a stale copy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import scratch_path


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Path, size and modification time of every file under ``path``."""
    fs, p = _path(spark, path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return sorted(out)


def _place(spark: SparkSession, name: str, inputs: list[str]) -> str:
    digest = hashlib.md5("\n".join(x for p in inputs for x in listing(spark, p)).encode()).hexdigest()
    return scratch_path(spark, f"prepared/{name}-{digest}")


def _publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path`` and move there when complete, so no reader sees a part and of two writers one wins."""
    if exists(spark, path):
        return
    own = f"{path}-{uuid.uuid4().hex}"
    write(own)
    fs, p = _path(spark, path)
    _, mine = _path(spark, own)
    try:
        moved = not fs.exists(p) and fs.rename(mine, p)
    except Py4JJavaError:
        moved = False
    if not moved:
        if not fs.exists(p):
            raise OSError(f"could not move {own} to {path}")
        fs.delete(mine, True)


def once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``'s rows, written by the first call for these inputs and read back by all."""
    path = _place(spark, name, inputs)
    _publish(spark, path, lambda own: build().write.parquet(own))
    return spark.read.parquet(path)


def model_once(spark: SparkSession, name: str, inputs: list[str], spec, build: Callable[[], object]):
    """A fitted model, saved by the first call for these inputs and settings and loaded by all."""
    from tidewatch.sources import tables

    path = _place(spark, f"model-{name}-{hashlib.md5(repr(spec).encode()).hexdigest()}", inputs)
    _publish(spark, path, lambda own: tables.save_model(build(), own))
    return tables.load_model(spark, path)
