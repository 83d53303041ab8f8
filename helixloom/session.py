"""What all parts need of a session: the package on its executors, and the folder that they share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Ship this package once to the executors of ``spark``, as a zip by Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="helixloom-")  # the driver serves the zip from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "helixloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session (tests) gets a temporary folder; on a cluster that would be a
    machine-local folder, so it is an error there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (known := context._jsc.sc().getCheckpointDir()).isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="helixloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_folders: ContextVar[str | None] = ContextVar("helixloom_folders", default=None)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, or in the folder of the ``scratch`` block that runs."""
    return f"{_folders.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the cluster's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside the block are deleted at its end; results must be written before it."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _folders.set(folder)
    try:
        yield
    finally:
        _folders.reset(before)
        delete(spark, folder)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if its files give fewer partitions than there are cores; a large input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
