"""Shared scratch tables, partition sizing and byte-level file access.

Intermediate results that must survive a lost executor are written as Parquet
below the folder in ``spark.checkpoint.dir``.  The folder is read from the
session; only where it is unset (a local test session) a temporary folder of
this machine is used, and never on a cluster.  All tables of an application lie
in one folder, which ``clear`` deletes: call it when the results of its queries
have been written.  A session that ends with Python clears up by itself.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from lexiloom.sources.corpus import ship

TARGET_BYTES = 64 << 20
_local: dict[str, str] = {}
_written: dict[tuple[str, str], list[str]] = {}
_scope = [""]
_applications: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        folder = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, folder, True)
        _local[app] = "file://" + folder
    return _local[app]


def application_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/lexiloom/{app}"
    if app not in _applications:
        _applications.add(app)
        atexit.register(_clear_at_end, spark.sparkContext, path)
    return path


def _clear_at_end(context: SparkContext, path: str) -> None:
    if SparkContext._active_spark_context is context and context._jvm is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; no DataFrame built on them can be read any more."""
    _delete(spark, application_dir(spark))
    for key in [k for k in _written if k[0] == spark.sparkContext.applicationId]:
        del _written[key]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault((spark.sparkContext.applicationId, _scope[-1]), []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``name`` and can be released together."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope.

    Call it only when every DataFrame built on them has been written.
    """
    for path in _written.pop((spark.sparkContext.applicationId, name), []):
        _delete(spark, path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch than Spark's default, so that long texts fit; a number set by the user stays.

    The package is sent to the executors too: operators call this first.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def task_count(df: DataFrame, per_task: int = TARGET_BYTES, expand: float = 1.0) -> int:
    """Shuffle partitions for ``df``: the session's number, or more for large inputs."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = min(size, 1 << 60)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, int(size * expand / per_task)))
