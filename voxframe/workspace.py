"""Where intermediate tables go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers import this package: by path in local mode, else as a zip that Spark hands out."""
    root, context = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or root in known:
        return spark
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if not context.master.startswith("local"):
        at = tempfile.mkdtemp(prefix="voxframe-")
        context.addPyFile(shutil.make_archive(f"{at}/voxframe", "zip", root, "voxframe"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset in local mode (tests) a temporary folder, which then becomes the setting. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/voxframe/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            return


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most so many rows, for tables with long texts: bounds the memory of a Python worker. Lowers the session's setting for good, as plans run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
