"""What jobs share between driver and executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs). The application's own checkpoints in it go when the application ends."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="wayfold-"))
    if sc.applicationId not in _LEAVING:
        _LEAVING.add(sc.applicationId)
        store, at = _stored(spark, sc.getCheckpointDir())  # a folder that Spark has made for this application alone
        store.deleteOnExit(at)
    return found or sc.getCheckpointDir()


_LEAVING: set[str] = set()


def _stored(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path of a place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on, so that a lost executor costs a read and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free(*done: DataFrame) -> None:
    """Deletes what cut has written for these, which nothing that is still to be computed reads."""
    for df in done:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            store, at = _stored(df.sparkSession, file.get())
            store.delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application. Where it is installed on all machines it isn't needed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wayfold-")) / "wayfold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
