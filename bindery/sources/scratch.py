"""Tables that are written once to the shared folder and read again, which cuts lineage and survives lost executors.

They lie in one folder for each driver process. Superseded ones are removed by ``discard``; the rest goes when the driver
ends. A driver that is killed leaves its folder behind.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}
_kept: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session, as in tests, may do without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="bindery-"))
    return _own[0]


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for folder, spark in _folders.items():
        try:
            remove(spark, folder)
        except Exception:  # the session is over, and with it the way to its files
            pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this driver's part of the shared folder."""
    base = shared_dir(spark)
    folder = next((f for f in _folders if f.startswith(f"{base}/")), None)
    if folder is None:
        if not _folders:
            atexit.register(_remove_all)
        folder = f"{base}/bindery-{uuid.uuid4().hex}"
    _folders[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that what follows does not compute it again."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    _kept[out] = path
    return out


def discard(*landed_before: DataFrame) -> None:
    """Remove tables that ``landed`` returned and that nothing will read any more."""
    for df in landed_before:
        if path := _kept.pop(df, None):
            remove(df.sparkSession, path)
