"""Session helpers: UTC, and written intermediate tables that outlive executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def use_utc(spark: SparkSession) -> None:
    """Hours and dates are defined in UTC, whatever the session started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = folder = tempfile.mkdtemp(prefix="kerbline-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    return _local_folders[context.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
        atexit.register(_delete, df.sparkSession, context.getCheckpointDir())
    return df.checkpoint(eager=True)


class Written:
    """Intermediate tables of one job, written as Parquet to the shared folder.

    ``keep`` writes a table and returns it reread, with its lineage cut; then the
    shuffle files behind it are given back. ``drop`` deletes a table that nothing
    needs any more; tables a lazy result still reads go when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return kept

    def clear(self) -> None:
        """Delete all tables: for a job whose result is written elsewhere."""
        self.paths.clear()
        _delete(self.spark, self.root)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, self.paths.pop(id(table)))


def children(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder of any file system; none if it does not exist."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    return {status.getPath().getName() for status in system.listStatus(target)} if system.exists(target) else set()


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files; after the session has ended it stays."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        return
