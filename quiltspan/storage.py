"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master, as in tests, may do without that setting; it then
    gets a temporary folder that goes when the process ends.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        import atexit

        _own_dir.append(tempfile.mkdtemp(prefix="quiltspan-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, with which Spark removes the shuffle files that a write leaves; twice, as the
    last job's plan is held until the next job."""
    for _ in range(2):
        spark.range(1).count()
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, it is computed once
    however often it is used, and lost executors lose nothing of it. ``free``: a large write, whose
    shuffle files go at once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if free:
        drop_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """``cut`` in buckets of ``key``, so that joins by it read the table without sending it; where ``df`` comes from a
    grouping by ``key``, each bucket is one file. Spark keeps buckets in a catalog, so that this is one of its tables,
    with its files in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def rename_files(spark: SparkSession, path: str, ending: str, name: Callable[[int, int], str]) -> None:
    """Name the files of a finished write with ``ending``: ``name(k, n)`` of the k-th of n, in order of their names."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(there) if f.getPath().getName().endswith(ending)), key=lambda p: p.getName())
    for k, file in enumerate(files):
        fs.rename(file, there.suffix(f"/{name(k, len(files))}"))


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has written to the shared folder, once its results are elsewhere."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
