"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the data directory, by any path that Spark can read.

    ``spread``: for work that costs far more than a shuffle of the rows, a table of fewer scan
    partitions than half the cores (a small file of one row group) is dealt out to all of them.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a temporary folder is made and set; on a cluster
    it is an error, as no other machine would see the folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = made.get() if made.isDefined() else None
    if not path and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage for good."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that ``stored`` has written in this driver.
_written: list[str] = []


def written() -> int:
    """How much ``stored`` has written so far; for ``drop``."""
    return len(_written)


def drop(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes what ``stored`` has written between two calls of ``written``, once nothing reads it any more, and has Spark give up the shuffles behind it."""
    paths = _written[since:until]
    del _written[since:until]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    freed(spark)


def freed(spark: SparkSession) -> None:
    """Files of shuffles that no plan needs any more go when the driver collects its garbage, which by itself may be in hours."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Deletes what ``stored`` has written so far; results that still read it must be written before. Gives their number."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
