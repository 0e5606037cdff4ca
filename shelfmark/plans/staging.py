"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, rows: int | None = None, rows_a_task: int = 250_000) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, and the rows survive the loss of any executor. rows: about how many there are, if known;
    then no more tasks write them than have rows_a_task each, or than there are cores, whichever is more.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task)))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def tasks_for(spark: SparkSession) -> int:
    """Tasks to deal rows to that are few bytes and much work, so that they aren't put together by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
