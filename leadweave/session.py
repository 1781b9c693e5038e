"""Session helpers: lineage cuts and parallelism."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="leadweave-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write *df* as a table in the shared folder and go on from there.

    Written rows survive the loss of executors, later reads take only the columns they need, and
    the size of the table is known to the joins that follow.
    """
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(*settled: DataFrame) -> None:
    """Delete the tables that :func:`settle` has written for frames that nothing will read again."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fan_out(spark: SparkSession) -> int:
    """Into how many parts a hot group is split: as many as a shuffle has."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
