"""Tables written in the folder that driver and executors share, so that lost executors cost nothing and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def new_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; what is written there goes with the application. Only a local session may do without a configured folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    mine = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}-stored"
    if mine not in _MARKED:
        folder = spark._jvm.org.apache.hadoop.fs.Path(mine)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _MARKED.add(mine)
    return f"{mine}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
