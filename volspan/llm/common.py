"""Shared helpers: table access, shared-folder materialisation and Arrow column views."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles inside a task; a single longer text is one step.
STEP_BYTES = 1 << 20
#: Rows of a narrow table (numbers, hashes) that are worth a partition and a file of their own.
PART_ROWS = 1 << 15
#: Spark's setting (4.1) by which the shuffle files of a query go when it ends. Without it they stay until the driver collects its garbage, which may be never.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without a configured one; it gets a fresh folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_MARKED: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _MARKED.add(path)
    return path


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table of about ``rows`` rows, in as many partitions as its size asks for, or as it has, if those are fewer; rows aren't moved."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while; then what the session had."""
    had = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the application's shared folder and read it back: lineage is cut, lost executors cost nothing.

    Once the table is there nothing reads the shuffle files that led to it, and they are dropped: a job in steps holds its tables and the shuffles of one step.

    ``rows``: about how many rows a narrow table has, where that is known. Its files then follow its size, not the session's partitions: a job in rounds would else write hundreds of
    tiny ones each time, and for every file the executor starts processes that set its mode.
    """
    path = f"{work_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if rows is not None:
        df = in_few_parts(df, rows)
    with _setting(df.sparkSession, DROP_SHUFFLES, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of a row) and ``row`` (a number of its own), written once so that the number stays with its row wherever it is read."""
    return materialize(docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))


def partitions_for(df: DataFrame, per_input: int = 1) -> int:
    """A partition count that follows the session's setting (which the cluster sizes to the data)."""
    return per_input * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or data.size == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), off


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches holding about ``limit`` bytes of text each, with their bytes and offsets from 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8_view(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def two_level_rank(df: DataFrame, group: list[str], order: list[str], rank: str, buckets: int | None = None) -> DataFrame:
    """Adds ``rank`` (gapless from 0 in each group) without gathering a group in one task.

    Rows are dealt into hash buckets of their order columns; a row's rank is the count of its group's earlier buckets plus its place in its own bucket.
    """
    from pyspark.sql import Window as W

    n = buckets or partitions_for(df, 4)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_place", place).join(base, [*group, "_bucket"]).withColumn(rank, F.col("_base") + F.col("_place")).drop("_bucket", "_base", "_place")
