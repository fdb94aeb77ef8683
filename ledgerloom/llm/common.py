"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; in local mode, where none is named, a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


#: Bytes of a batch that Spark hands to Python while a table is written.
BATCH = "8m"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Short rows that may be broadcast, after they were counted.
FEW = 500_000


def if_few(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if its counted rows are few enough."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def tidy(run):
    """A function of batches that gives a task's freed memory back when it ends: Spark keeps the worker for later tasks."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bucket_of(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo parts; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of a record batch with at most about limit bytes in one column."""
    start, size = 0, 0
    lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
