"""Shared pieces of the training-data operators: tables, scratch storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality, mixing and language-model operators: runs free of ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    """One folder for the process, on local masters; the session's settings stay as they are."""
    return tempfile.mkdtemp(prefix="dialoom-")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only on a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_folder()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/dialoom-{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Bounds an Arrow batch in rows and bytes while an action runs; the session's own options are back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str, rows: int = 512, size: int = 2 << 20) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back; its workers get batches of `rows` rows and `size` bytes at most.

    Cuts lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with batches(spark, rows, size):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def sliced(arrived: Iterator[pa.RecordBatch], rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """What arrived, in slices of `rows` rows and some `size` bytes: for functions of which the caller starts the action."""
    for batch in arrived:
        step = max(1, min(rows, len(batch) * size // max(batch.nbytes, 1)))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def discard(*written: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    for df in written:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy() -> None:
    """Give the memory that a task has freed back to the system; workers outlive tasks."""
    gc.collect()
    release()


_HELD: dict[str, object] = {}


def worker_cache(key: str, make):
    """What a worker process keeps between tasks: the last operator's cache only.

    Workers outlive stages; without this, each stage would add its cache to
    those of the stages before it.
    """
    if key not in _HELD:
        _HELD.clear()
        tidy()
        _HELD[key] = make()
    return _HELD[key]


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or that with underscores before it until no column has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def extend(df: DataFrame, fields: str, compute) -> DataFrame:
    """`df` with the columns of DDL `fields`, made batch by batch in an Arrow worker.

    `compute()` is called once in each task and returns a function from a
    RecordBatch to one Arrow array for each new column.
    """
    from pyspark.sql import types as T

    more = T.StructType.fromDDL(fields)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", dict)  # other operators' caches go
        work = compute()
        for batch in sliced(arrived):
            made = work(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *more.names])
            del batch, made
        del work
        tidy()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))
