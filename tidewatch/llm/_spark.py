"""Spark plumbing shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import _text


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a folder of this machine in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


FEW_FILES = 32


def few(df: DataFrame) -> DataFrame:
    """``df`` of narrow rows in at most ``FEW_FILES`` partitions, or four a core where that is more.

    A partition is a file of a table, and on a local file system without Hadoop's native library an executor forks
    for each file's mode: until the child is another program, all memory of the executor counts twice.
    """
    return df.coalesce(max(FEW_FILES, 4 * df.sparkSession.sparkContext.defaultParallelism))


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """What ends inside deletes its shuffle files; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder (a folder for each value of ``by``) and read it again: cuts lineage, survives lost executors.

    Its shuffle files go when it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    with no_shuffles_left(spark):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`table` that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, made longer until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> None:
    """Let Arrow carry at most ``BATCH_ROWS`` rows at once, where the session has Spark's own 10,000: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task has freed back to the system: Python workers live on after it, beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, releasing memory at the end of its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def annotate(docs: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], dict]], fields: StructType, keep: list[str] | None = None, text: str = "text", limit: int = _text.SLICE_BYTES) -> tuple[DataFrame, str]:
    """Add a struct column of ``fields`` computed from the text column, without a shuffle.

    ``kernel()`` runs once per task and returns the function that turns a slice
    of whole rows (at most ``limit`` text bytes, or one row) into a dict of Arrow
    arrays by field name.  Columns outside ``keep`` (default: all) are dropped.
    Returns the frame and the struct's name, which clashes with no column.
    """
    small_batches(docs)
    kept = list(docs.columns) if keep is None else keep
    name, hidden = free_name(docs, "_found"), free_name(docs, "_text")
    wide = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(hidden))
    schema = StructType([*[wide.schema[c] for c in kept], StructField(name, fields)])
    arrow_struct = to_arrow_schema(StructType([StructField(name, fields)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in _text.slices(batch, hidden, limit):
                got = work(part.select([hidden]).rename_columns(["text"]))
                struct = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], (pa.Array, pa.ChunkedArray)) else got[f.name].cast(f.type) for f in arrow_struct], fields=list(arrow_struct))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], struct], names=[*kept, name])

    return wide.mapInArrow(tidy(run), schema), name
