"""Where intermediate tables go, and how Arrow batches reach the vectorised kernels.

A table that several jobs read, or that cuts a long lineage, is written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``. Spark's output committer makes such a write survive lost executors: a task that
runs again replaces its own files only.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaymark.sources.kept import shared_folder

#: Bytes of text that one kernel call works on; numpy temporaries are about 60 times as large.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and a Python worker, where the session names no other bound: texts are long, and both sides hold a batch or two.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def fresh(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/quaymark-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again with its own schema (which an empty table keeps)."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at, out.named = path, None
    return out


def dealt(df: DataFrame, column: str, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder that is dealt to buckets by a column, as many as shuffles have partitions.

    Joins and aggregations on that column leave the table's rows where they are and move the other side only. Spark keeps the
    buckets' description in its catalog, so the table has a name in the current database until it is discarded.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    out = spark.table(name)
    out.written_at, out.named = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads, and lets Spark drop the shuffle files of finished plans.

    Through Hadoop's file system, so the folder may be in any store. What a returned DataFrame reads stays: it is the caller's,
    below ``spark.checkpoint.dir``, as checkpoints are.
    """
    for table in tables:
        if table.named:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.named}")
        remove(table.sparkSession, table.written_at)
    if tables:
        tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans: it does so once the driver has collected those plans."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns inside one struct ``row_``: columns that an operator adds then clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))


def packed_schema(rows: DataFrame, others: str) -> StructType:
    """The schema of packed rows with other columns behind them, for any names and types of the rows' own columns."""
    return StructType([rows.schema["row_"], *StructType.fromDDL(others).fields])


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with bounded batches, and a worker that gives freed memory back to the system after each task."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark._jsparkSession.conf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Returns what numpy and Arrow have freed; an idle worker otherwise keeps the most it ever used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass


def with_fields(batch: pa.RecordBatch, **kinds: pa.DataType) -> pa.RecordBatch:
    """A batch of packed rows with some of the struct's fields beside it, in these Arrow types."""
    row = batch.column("row_")
    return pa.RecordBatch.from_arrays([row, *(row.field(name).cast(kind) for name, kind in kinds.items())], names=["row_", *kinds])


def pieces_of(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text has a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
