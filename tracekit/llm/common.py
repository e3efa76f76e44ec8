"""Shared helpers of the training-data operators.

All operators read only the columns they are told to (an id column and a text
or payload column), so further input columns, whatever their names, never
clash with an operator's output columns.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.session import scratch_path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application (Spark serves the file)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tracekit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tracekit", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared scratch folder and read it back."""
    ship(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = read_back(spark, df, path)
    out._scratch = path
    return out


def forget(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of plans that are gone.

    Only for tables whose successors are written: a task that is run again never needs them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        if t is not None:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def read_back(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` as written at ``path``; an empty table keeps its columns."""
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads, under fixed names; null text stays null."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only a few rows at a time become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy() -> None:
    """Give memory that a finished task no longer uses back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own free memory
        pass


def map_texts(docs: DataFrame, schema: str, fn: Callable[[list], dict[str, list]],
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fn(list of texts) -> columns`` batch by batch; the id passes through unchanged.

    One narrow stage: no shuffle, one Arrow batch of texts in memory at a time.
    """
    df = id_text(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values())],
                    names=["doc_id", *cols])
        tidy()

    return df.mapInArrow(run, f"doc_id {id_type}, {schema}")


def fits(df: DataFrame, rows: int, size: int, *sizes: Column) -> bool:
    """Whether ``df`` has at most ``rows`` rows and the ``sizes`` of their values (bytes) sum to at most ``size``."""
    if not row_count_at_most(df, rows):
        return False
    return (df.agg(F.sum(sum(sizes[1:], sizes[0]).cast("long"))).first()[0] or 0) <= size


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows (reads no more than ``limit + 1``)."""
    return df.limit(limit + 1).count() <= limit
