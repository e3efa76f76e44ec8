"""Transactional progress of dataset modules.

A batch is written to a folder of its own, then one record (module, batch, rows, total, target) commits it. Only recorded
batches belong to the dataset. A run that dies between the two leaves a folder that no reader sees and that the same batch
replaces when it comes again; a batch that is already recorded is skipped. So rows come once whatever
a restarted stream sends again. The record's running total stops a module at its target, also after a restart.

    root/data/module=planner/batch=7/part-...parquet
    root/ledger/module=planner/batch=7/part-...json
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.streaming.incremental import BYTES_PER_TRIGGER

RECORD = "rows bigint, total bigint, target bigint"
LEDGER = f"{RECORD}, module string, batch bigint"


@dataclass(frozen=True)
class Progress:
    last_batch: int          # -1: none yet
    total: int

    def done(self, target: int | None) -> bool:
        return target is not None and self.total >= target


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """``module, batch, rows, total, target``: one row per committed batch."""
    try:
        return spark.read.schema(LEDGER).json(f"{root}/ledger").select("module", "batch", "rows", "total", "target")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no batch has been committed yet; any other failure is the caller's
            raise
        return spark.createDataFrame([], "module string, batch bigint, rows bigint, total bigint, target bigint")


def progress(spark: SparkSession, root: str, module: str) -> Progress:
    """The last committed batch of a module and its running total."""
    r = ledger(spark, root).where(F.col("module") == module).agg(F.max("batch").alias("b"), F.max_by("total", "batch").alias("t")).first()
    return Progress(-1 if r.b is None else r.b, r.t or 0)


def commit_batch(df: DataFrame, root: str, module: str, batch: int, target: int | None = None,
                 between: Callable[[], None] = lambda: None) -> Progress:
    """Write the rows of one batch and its record; batches of a module come in ascending order.

    Nothing is computed for a batch that is recorded, or once the target is met. A whole batch is kept also where it passes the
    target. ``between`` runs after the rows and before the record (tests raise there).
    """
    spark = df.sparkSession
    now = progress(spark, root, module)
    if batch <= now.last_batch or now.done(target):
        return now
    path = f"{root}/data/module={module}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    between()
    record = spark.createDataFrame([(rows, now.total + rows, target)], RECORD).coalesce(1)
    record.write.mode("overwrite").json(f"{root}/ledger/module={module}/batch={batch}")
    return Progress(batch, now.total + rows)


def dataset(spark: SparkSession, root: str, module: str, schema) -> DataFrame:
    """The rows of the committed batches of a module, with their ``batch``."""
    committed = ledger(spark, root).where(F.col("module") == module).select("batch")
    fields = spark.createDataFrame([], schema).schema.add("batch", "long")
    if committed.isEmpty():
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(fields).option("basePath", f"{root}/data/module={module}").parquet(f"{root}/data/module={module}")
    return rows.join(F.broadcast(committed), "batch", "left_semi")  # one row per committed batch


def append_batches(spark: SparkSession, root: str, module: str, batches: Iterable[Callable[[], DataFrame]], target: int | None = None,
                   between: Callable[[], None] = lambda: None) -> Progress:
    """A4: commit batches in order, from the first that is not recorded, until the target is met.

    A batch is a function that gives its rows; those of finished batches, and all of a finished module, are never called.
    """
    now = progress(spark, root, module)
    for batch, rows in enumerate(batches):
        if now.done(target):
            break
        if batch > now.last_batch:
            now = commit_batch(rows(), root, module, batch, target, between)
    return now


class Paused(Exception):
    """Raised for batches that arrive after a run has ended."""


def run_module(spark: SparkSession, root: str, module: str, src: str, schema, transform: Callable[[DataFrame], DataFrame],
               checkpoint: str, target: int | None = None, bytes_per_trigger: int = BYTES_PER_TRIGGER,
               files_per_trigger: int | None = None, batches: int | None = None, between: Callable[[], None] = lambda: None) -> Progress:
    """The files now in ``src``, curated micro-batch by micro-batch into the module's dataset.

    A finished module is skipped: no stream is started. A restart goes on at the last batch that the checkpoint does not
    hold; the ledger tells whether that one is already recorded. ``batches`` stops the run after so many.
    """
    if progress(spark, root, module).done(target):
        return progress(spark, root, module)
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else \
        stream.option("maxBytesPerTrigger", bytes_per_trigger)
    seen = {"batches": 0, "done": False}

    def write(df: DataFrame, batch: int) -> None:
        if seen["done"]:
            raise Paused  # the stream must not count a batch as done that is not written; it comes again at the next start
        done = commit_batch(transform(df), root, module, batch, target, between).done(target)
        seen["batches"] += 1
        seen["done"] = done or (batches is not None and seen["batches"] >= batches)

    q = stream.parquet(src).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    while q.isActive and not seen["done"]:
        time.sleep(0.1)
    if seen["done"]:
        q.stop()
    else:
        q.awaitTermination()
    return progress(spark, root, module)
