"""Exactly N valid rows from ordered batches (B8, K1): a running quota that clips what later batches may add.

A batch may generate ``min(size, N - valid rows so far)`` rows, so near the end it is cut short, and invalid rows in
its shorter part are made up for by the next batch. While at least a whole batch is missing, a batch adds all its
valid rows and a distributed prefix sum gives what comes before it. From the first batch that may be clipped, at most
``size - 1`` rows are missing, and every batch that adds any lowers that; so at most ``size - 1`` batches add
rows, and each is among the first ``size - 1`` batches with its own first valid place. Those few, found by a rank per place, are
followed one after the other; no window holds more than one batch or one rank per place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.operators.positional import prefix_sums
from tracekit.session import scratch_path


@dataclass(frozen=True)
class Clip:
    """Where clipping begins (None: nowhere), what is missing there, and (batch, missing before it, rows added) from there on."""
    begin: int | None
    missing: int
    taken: tuple[tuple[int, int, int], ...]

    def missing_before(self, batch: Column) -> Column:
        out = F.lit(self.missing)
        for b, _, n in self.taken:
            out = out - F.when(batch > b, n).otherwise(0)
        return out

    @property
    def end(self) -> int | None:
        """The batch that fills the quota (None: it is not filled by clipped batches)."""
        return self.taken[-1][0] if self.taken and self.taken[-1][1] == self.taken[-1][2] else None


def follow(candidates: list[tuple[int, list[int]]], missing: int) -> tuple[tuple[int, int, int], ...]:
    """Batches in order with the places of their valid rows: those that add rows until none is missing."""
    taken = []
    for batch, places in sorted(candidates):
        if missing == 0:
            break
        n = sum(p <= missing for p in places)
        if n:
            taken.append((batch, missing, n))
            missing -= n
    return tuple(taken)


def clipped_quota(df: DataFrame, order: Sequence[str], valid: Column | Callable[[DataFrame], Column], target: int, size: int,
                  batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """The first ``target`` valid rows under the quota, and a row per processed batch.

    ``df`` holds the generated rows with their ``batch`` (ascending, at most ``size`` rows each) in the unique ``order``
    inside it. Rows keep their columns and get ``place`` (in the batch); order them by batch and place. The batch rows are
    ``batch, generated, valid, total``. ``valid`` is the rule, or a user's function from the rows to it (K1). A null verdict is not valid. An empty table gives no rows.
    """
    spark = df.sparkSession
    valid = valid(df) if callable(valid) else valid
    path = scratch_path(spark, "quota")
    tagged = df.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(*order))) \
        .withColumn("_ok", F.coalesce(valid, F.lit(False)))
    tagged.write.parquet(path)
    rows = spark.read.schema(tagged.schema).parquet(path)
    per = rows.groupBy(F.col(batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("size"), F.count_if("_ok").alias("v"),
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.col("place")))).alias("places"))
    per = prefix_sums(per, ["batch"], ["v"], suffix="_to")
    before = F.col("v_to") - F.col("v")
    may_clip = before > target - size
    first = per.where(may_clip).agg(F.min_by(F.struct("batch", (F.lit(target) - before).alias("missing")), "batch").alias("x")).first().x
    if first is None or first.missing <= 0:
        clip = Clip(None if first is None else first.batch, 0, ())
    else:
        rank = F.row_number().over(Window.partitionBy(F.get("places", F.lit(0))).orderBy("batch"))
        near = per.where(may_clip & (F.col("v") > 0) & (F.get("places", F.lit(0)) <= first.missing)) \
            .withColumn("_rank", rank).where(F.col("_rank") <= first.missing)
        found = near.select("batch", "places").collect()  # fewer than size * size rows
        clip = Clip(first.batch, first.missing, follow([(r.batch, r.places) for r in found], first.missing))
    b = F.col("batch")
    left = F.coalesce(*[F.when(b == x, m) for x, m, _ in clip.taken], F.lit(0))
    added = F.coalesce(*[F.when(b == x, n) for x, _, n in clip.taken], F.lit(0))
    whole = F.lit(True) if clip.begin is None else b < clip.begin
    kept = rows.withColumnRenamed(batch, "batch").where(F.col("_ok") & (whole | (F.col("place") <= left))).drop("_ok") \
        .withColumnRenamed("batch", batch)
    missing = clip.missing_before(b)
    seen = whole | (missing > 0)
    batches = per.where(seen).select(
        "batch", F.when(whole, F.col("size")).otherwise(F.least("size", missing)).cast("bigint").alias("generated"),
        F.when(whole, F.col("v")).otherwise(added).cast("bigint").alias("valid"),
        F.when(whole, F.col("v_to")).otherwise(F.lit(target) - missing + added).cast("bigint").alias("total"))
    return kept, batches
