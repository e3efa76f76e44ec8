"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's rank
over its source's size is its fractional rank. Sorted by fractional rank, every
stretch of the corpus holds the sources in proportion, so cutting that order into equal
counts gives shards that all match the mixture.

Both sorts are Spark's range sorts over written rows (``operators.positional``), so a source that
holds a third of all rows spreads over many ranges. Only columns of fixed width are
sorted unless the caller carries more along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import read_back, written
from tracekit.operators.positional import number_within, ordinal

SHARDS, SEED = 40, "interleave"
ROW_BYTES = 16               # counted for each row besides its text


def _drawn(digits: int, *parts: Column) -> Column:
    """A seeded number of ``digits`` hexadecimal digits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def interleave(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, source, shard, slot`` and a struct ``row`` of the ``carry`` columns.

    Law: ``rows``, the counts of any two shards differ by one at most; so shards stay empty
    only when there are fewer rows than shards. ``size`` is the text's UTF-8 bytes plus 16, and ``slot`` numbers a shard's rows from 0
    without gaps, in interleaved order. A null text has no bytes (size 16, checksum 0); a null source is a source of its
    own; null ids and repeated rows get a place each; an empty table gives no rows. Which of several wholly
    equal rows gets which place does not show.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    own = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    mix = _drawn(15, F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(" ")), F.md5(text))
    rows = written(spark, docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), source.alias("source"), own.alias("_own"), mix.alias("_mix"),
        F.rand(1).alias("_tie"), *([F.struct(*carry).alias("row")] if carry else [])), "to-shard")
    ranked = number_within(rows, ["_own"], ["_mix", "doc_id", "text_crc32", "_tie"], step_col="_rank", count_col="_n")
    # each source starts at an offset of its own, else all sources of one row would meet in the middle
    offset = (_drawn(8, F.lit(seed), F.col("_own")) + 0.5) / float(1 << 32)
    placed = ordinal(ranked.withColumn("_at", (F.col("_rank") - 1 + offset) / F.col("_n")), ["_at", "_own", "_rank"], "_pos", "_all")
    shard = F.expr(f"(_pos - 1) * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_pos") - 1 - first) \
        .select("doc_id", "size", "text_crc32", "source", "shard", "slot", *(["row"] if carry else []))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Parquet under ``path``, a folder per shard (``shard=0`` and so on) whose files hold its rows in slot order.

    Returns the written rows: the columns of ``docs`` in a struct ``row``, ``slot`` and ``shard``.
    """
    placed = interleave(spark, docs, shards, seed, id_col, text_col, source_col, docs.columns).select("row", "slot", "shard")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return read_back(spark, placed, path)
