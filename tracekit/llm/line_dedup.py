"""Line de-duplication: repeated runs of lines, found with a suffix array over line ids.

The suffix array is built by distributed prefix doubling: rank 0 sorts the
distinct lines; the next level sorts the distinct pairs (rank of a block, rank of
the block after it). Sorting is a range partition and a sort inside partitions, and a
row's number in that order is its rank, so no task ever sees all of it. Suffixes
that share their first ``n`` lines form one longest-common-prefix interval; two
overlapping ranked blocks name it. The first suffix of an interval stays, the
run at the start of every later one is deleted.

A run counts when it has at least ``min_words`` words. The windows looked at are, for each
line, the shortest one that begins or ends there and has enough words; their union is that of all
maximal repeated runs with enough words, and their length bounds the doubling.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracekit.llm.common import forget, id_text, partitions, row_count_at_most, slices, tidy, written

MIN_WORDS = 50
BROADCAST_LINES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(spark: SparkSession, distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows with ``rank``, increasing in the order of ``keys`` (unique, not dense)."""
    s = distinct.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    return written(spark, s.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, _h, no, words, l1, l2``: the lines of every text, named by two 64-bit hashes."""
    d = id_text(docs, id_col, text_col).where("text is not null")
    line = d.select("doc_id", F.xxhash64("text").alias("_h"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    words = F.size(F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return line.select("doc_id", "_h", "no", words.alias("words"), F.xxhash64("line").alias("l1"),
                       F.xxhash64(F.lit(7), F.reverse("line")).alias("l2")).distinct()


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, _h, no, size``: shortest windows with enough words that begin or end at a line.

    ``rows`` holds a row per document: sorted arrays ``nos`` and ``words`` of its repeated lines.
    A window never spans a line that occurs once.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def of(nos: list[int], words: list[int]) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        a = 0
        while a < len(nos):
            b = a
            while b + 1 < len(nos) and nos[b + 1] == nos[b] + 1:
                b += 1
            end, total = a, 0                       # forward: window [k, end)
            for k in range(a, b + 1):
                while end <= b and total < min_words:
                    total += words[end]
                    end += 1
                if total < min_words:
                    break
                out.add((nos[k], end - k))
                total -= words[k]
            begin, total = b, 0                     # backward: window (begin, k]
            for k in range(b, a - 1, -1):
                while begin >= a and total < min_words:
                    total += words[begin]
                    begin -= 1
                if total < min_words:
                    break
                out.add((nos[begin + 1], k - begin))
                total -= words[k]
            a = b + 1
        return out

    def run(batches):
        for batch in batches:
            ids, hs, at, size = [], [], [], []
            for doc_id, h, nos, words in zip(*(c.to_pylist() for c in batch.columns)):
                found = of(nos, words)
                ids += [doc_id] * len(found)
                hs += [h] * len(found)
                at += [x for x, _ in found]
                size += [n for _, n in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hs, pa.int64()),
                                              pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                                             names=["doc_id", "_h", "no", "size"])

    return rows.select("doc_id", "_h", "nos", "words").mapInArrow(run, f"doc_id {id_type}, _h long, no int, size int")


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, _h, gone``: the lines to delete, as sorted disjoint intervals (no, size), for documents that have any.

    ``_h`` is the hash of the text. Order is by id (null last), text hash, line number. Rows that
    repeat both id and text are one document: all lose the same lines.
    """
    lines = written(spark, _lines(docs, id_col, text_col), "lines")
    counts = lines.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l1", "l2")
    rank0 = _ranked(spark, counts, "l1", "l2")
    if row_count_at_most(rank0, BROADCAST_LINES):
        rank0 = F.broadcast(rank0)
    level = written(spark, lines.join(rank0, ["l1", "l2"]).select("doc_id", "_h", "no", "words", "rank"), "level")
    forget(spark, lines)
    by_doc = level.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("no", "words"))).alias("r"))
    windows = written(spark, _windows(by_doc.select("doc_id", "_h", F.col("r.no").alias("nos"), F.col("r.words").alias("words")),
                                      min_words), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0

    position = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h", "no")
    id_on = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))
    gone = None
    block = 1
    while block <= longest:
        # windows of block .. 2 * block - 1 lines: named by the ranks of the blocks at their two ends
        now = windows.where(F.col("size").between(block, 2 * block - 1)).alias("w")
        head = now.join(level.alias("a"), id_on("w", "a") & (F.col("w.no") == F.col("a.no"))) \
            .select("w.*", F.col("a.rank").alias("head"))
        both = head.alias("w").join(level.alias("a"), id_on("w", "a")
                                    & (F.col("a.no") == F.col("w.no") + F.col("w.size") - block)) \
            .select("w.*", F.col("a.rank").alias("tail"))
        both = written(spark, both, "intervals")
        first = both.groupBy("size", "head", "tail").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = both.join(first, ["size", "head", "tail"]).where(position > F.col("first")) \
            .select("doc_id", "_h", "no", "size")
        gone = later if gone is None else gone.unionByName(later)
        if 2 * block <= longest:
            w = Window.partitionBy("doc_id", "_h").orderBy("no")
            pairs = level.select("*", F.lead("rank", block).over(w).alias("next"), F.lead("no", block).over(w).alias("next_no")) \
                .where(F.col("next_no") == F.col("no") + block).select("doc_id", "_h", "no", F.col("rank").alias("a"), F.col("next").alias("b"))
            pairs = written(spark, pairs, "pairs")
            # a pair that occurs once is in no interval of more than one suffix
            twice = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
            level = written(spark, pairs.join(_ranked(spark, twice, "a", "b"), ["a", "b"])
                            .select("doc_id", "_h", "no", "rank"), "level")
        block *= 2
    if gone is None:
        return spark.createDataFrame([], f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, _h long, "
                                         "gone array<struct<no:int,size:int>>")
    return written(spark, _merged(gone), "gone")


def _merged(windows: DataFrame) -> DataFrame:
    """``doc_id, _h, gone``: the union of each document's windows as sorted disjoint intervals.

    One pass over the windows in order of their first line; no line numbers are listed, so a long
    stretch that many windows cover costs a row per window.
    """
    own = Window.partitionBy("doc_id", "_h")
    before = own.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    starts = windows.groupBy("doc_id", "_h", "no").agg(F.max(F.col("no") + F.col("size")).alias("end")) \
        .withColumn("reach", F.max("end").over(before)) \
        .withColumn("new", F.when(F.col("reach") >= F.col("no"), F.lit(0)).otherwise(F.lit(1)))
    islands = starts.withColumn("island", F.sum("new").over(own.orderBy("no").rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("doc_id", "_h", "island").agg(F.min("no").alias("no"), F.max("end").alias("end"))
    span = F.struct("no", (F.col("end") - F.col("no")).alias("size"))
    return islands.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(span)).alias("gone"))


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` plus ``_gone`` (intervals of deleted lines or null) with the lines taken out of the text."""
    gone = gone.select(F.col("doc_id").alias("_g_id"), F.col("_h").alias("_g_h"), F.col("gone").alias("_gone"))
    # shuffled whatever the size: the intervals of a document have no bound
    h = F.xxhash64(F.col(text_col).cast("string"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_g_id")) & (h == F.col("_g_h")), "left") \
        .select(*docs.columns, "_gone")
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in (part for b in batches for part in slices(b)):
            texts = []
            for text, drop in zip(batch.column(at), batch.column(last)):
                text = text.as_py()
                if drop.is_valid:
                    lines, kept, end = text.split("\n"), [], 0
                    for span in drop.as_py():
                        kept += lines[end:span["no"]]
                        end = span["no"] + span["size"]
                    text = "\n".join(kept + lines[end:])
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        tidy()

    return joined.mapInArrow(run, joined.schema)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines; columns unchanged.

    Rows with null text, or without a repeated run, stay as they are. A row
    of which no word is left goes.
    """
    gone = repeated_runs(spark, docs, min_words, id_col, text_col)
    out = _without(docs, gone, id_col, text_col)
    return out.where(F.col("_gone").isNull() | F.col(text_col).rlike(WORD)).drop("_gone")


def report(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, kept_sha256`` (of what is left, UTF-8).

    Null text: no lines, the hash of nothing.
    """
    d = id_text(docs, id_col, text_col)
    gone = repeated_runs(spark, d, min_words)
    d = d.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long"))
    out = _without(d, gone.hint("merge"), "doc_id", "text")  # the same join at every size
    n_removed = F.aggregate("_gone", F.lit(0), lambda n, x: n + x["size"])
    return out.select("doc_id", "n_lines", F.coalesce(n_removed, F.lit(0)).cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
