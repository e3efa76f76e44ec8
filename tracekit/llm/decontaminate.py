"""Benchmark decontamination, in DataFrame operations only.

The normalised windows of the test items become a hash set that is broadcast (when
its checked size allows; else joined by shuffle). Documents are scanned window by
window against it; hits are verified word by word, and hit words, spans or documents
are reported or removed.
"""

from __future__ import annotations

import string
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import fits, id_text, row_count_at_most, written

# What separates words after lower-casing A-Z, and the words of a text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_WINDOWS = 1_000_000      # 8-byte hashes
BROADCAST_DOCUMENTS = 200_000      # keys
BROADCAST_BYTES = 64_000_000       # of the arrays and texts beside them, summed
HIT_BYTES = 24                     # one hit in an array
SALTS = 32                         # of each window hash, where hashes are joined by shuffle


# One hash that stands for "this document", so that the scan also returns each one's word count.
MARK = 0x2545F4914F6CDD1D


def words(text: Column) -> Column:
    """The normalised words. A pure ASCII text is lower-cased whole, which is the same there and cheaper."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, BETWEEN, -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(size: int, word_hashes: Column) -> Column:
    """Hashes of all windows of ``size`` words, by start; none when there are fewer words."""
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(F.size(word_hashes) >= size, F.transform(
        F.sequence(F.lit(0), F.size(word_hashes) - size),
        lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(size)]))).otherwise(none)


def _hashes(words_col: Column) -> Column:
    return F.transform(words_col, lambda w: F.xxhash64(w))


def _scanned(sizes: list[int], w: Column) -> Column:
    """Number of words, and the hashes of all windows: those of the first size by start, then those of the next."""
    return F.struct(F.size(w).alias("n"), _let(_hashes(w), lambda h: F.concat(*[_window_hashes(k, h) for k in sizes])).alias("h"))


def _first_of(sizes: list[int]) -> Column:
    """Place of the first window of ``size`` among the hashes of a document with ``n`` words."""
    out, before = F.lit(0), F.lit(0)
    for k in sizes:
        out = F.when(F.col("size") == k, before).otherwise(out)
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    return out


def item_windows(spark: SparkSession, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Written table ``hash, size, text, items``: the distinct windows of all items.

    An item with fewer than ``window`` words, but not none, is one window. Null texts have none.
    """
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    parts = F.transform(F.sequence(F.lit(0), F.size("w") - size),
                        lambda i: F.array_join(F.slice("w", i + 1, size), " "))
    exploded = w.select("item", size.alias("size"), F.explode(parts).alias("window"))
    hashes = F.xxhash64(*[F.get(_hashes(F.split("window", " ")), F.lit(k)) for k in range(window)])
    # xxhash64 skips nulls, so the hash of a short window equals the hash of its own words alone
    grouped = exploded.groupBy("window", "size").agg(F.collect_set("item").alias("items"))
    return written(spark, grouped.select(hashes.alias("hash"), "size", "window", "items"), "item-windows")


def _spread(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (with a ``salt``) whose ``hash`` is wanted, dealt by hash and salt."""
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return rows.join(wanted.withColumn("salt", F.explode(salts)), ["hash", "salt"])


def find_hits(spark: SparkSession, docs: DataFrame, windows: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(word counts, verified occurrences) of the distinct documents with a text.

    Counts: ``doc_id, _h, n_words``. Occurrences, a row per document that has any: ``doc_id, _h,
    hits, items``. ``_h`` is the hash of the text (with the id it names a document's content;
    repeated rows share it), ``hits`` an array of (first word, number of words), ``items`` the
    sorted item ids.
    """
    d = id_text(docs, id_col, text_col).withColumn("_h", F.xxhash64("text")).where("text is not null")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW of them
    sizes = sizes or [WINDOW]
    wanted = windows.select("hash", "size").distinct()
    small = row_count_at_most(windows, BROADCAST_WINDOWS)
    scanned = d.select("doc_id", "_h", _let(words(F.col("text")), partial(_scanned, sizes)).alias("s"))
    if small:  # the counts come along under a hash that every document has
        mark = F.lit(MARK).cast("long")
        rows = scanned.select("doc_id", "_h", F.col("s.n").alias("n"), F.posexplode(F.concat("s.h", F.array(mark))).alias("at", "hash"))
        every = rows.join(F.broadcast(wanted.unionByName(spark.range(1).select(mark.alias("hash"), F.lit(0).alias("size")))), "hash")
    else:      # every word is shuffled; a hash that very many documents hold is spread over the salts
        rows = scanned.select("doc_id", "_h", F.col("s.n").alias("n"), F.posexplode("s.h").alias("at", "hash")) \
            .select("*", F.pmod(F.xxhash64("doc_id", "_h", "at"), F.lit(SALTS)).alias("salt"))
        counts = d.select("doc_id", "_h", F.size(words(F.col("text"))).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("size"))
        every = _spread(rows, wanted).select("doc_id", "_h", "n", "at", "size").unionByName(counts)
    at = F.col("at") - _first_of(sizes)
    every = every.withColumn("at", at).where((F.col("size") == 0) | ((F.col("at") >= 0) & (F.col("at") <= F.col("n") - F.col("size"))))
    raw = written(spark, every.groupBy("doc_id", "_h").agg(
        F.max("n").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("size") > 0, F.struct("at", "size"))).alias("raw")), "raw-hits")

    # verification: the words themselves, read again for the documents with hits only
    some = raw.where(F.size("raw") > 0).select(F.col("doc_id").alias("r_id"), F.col("_h").alias("r_h"), "raw")
    if fits(some, BROADCAST_DOCUMENTS, BROADCAST_BYTES, F.size("raw") * HIT_BYTES):
        some = F.broadcast(some)
    texts = d.join(some, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("_h") == F.col("r_h")))
    texts = texts.dropDuplicates(["doc_id", "_h"])
    cut = _let(words(F.col("text")), lambda w: F.transform("raw", lambda r: F.struct(
        r["at"].alias("at"), r["size"].alias("size"), F.array_join(F.slice(w, r["at"] + 1, r["size"]), " ").alias("window"))))
    pieces = texts.select("doc_id", "_h", F.explode(cut).alias("c")).select("doc_id", "_h", "c.*")
    known = windows.select("window", "size", "items")
    if fits(known, BROADCAST_WINDOWS, BROADCAST_BYTES, F.octet_length("window"), F.octet_length(F.array_join("items", ",")),
            F.size("items") * 8):
        known = F.broadcast(known)
    sure = pieces.join(known, ["window", "size"])
    hits = sure.groupBy("doc_id", "_h").agg(
        F.collect_set(F.struct("at", "size")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return raw.select("doc_id", "_h", "n_words"), written(spark, hits, "hits")


def _hit_words(hits: Column) -> Column:
    """Distinct word positions covered by the hits."""
    return F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, hit_words, items`` (arrays, empty where clean).

    Null text has no words. Repeated rows each get their row; null ids match themselves only.
    """
    windows = item_windows(spark, items, item_col, item_text_col)
    counts, hits = find_hits(spark, docs, windows, id_col, text_col)
    on = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))
    known = counts.alias("c").join(hits.alias("h"), on("c", "h"), "left").select("c.*", "hits", "items")
    d = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").isNull().alias("no"))
    out = d.alias("d").join(known.alias("k"), on("d", "k") & ~F.col("no"), "left").select("d.doc_id", "n_words", "hits", "items")
    none = F.expr("cast(array() as array<int>)")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce(_hit_words(F.col("hits")), none).alias("hit_words"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, what: str = "documents", id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows (``what="documents"``) or without the hit words (``"spans"``).

    Columns stay as they are. Rows with null text are clean. With ``"spans"``, a hit word goes
    together with what separates it from the word before.
    """
    windows = item_windows(spark, items, item_col, item_text_col)
    _, hits = find_hits(spark, docs, windows, id_col, text_col)
    hits = hits.select(F.col("doc_id").alias("_h_id"), F.col("_h").alias("_h_h"), F.col("hits").alias("_hits"))
    if what == "documents":
        hits = hits.drop("_hits")
        small = row_count_at_most(hits, BROADCAST_DOCUMENTS)
    else:
        small = fits(hits, BROADCAST_DOCUMENTS, BROADCAST_BYTES, F.size("_hits") * HIT_BYTES)
    if small:
        hits = F.broadcast(hits)
    text = F.col(text_col).cast("string")
    on = F.col(id_col).eqNullSafe(F.col("_h_id")) & (F.xxhash64(text) == F.col("_h_h"))
    if what == "documents":
        return docs.join(hits, on, "left_anti")
    rebuilt = _let(F.map_from_arrays(_hit_words(F.col("_hits")), _hit_words(F.col("_hits"))),
                   lambda gone: F.array_join(F.transform(
                       F.arrays_zip(F.split(text, WORD_ANY_CASE, -1).alias("gap"),
                                    F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)).alias("word")),
                       lambda z, i: F.when(F.map_contains_key(gone, i), F.lit(""))
                       .otherwise(F.concat(z["gap"], F.coalesce(z["word"], F.lit(""))))), ""))
    joined = docs.join(hits, on, "left")
    return joined.withColumn(text_col, F.when(F.col("_hits").isNotNull(), rebuilt).otherwise(F.col(text_col))) \
        .select(*docs.columns)
