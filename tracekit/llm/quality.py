"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed base rules (too few words, mostly repeated words) reject a document
outright. The other thresholds are not fixed: for each (language, source) a KLL
quantile sketch of each ratio is built with partial aggregation, and a document
is rejected when a ratio lies several quartile ranges beyond its own group's quartiles. Groups with
few documents use the merged sketch of their language, and that in turn the
merged sketch of the corpus, so no document is left without a threshold.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.llm.common import row_count_at_most, ship, slices, tidy, written

# Word rule and symbol set.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: ratio -> (side, quartile ranges beyond the quartile that are allowed, least range): the least range only
#: counts in groups whose quartiles are closer than it (as in a group of copies)
RATIOS = {
    "symbols": ("high", 2.0, 0.2),
    "dup_lines": ("high", 4.0, 0.2),
    "repeats": ("high", 4.0, 0.2),
    "word_length": ("both", 4.0, 0.1),
}
SKETCH_K = 400
MIN_GROUP = 100
BROADCAST_GROUPS = 50_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_words = re.compile(WORD).findall
_has_word = re.compile(WORD).search


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Counts of one whole text (null: empty), in the order of MEASURES."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _words(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _has_word(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 3:
        starts: dict[tuple, int] = {}
        covered: set[int] = set()
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            for i, w in enumerate(windows):
                first = starts.setdefault(w, i)
                if first != i:
                    covered.update((first, first + 1, first + 2, i, i + 1, i + 2))
            repeat = len(covered)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat, lines


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_m`` of measures: narrow, all columns kept."""
    ship(docs.sparkSession)
    fields = [f.split() for f in MEASURES.split(", ")]
    kind = pa.struct([(name, pa.int64()) for name, _ in fields])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields,
                           T.StructField("_m", T.StructType([T.StructField(n, T.LongType()) for n, _ in fields]))])

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            rows = [dict(zip((n for n, _ in fields), measure(t))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, "_m"])
        tidy()

    return docs.mapInArrow(run, schema)


def _ratio_columns(m: str = "_m") -> dict[str, Column]:
    """What the sketches hold. Shares are the logarithm of (count + 1) / (whole + 1): most documents have no symbol and no
    repeat, and a share of 0 says more the longer the document is; so the quartiles of a group differ and its own bound decides."""
    share = lambda a, b: F.log((F.col(f"{m}.{a}") + 1) / (F.col(f"{m}.{b}") + 1))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "word_length": F.col(f"{m}.word_chars") / F.greatest(F.col(f"{m}.n_words"), F.lit(1))}


def base_failed(m: str = "_m") -> Column:
    return ((F.col(f"{m}.n_words") < MIN_WORDS)
            | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MAX_REPEAT_PERCENT))


def fit_thresholds(spark: SparkSession, measured: DataFrame) -> DataFrame:
    """Low and high bound of every ratio for each (lang, source), null values being a group of their own.

    ``measured`` has ``_lang``, ``_source`` and ``_m``. Documents that fail a base rule
    are left out of the sketches. Sketches are partial aggregates: one per task and
    group is shuffled, whatever the group's size.
    """
    ratios = _ratio_columns()
    good = measured.where(~base_failed()).select("_lang", "_source", *[c.alias(n) for n, c in ratios.items()])
    sketch = written(spark, good.groupBy("_lang", "_source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in ratios]), "sketches")

    def bounds(df: DataFrame, tag: str) -> DataFrame:
        out = []
        for name, (side, times, least) in RATIOS.items():
            q = lambda r: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(name, F.lit(r)))
            low, high = q(0.25), q(0.75)
            spread = times * F.greatest(high - low, F.lit(least))
            out.append((high + spread).alias(f"{name}_high"))
            if side == "both":
                out.append((low - spread).alias(f"{name}_low"))
        return df.select(*[c for c in ("_lang", "_source", "n") if c in df.columns],
                         F.struct(*out).alias(f"_{tag}"))

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"),
                                     *[F.kll_merge_agg_double(n, SKETCH_K).alias(n) for n in ratios])

    own = bounds(sketch, "own").alias("g")
    lang = bounds(merged(sketch, "_lang"), "by_lang").withColumnsRenamed({"_lang": "l_lang", "n": "l_n"})
    every = bounds(merged(sketch), "all").select("_all")
    enough = lambda n, c: F.when(F.col(n) >= MIN_GROUP, F.col(c))
    joined = own.join(lang, F.col("_lang").eqNullSafe(F.col("l_lang")), "left")
    total = every.select("_all").scalar()
    table = joined.select("_lang", "_source",
                          F.coalesce(enough("n", "_own"), enough("l_n", "_by_lang"), total).alias("_t"))
    return written(spark, table, "thresholds")


def _verdict() -> Column:
    """True when every ratio is inside its group's bounds (no bounds known: true)."""
    ratios = _ratio_columns()
    bad = []
    for name, (side, *_) in RATIOS.items():
        bad.append(F.coalesce(ratios[name] > F.col(f"_t.{name}_high"), F.lit(False)))
        if side == "both":
            bad.append(F.coalesce(ratios[name] < F.col(f"_t.{name}_low"), F.lit(False)))
    return ~reduce(lambda a, b: a | b, bad)


def _with_verdict(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    t = thresholds.withColumnsRenamed({"_lang": "t_lang", "_source": "t_source"})
    if row_count_at_most(thresholds, BROADCAST_GROUPS):
        t = F.broadcast(t)  # checked: at most BROADCAST_GROUPS narrow rows; beyond it a shuffled, skew-split join
    on = F.col("_lang").eqNullSafe(F.col("t_lang")) & F.col("_source").eqNullSafe(F.col("t_source"))
    return measured.join(t, on, "left").withColumn("_failed", base_failed()) \
        .withColumn("_kept", ~F.col("_failed") & _verdict())


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, the measures, ``base_failed`` and ``kept``.

    Null text is an empty text (no words, so it fails the base rule). A null
    language or source is a group of its own. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"),
                         F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("text"))
    measured = written(spark, with_measures(narrow).drop("text"), "measures")
    out = _with_verdict(measured, fit_thresholds(spark, measured))
    return out.select("doc_id", *[F.col(f"_m.{f.split()[0]}").alias(f.split()[0]) for f in MEASURES.split(", ")],
                      F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.

    Two narrow passes over the texts (sketches, then the joined filter): no text is shuffled.
    """
    measured = with_measures(docs.withColumns({"_lang": F.col(lang_col).cast("string"),
                                               "_source": F.col(source_col).cast("string")}), text_col)
    thresholds = fit_thresholds(spark, measured.select("_lang", "_source", "_m"))
    return _with_verdict(measured, thresholds).where("_kept").select(*docs.columns)
