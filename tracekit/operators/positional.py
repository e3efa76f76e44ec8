"""Positional operators: ordinals, prefix sums, batches, quotas, slices, splits.

The reference works on Python lists, so position is list order. Here every
position derives from an explicit total order key and is computed without a
single-partition window over the data:

1. **Written ranges.** The rows are range-partitioned by the key with Spark's own sampled
   ranges, sorted inside each partition and written once to the shared scratch folder, with
   the partition number and the rank inside the partition as columns. A task that is run
   again after an executor is lost reads these numbers; it never deals them anew.
2. **Per-partition totals** are a partial aggregate of the written table (one row per
   partition); their running offsets are broadcast back, and their size is bounded by
   the partition count, not by the data.
3. **Position** is offset plus rank: no window over the rows. Running sums add one window
   partitioned by the range, so a hot group spreads over many ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.session import scratch_path

_PID, _RANK = "_tk_pid", "_tk_rank"
_IN_PARTITION = 33  # bits of the row number in monotonically_increasing_id()


def _names(order: Sequence) -> list[str]:
    out = []
    for c in order:
        if not isinstance(c, str):
            raise TypeError("order keys must be column names")
        out.append(c)
    return out


def _ranged(df: DataFrame, order: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` written once in key order, with its range (``_PID``) and the 1-based rank in it (``_RANK``)."""
    spark, cols = df.sparkSession, _names(order)
    n = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at = F.col("_tk_at")
    placed = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_tk_at", F.monotonically_increasing_id())
              .withColumn(_PID, F.shiftright(at, _IN_PARTITION).cast("int"))
              .withColumn(_RANK, at.bitwiseAND(F.lit((1 << _IN_PARTITION) - 1)) + 1)
              .drop("_tk_at"))
    path = scratch_path(spark, "ranges")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _offsets(part_totals: DataFrame, value_cols: Sequence[str], total_col: str | None = None) -> DataFrame:
    """Exclusive running totals over the per-range table (one row per range); ``total_col``: the grand total of the first."""
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    out = part_totals
    if total_col:
        out = out.withColumn(total_col, F.sum(value_cols[0]).over(Window.partitionBy(F.lit(1))))
    for c in value_cols:
        out = out.withColumn(f"_off_{c}", F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.select(_PID, *[f"_off_{c}" for c in value_cols], *([total_col] if total_col else []))


def ordinal(df: DataFrame, order: Sequence[str], pos_col: str = "pos", total_col: str | None = None,
            num_partitions: int | None = None) -> DataFrame:
    """1-based global position by a total order (``row_number()`` semantics).

    ``total_col`` names a further column with the number of rows, taken from the same counts.
    """
    rows = _ranged(df, order, num_partitions)
    counts = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"))
    return (rows.join(F.broadcast(_offsets(counts, ["_n"], total_col)), _PID)
            .withColumn(pos_col, (F.col("_off__n") + F.col(_RANK)).cast("bigint"))
            .drop(_PID, _RANK, "_off__n"))


def first_part(df: DataFrame, order: Sequence[str], size: Callable[[Column], Column]) -> DataFrame:
    """The first ``size(n)`` of the n rows, by a total order without ties or nulls.

    Only the key columns are written and numbered. The key of the last row taken (one row) cuts ``df``,
    so wide columns are neither shuffled nor written for it.
    """
    return up_to(df, order, last_key(df, order, size))


def last_key(df: DataFrame, order: Sequence[str], size: Callable[[Column], Column]) -> tuple | None:
    """The key of the last of the first ``size(n)`` rows; None: there is none."""
    cols, spark = _names(order), df.sparkSession
    keys = df.select(*cols)
    path = scratch_path(spark, "keys")
    keys.write.parquet(path)   # the ranges are sampled before they are made: what leads to the keys is done once
    numbered = ordinal(spark.read.schema(keys.schema).parquet(path), cols, "_tk_pos", "_tk_n")
    last = numbered.where(F.col("_tk_pos") == F.least(F.col("_tk_n"), size(F.col("_tk_n")))).select(*cols).first()
    return None if last is None else tuple(last)


def up_to(df: DataFrame, order: Sequence[str], last: tuple | None) -> DataFrame:
    """The rows of ``df`` up to the key ``last``. Its first column also cuts alone, which reaches the scans below joins and windows."""
    cols = _names(order)
    if last is None:
        return df.where(F.lit(False))
    ends = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(cols, last)]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    return df.where((F.col(cols[0]) <= ends[0]) & (key <= F.struct(*[e.alias(f"k{i}") for i, e in enumerate(ends)])))


def share(num: int, den: int) -> Callable[[Column], Column]:
    """``floor(n * num / den)`` for ``first_part``."""
    return lambda n: F.floor(n * F.lit(num) / F.lit(den))


def prefix_sums(df: DataFrame, order: Sequence[str], value_cols: Sequence[str],
                suffix: str = "_cum", pos_col: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in global order (plus optional ordinal)."""
    values = list(value_cols)
    rows = _ranged(df, order, num_partitions)
    totals = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("_tk_n"), *[F.sum(c).alias(c) for c in values])
    offsets = _offsets(totals, ["_tk_n", *values])
    w = Window.partitionBy(_PID).orderBy(_RANK).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), _PID)
    for c in values:
        out = out.withColumn(f"{c}{suffix}", F.sum(F.coalesce(F.col(c), F.lit(0))).over(w) + F.col(f"_off_{c}"))
    if pos_col:
        out = out.withColumn(pos_col, (F.col(_RANK) + F.col("_off__tk_n")).cast("bigint"))
    return out.drop(_PID, _RANK, "_off__tk_n", *[f"_off_{c}" for c in values])


def number_within(df: DataFrame, group: Sequence[str], order: Sequence, value_col: str | None = None,
                  step_col: str = "step", count_col: str = "n_steps", run_col: str = "run",
                  skew_safe: bool = True) -> DataFrame:
    """Per-group 1-based step number, group size and (optional) running sum.

    ``skew_safe=True``: rows are written in ranges of (group, order), so a hot group
    spans many ranges. Inside a range a window partitioned by (range, group)
    gives the rank/sum/size there. A group can only continue
    across a range boundary, so the carries come from each range's first and
    last group: two partial aggregates with one row per range, combined on the
    driver (size bounded by the number of ranges) and broadcast back.
    ``skew_safe=False`` is the plain window form for bounded groups.
    """
    group = list(group)
    order = _names(order)
    if not skew_safe:
        w = Window.partitionBy(*group).orderBy(*order)
        out = (df.withColumn(step_col, F.row_number().over(w).cast("bigint"))
               .withColumn(count_col, F.count(F.lit(1)).over(Window.partitionBy(*group)).cast("bigint")))
        if value_col:
            out = out.withColumn(run_col, F.sum(value_col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return out
    spark = df.sparkSession
    tagged = _ranged(df, group + order)
    gkey = F.struct(*[F.col(g).alias(g) for g in group])
    ends = tagged.groupBy(_PID).agg(F.min(gkey).alias("_first"), F.max(gkey).alias("_last"))
    val = F.coalesce(F.col(value_col), F.lit(0)) if value_col else F.lit(0)
    is_first = gkey.eqNullSafe(F.col("_first"))
    is_last = gkey.eqNullSafe(F.col("_last"))
    edge = (tagged.join(F.broadcast(ends), _PID).groupBy(_PID).agg(
        F.first("_first").alias("_first"), F.first("_last").alias("_last"),
        F.count_if(is_first).alias("fc"), F.sum(F.when(is_first, val).otherwise(0)).alias("fs"),
        F.count_if(is_last).alias("lc"), F.sum(F.when(is_last, val).otherwise(0)).alias("ls")))
    rows = sorted(edge.collect(), key=lambda r: r[_PID])  # one row per bucket

    # carries: (count, sum) of the same group in earlier buckets; totals of groups spanning buckets
    carry: dict[tuple, tuple] = {}
    buckets_of: dict[tuple, list] = {}
    cur_g, cur_c, cur_s = None, 0, 0
    for r in rows:
        first, last = tuple(r["_first"]), tuple(r["_last"])
        cin = (cur_c, cur_s) if first == cur_g else (0, 0)
        if cin[0]:
            carry[(r[_PID], first)] = cin
        buckets_of.setdefault(first, []).append(r[_PID])
        if first == last:
            cur_g, cur_c, cur_s = first, cin[0] + r["fc"], cin[1] + (r["fs"] or 0)
        else:
            buckets_of.setdefault(last, []).append(r[_PID])
            cur_g, cur_c, cur_s = last, r["lc"], r["ls"] or 0
    # total size of every group seen in more than one bucket
    totals: dict[tuple, int] = {}
    cur_g, acc = None, 0
    for r in rows:
        first, last = tuple(r["_first"]), tuple(r["_last"])
        acc = (acc if first == cur_g else 0) + r["fc"]
        if first != last:
            if len(buckets_of.get(first, [])) > 1:
                totals[first] = acc
            cur_g, acc = last, r["lc"]
        else:
            cur_g = first
        if len(buckets_of.get(cur_g, [])) > 1:
            totals[cur_g] = acc
    fix = []
    for g, pids in buckets_of.items():
        if len(pids) > 1:
            for p in set(pids):
                c, sm = carry.get((p, g), (0, 0))
                fix.append((p, *g, int(c), sm, int(totals[g])))
    vtype = "double" if value_col and str(df.schema[value_col].dataType) in ("DoubleType()", "FloatType()") else "bigint"
    gfields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    fixes = spark.createDataFrame(fix, f"{_PID} int, {gfields}, _c_cnt bigint, _c_sum {vtype}, _g_total bigint")

    w = Window.partitionBy(_PID, *group).orderBy(_RANK)
    out = (tagged.withColumn("_in_step", F.row_number().over(w))
           .withColumn("_in_cnt", F.count(F.lit(1)).over(Window.partitionBy(_PID, *group))))
    if value_col:
        out = out.withColumn("_in_run", F.sum(val).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(fixes), [_PID] + group, "left")
    out = (out.withColumn(step_col, (F.col("_in_step") + F.coalesce("_c_cnt", F.lit(0))).cast("bigint"))
           .withColumn(count_col, F.coalesce("_g_total", "_in_cnt").cast("bigint")))
    if value_col:
        out = out.withColumn(run_col, F.col("_in_run") + F.coalesce("_c_sum", F.lit(0)))
    return out.drop(_PID, _RANK, "_in_step", "_in_cnt", "_in_run", "_c_cnt", "_c_sum", "_g_total")


HOT_ROWS = 100_000   # a larger group is numbered in ranges, a smaller one where its rows are dealt to


def number_groups(df: DataFrame, group: Sequence[str], order: Sequence, value_col: str | None = None,
                  step_col: str = "step", count_col: str = "n_steps", run_col: str = "run", hot_rows: int | None = None) -> DataFrame:
    """``number_within`` for many groups: the rows are dealt once by group, and only groups of more than ``hot_rows`` rows
    (at most rows / ``hot_rows`` of them, found by counts) are written in ranges. ``df`` is read twice: give tables."""
    group, limit = list(group), HOT_ROWS if hot_rows is None else hot_rows
    names = dict(value_col=value_col, step_col=step_col, count_col=count_col, run_col=run_col)
    # a hot group is counted in parts before it is dealt
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_tk_n")).where(F.col("_tk_n") > limit).drop("_tk_n").collect()
    out = _numbered_where_dealt(df, group, order, **names)
    if not hot:
        return out
    keys = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*group).schema))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    cold = df.alias("a").join(keys.alias("b"), same, "left_anti")
    wide = df.alias("a").join(keys.alias("b"), same, "left_semi")
    return _numbered_where_dealt(cold, group, order, **names).unionByName(number_within(wide, group, order, **names))


def _numbered_where_dealt(df: DataFrame, group: list[str], order: Sequence, value_col: str | None, step_col: str, count_col: str, run_col: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*_names(order))
    out = df.withColumn(step_col, F.row_number().over(w).cast("bigint"))
    if value_col:
        value = F.coalesce(F.col(value_col), F.lit(0))
        out = out.withColumn(run_col, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the whole group in the same order: no second sort
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn(count_col, F.count(F.lit(1)).over(whole).cast("bigint"))


# ----------------------------------------------------------------------------
# Batches, quotas, slices
# ----------------------------------------------------------------------------

def batches(df_with_pos: DataFrame, size: int, pos_col: str = "pos", batch_col: str = "batch") -> DataFrame:
    """0-based batch index of fixed size over an ordinal."""
    return df_with_pos.withColumn(batch_col, F.floor((F.col(pos_col) - 1) / F.lit(size)).cast("bigint"))


def quota_cut(df: DataFrame, batch_col: str, target: int) -> DataFrame:
    """Keep whole batches while the rows of all *earlier* batches are below target.

    Batch sizes are one aggregate row per batch; their running total uses the
    distributed prefix sum, so the batch table can itself be large.
    """
    sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_tk_bn"))
    cum = prefix_sums(sizes, [batch_col], ["_tk_bn"], suffix="_cum")
    keep = cum.where(F.col("_tk_bn_cum") - F.col("_tk_bn") < F.lit(target)).select(batch_col)
    return df.join(keep, batch_col, "left_semi")


def head_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """H1: first n rows by order (TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*_names(order)).limit(n)


def strided_sample(df_with_pos: DataFrame, n_total: Column, size: int, pos_col: str = "pos") -> DataFrame:
    """H3: every max(1, n // size)-th row from the start, at most ``size`` rows."""
    step = F.greatest(F.lit(1), F.floor(n_total / F.lit(size)))
    idx = F.col(pos_col) - 1
    return df_with_pos.where((idx % step == 0) & (F.floor(idx / step) < F.lit(size)))


def prefix_fraction(df_with_pos: DataFrame, n_total: Column, num: int, den: int, pos_col: str = "pos") -> DataFrame:
    """H4: the first floor(n * num / den) rows (``examples[:len // k]``, ``int(n * rate)``)."""
    return df_with_pos.where(F.col(pos_col) <= F.floor(n_total * F.lit(num) / F.lit(den)))


def row_count(df: DataFrame) -> Column:
    """The row count of ``df`` as a scalar-subquery Column (evaluated once, no join)."""
    return df.agg(F.count(F.lit(1)).cast("bigint")).scalar()
