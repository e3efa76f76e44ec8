"""Refinement-loop analytics over logged attempts.

The reference runs execute -> critique -> retry live on one machine; here the
attempt log is a fact table (problem, step, attempt) and every loop statistic is
a window or aggregate over it. Windows partitioned by (problem, step) hold at
most ``max_attempts`` rows; per-problem running sums use the skew-safe
:func:`number_groups` so one huge problem is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.functions import critique as CR
from tracekit.operators import answers
from tracekit.operators.positional import number_groups

TIMEOUT_S = 300.0
MAX_ATTEMPTS = 3


def critic_verdicts(attempts: DataFrame, critiques: DataFrame) -> DataFrame:
    """Attempts joined with their parsed critic output.

    The outputs are parsed before the join, so only what is read of the parsed columns is sorted and carried through it.
    """
    keys = ["problem_id", "step_number", "attempt"]
    c = critiques.select(*keys, "critique", F.lower("critique").alias("_lc"))
    c = c.withColumn("is_correct", CR.is_correct("critique", "_lc"))
    types = CR.error_types("critique", F.col("is_correct"), "_lc")
    fb = CR.feedback_section("critique", "_lc")
    c = (c.withColumn("error_types", types)
         .withColumn("feedback", fb)
         .withColumn("correction_feedback", CR.correction_feedback(F.col("is_correct"), F.col("feedback"), lowered="_lc"))
         .drop("_lc"))
    return attempts.join(c, keys)


def resolve_attempts(verdicts: DataFrame) -> DataFrame:
    """Per step, attempts up to the first correct one (else all); chosen attempt,
    corrections = chosen - 1, success = verdict of the chosen attempt."""
    w = (Window.partitionBy("problem_id", "step_number").orderBy("attempt")
         .rowsBetween(Window.unboundedPreceding, -1))
    prior_ok = F.coalesce(F.sum(F.col("is_correct").cast("int")).over(w), F.lit(0))
    kept = verdicts.where(F.col("attempt") <= MAX_ATTEMPTS).withColumn("_prior_ok", prior_ok).where(F.col("_prior_ok") == 0)
    return kept.groupBy("problem_id", "step_number").agg(
        F.max("attempt").alias("chosen_attempt"),
        F.count(F.lit(1)).cast("bigint").alias("total_attempts"),
        (F.count(F.lit(1)) - 1).cast("bigint").alias("corrections"),
        F.max_by("is_correct", "attempt").alias("success"),
        F.max_by("execution", "attempt").alias("final_execution"),
        F.sum("duration_s").cast("bigint").alias("step_seconds"))


def timeout_cut(resolved: DataFrame, limit_s: float = TIMEOUT_S) -> DataFrame:
    """A step runs only if the time spent before it is within the limit; later steps drop.

    Adds ``elapsed_before`` and ``kept``; the running sum is the skew-safe per-problem sum over the
    narrow columns, joined back by step. ``resolved`` is read twice: give a written table.
    """
    key = ["problem_id", "step_number"]
    seq = number_groups(resolved.select(*key, "step_seconds"), ["problem_id"], ["step_number"], value_col="step_seconds",
                        step_col="_pos", count_col="n_steps", run_col="_elapsed_incl").drop("_pos", "step_seconds")
    return (resolved.join(seq, key).withColumn("elapsed_before", F.col("_elapsed_incl") - F.col("step_seconds"))
            .withColumn("kept", F.col("elapsed_before") <= F.lit(limit_s))
            .drop("_elapsed_incl"))


def solve_results(cut: DataFrame, limit_s: float = TIMEOUT_S) -> DataFrame:
    """One result per problem from the kept steps (C13 and C15 over their final executions, from merged states)."""
    kept = lambda c: F.when(F.col("kept"), F.col(c)).otherwise(0)
    one = lambda c: F.when(c, 1).otherwise(0)
    agg = answers.trace_state(cut, "problem_id", "step_number", F.when(F.col("kept"), F.col("final_execution")), {
        "n_steps": (F.max, F.col("n_steps")), "steps_run": (F.sum, one(F.col("kept"))), "total_attempts": (F.sum, kept("total_attempts")),
        "corrections": (F.sum, kept("corrections")), "seconds": (F.sum, kept("step_seconds")),
        "successful_corrections": (F.sum, one(F.col("kept") & (F.col("corrections") > 0) & F.col("success")))})
    timed_out = F.col("steps_run") < F.col("n_steps")
    err = F.when(timed_out, F.lit(f"Timeout after {limit_s}s"))
    answer = answers.final_text()
    longs = ("n_steps", "steps_run", "total_attempts", "corrections", "successful_corrections", "seconds")
    return agg.select(
        "problem_id", *[F.col(c).cast("bigint").alias(c) for c in longs], answers.answer().alias("predicted"), answer.alias("final_answer"),
        err.alias("error_message"), (answer.isNotNull() & (answer != "") & err.isNull()).alias("success"))


def context_prefix(steps: DataFrame, text_col: str, label: str = "Step ", sep: str = "\n\n") -> Column:
    """Text of the steps before this one, each ``Step n: text`` + sep (per problem, in order).

    The context of step k is by definition the whole prefix of its problem, so
    it is a per-problem window; plans are bounded (B2 keeps 2-8 steps).
    """
    w = Window.partitionBy("problem_id").orderBy("step_number").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat(F.lit(label), F.col("step_number").cast("string"), F.lit(": "), F.col(text_col), F.lit(sep))
    return F.array_join(F.collect_list(piece).over(w), "")


def recent_context(context: Column, fixed: bool = False) -> Column:
    """The last ``\\n\\n`` part of a multi-part context (parity: the empty tail, L14)."""
    parts = F.split(context, "\n\n")
    if fixed:
        parts = F.filter(parts, lambda x: x != "")
    return F.element_at(parts, -1)


def step_label(step: Column) -> Column:
    """``Step k of the solution``."""
    return F.concat(F.lit("Step "), step.cast("string"), F.lit(" of the solution"))
