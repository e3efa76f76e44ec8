"""Shared Spark-side building blocks for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.functions import plan_text as PT
from tracekit.functions import text as TX
from tracekit.operators import gates, loop
from tracekit.sources import fixtures as fx


def accepted_problems(spark: SparkSession, sf: str) -> DataFrame:
    """B1-accepted problems with C1 columns (C4 minus the step fold)."""
    acc, _ = gates.apply_gate(fx.problems_fx(spark, sf), gates.problem_rules())
    return acc.select("problem_id", "question", "answer",
                      TX.solution_text("answer").alias("solution"),
                      TX.final_numeric_answer("answer").alias("final_answer"))


def parsed_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Every plan and its question, parsed by C5 (``steps``, ``format``), C6 (``strict``) and C7 (``runtime``): written once per session."""
    def build():
        p = fx.texts_fx(spark, sf).select("problem_id", "question", "plan")
        return PT.with_parsed_plans(p, "plan", {"strict": "strict", "runtime": "runtime", "c5": "steps"}, "format")
    return fx.materialized(spark, sf, "parsed_plans", build, ("problem_id",))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """C14 ground truth per problem; rows without a number are dropped."""
    p = fx.problems_fx(spark, sf)
    return p.select("problem_id", TX.ground_truth("answer").alias("ground_truth")).where(F.col("ground_truth").isNotNull())


def step_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The ground truth at every step of its problem: a narrow table written once per session and bucketed by step,
    so that a join with the step logs needs no exchange however many steps a problem has."""
    def build():
        p = fx.texts_fx(spark, sf).select("problem_id", "n", TX.ground_truth("answer").alias("ground_truth"))
        return p.where(F.col("problem_id").isNotNull() & F.col("ground_truth").isNotNull()).select(
            "problem_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("step_number"), "ground_truth")
    return fx.materialized(spark, sf, "step_truth", build, fx.STEP_KEY)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with their critiques: both logs lie by step, and their join by step and attempt stays there."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    att = fx.attempts_fx(spark, sf)
    return loop.critic_verdicts(att, fx.critiques_fx(spark, sf))


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """W2 rows, written once per session and bucketed by step."""
    return fx.materialized(spark, sf, "resolved", lambda: loop.resolve_attempts(verdicts(spark, sf)), fx.STEP_KEY)


def cut(spark: SparkSession, sf: str) -> DataFrame:
    return fx.materialized(spark, sf, "cut", lambda: loop.timeout_cut(resolved(spark, sf)), fx.STEP_KEY)


def solved(spark: SparkSession, sf: str) -> DataFrame:
    """W3 rows, written once per session and bucketed by problem."""
    return fx.materialized(spark, sf, "solved", lambda: loop.solve_results(cut(spark, sf)), ("problem_id",))


def first_executions(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluator's single execution per step (attempt 1)."""
    return fx.attempts_fx(spark, sf).where(F.col("attempt") == 1).drop("attempt")
