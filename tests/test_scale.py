"""How tables and plans grow: files by bucket, no long texts in written logs or on exchanges, steps done once."""

import pytest
from pyspark.sql import functions as F

from tracekit.operators import loop
from tracekit.plans import base
from tracekit.sources import fixtures as fx

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Own order lines: 400 problems of 1 to 5 steps, dealt over 6 files."""
    path = str(tmp_path_factory.mktemp("own"))
    lines = spark.range(400).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int"))).alias("l_linenumber"))
    lines.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
                 (F.col("l_orderkey") % 40 + F.col("l_linenumber")).cast("double").alias("l_quantity")).repartition(6).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_written_logs_are_narrow_and_one_file_a_bucket(spark, sf):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in (fx.steps_fx, fx.attempts_fx, fx.critiques_fx, base.resolved, base.cut):
        assert len(table(spark, sf).inputFiles()) <= buckets, table
    for name in ("attempts_fx", "critiques_fx"):
        written = next(t for (_, d, n), t in fx._MATERIALIZED.items() if n == name and d == sf)
        assert "string" not in dict(spark.table(written).dtypes).values(), name


def test_verdicts_stay_by_step_in_any_session(spark, sf):
    """The logs are not dealt anew for their join, also where the session has Spark's default; the critique is parsed below it."""
    was = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "true")
    try:
        plan = loop.resolve_attempts(base.verdicts(spark, sf))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        join = next(x for x in plan.splitlines() if "Project" in x and "is_correct" in x and "execution" in x)
        assert "critique#" not in join
    finally:
        spark.conf.set(ALL_KEYS, was)


def test_report_and_rows_share_one_pass_over_the_metrics(spark, sf, monkeypatch):
    from tracekit.plans import io_jobs
    calls, real = [], io_jobs.problem_metrics
    monkeypatch.setattr(io_jobs, "problem_metrics", lambda *a: calls.append(1) or real(*a))
    first = io_jobs.individual_results(spark, sf).count()
    assert first == io_jobs.write_eval_report(spark, sf).first()["num_problems"] > 0
    assert len(calls) == 1
    plan = io_jobs.eval_report_df(spark.table(next(t for (_, d, n), t in fx._MATERIALIZED.items() if n == "problem_metrics" and d == sf)))
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_attempts_keep_their_texts_by_step(spark, sf):
    """Contexts are reduced, or joined with what lies by problem, before they are dealt to the steps."""
    from tracekit.plans import requests
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = requests.trace_metadata(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        dealt = [plan[i + 1] for i, x in enumerate(plan) if "RepartitionByExpression" in x]
        assert any("context_length" in x for x in dealt), dealt
        made = requests.attempts_made(spark, sf, lambda c: c.join(fx.problems_fx(spark, sf).select("problem_id", "question"), "problem_id"))
        physical = made._jdf.queryExecution().executedPlan().toString().splitlines()
        # no exchange by the problem alone has an attempt's own text below it: the topmost join is by step
        top = next(x for x in physical if "SortMergeJoin" in x)
        assert "step_number" in top
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_step_texts_are_dealt_instead_of_their_states(spark, sf):
    from tracekit.operators import answers
    t = answers.trace_state(base.first_executions(spark, sf), "problem_id", "step_number", F.col("execution"))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("ObjectHashAggregate") < plan.index("Exchange hashpartitioning")
    assert plan.rindex("regexp_extract_all") < plan.index("Exchange hashpartitioning")
