"""Executor candidates are taken as they lie by problem; plans are parsed without searching where nothing can be found."""

import pytest
from pyspark.sql import functions as F

from tracekit.functions import common
from tracekit.functions import plan_text as PT
from tracekit.plans import base, evaluation, reports
from tracekit.sources import fixtures as fx

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Own order lines: a long problem, small ones, lines that come twice, null keys, null places and null quantities."""
    path = str(tmp_path_factory.mktemp("byproblem"))
    rows = [(35, i, i % 5, 1, float(i % 50)) for i in range(1, 301)]
    rows += [(k, n, k % 7, n, float(k % 40 + n)) for k in range(100) for n in range(1, k % 5 + 2)]
    rows += [(k, 1, k % 7, 1, float(k % 40 + 1)) for k in range(0, 100, 3)]
    rows += [(None, 1, 1, 1, 3.0), (200, None, 1, 1, 4.0), (200, 1, None, None, None), (201, 1, 2, 2, None), (202, 2, 1, 1, 5.0), (202, 1, 1, 1, None)]
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_chat_rows_deal_nothing_anew_and_need_no_log(spark, sf):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key, df in (("chat_rows", reports.chat_rows(spark, sf)), ("context_prefix", evaluation.context_prefix(spark, sf))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Window" in plan and "Exchange" not in plan, key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    written = {n for _, d, n in fx._MATERIALIZED if d == sf}
    assert "parsed_plans" in written and not written & {"steps_fx", "attempts_fx"}


def test_first_executions_by_problem_are_those_of_the_log(spark, sf):
    cols = ("problem_id", "step_number", "n_steps", "prev", "q", "run", "execution")
    got = fx.with_first_execution(fx.steps_by_problem(spark, sf)).select(*cols)
    log = base.first_executions(spark, sf).select(*cols)
    assert got.count() == log.count() > 500
    assert got.exceptAll(log).isEmpty() and log.exceptAll(got).isEmpty()


def test_a_hot_problem_keeps_its_lines_out_of_its_steps(spark, sf):
    """The gathered lines end where they are made to rows; a step carries numbers alone."""
    plan = fx.steps_by_problem(spark, sf)._jdf.queryExecution().executedPlan().toString()
    made = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert "lines#" not in made.split("), [", 1)[1], made


def test_strip_value_is_strip(spark):
    ends = ["", " ", "\t", "\n", "\x0b", "\f", "\r", "\r\n", "\u0085", " ", " ", " ", "　", "  ", "   ", "\n\u0085", "x", "é "]
    texts = spark.createDataFrame([(None,), *[(a + m + b,) for a in ends for m in ("", "a", "a \n b", " ") for b in ends]], "t string")
    assert texts.where(~common.strip("t").eqNullSafe(common.strip_value("t"))).isEmpty()


@pytest.mark.parametrize("plan,fmt,strict,c5,runtime", [
    ("1. Add the first\n2. Add the other", "dot", [(1, "Add the first"), (2, "Add the other")], None, None),
    ("1) Add (all) of it\n2) x", "paren", [(1, "Add (all) of it")], None, [(1, "Add (all) of it"), (2, "x")]),
    ("sTEP 4: Add what is there", "step", [(4, "Add what is there")], None, None),
    ("Step 5 now. Then) go on", "step", [(5, "now. Then) go on")], None, None),
    ("Plan: all\n - add the lines up\n* 3 x\n-7", "fallback", [], [(1, "add the lines up")], [(1, "add the lines up"), (2, "3 x"), (3, "7")]),
    (" 12 \n\n", "fallback", [], [], [(1, "12")]),
    ("", "fallback", [], [], []), (None, "fallback", [], None, None)])
def test_parsed_plans(spark, plan, fmt, strict, c5, runtime):
    d = spark.createDataFrame([(plan,)], "plan string")
    r = PT.with_parsed_plans(d, "plan", {"strict": "x", "runtime": "y", "c5": "z"}, "f").first()
    steps = lambda v: None if v is None else [tuple(s) for s in v]
    same = strict or None
    assert (r.f, steps(r.x), steps(r.z), steps(r.y)) == (fmt, strict, c5 if c5 is not None else same, runtime if runtime is not None else same)
