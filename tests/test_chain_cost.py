"""What the chain of attempts, verdicts, results and metrics does per row, on own rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracekit.functions import critique as CR
from tracekit.functions import plan_text as PT
from tracekit.functions.common import strip
from tracekit.operators import loop
from tracekit.operators import positional as P
from tracekit.plans import base, evaluation
from tracekit.sources import fixtures as fx


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Own order lines: 200 problems of 1 to 5 steps, dealt over 4 files."""
    path = str(tmp_path_factory.mktemp("own"))
    lines = spark.range(200).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int"))).alias("l_linenumber"))
    lines.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
                 (F.col("l_orderkey") % 40 + F.col("l_linenumber")).cast("double").alias("l_quantity")).repartition(4).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows,ranged", [(10_000, 0), (500, 1), (0, 1)])
def test_only_hot_groups_are_written_in_ranges(spark, monkeypatch, hot_rows, ranged):
    calls, real = [], P.number_within
    monkeypatch.setattr(P, "number_within", lambda *a, **b: calls.append(1) or real(*a, **b))
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).when(F.col("id") % 50 != 3, F.col("id") % 50).alias("g"), "id",
                                  F.when(F.col("id") % 13 != 0, F.col("id") % 11).alias("v"))
    got = P.number_groups(df, ["g"], ["id"], value_col="v", hot_rows=hot_rows)
    want = real(df, ["g"], ["id"], value_col="v").select(got.columns)
    assert got.count() == 3000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(calls) == ranged


def test_nothing_is_sorted_by_step(spark, sf):
    """The logs lie sorted by step and attempt, and scans say so."""
    assert "Sort [" not in _plan(loop.resolve_attempts(base.verdicts(spark, sf)))
    assert "Sort [" not in _plan(evaluation.eval_steps(spark, sf))


def test_generated_methods_are_compiled(spark, sf):
    """The JVM does not compile a method of more than 8,000 bytes."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = loop.solve_results(base.cut(spark, sf))._jdf.queryExecution().executedPlan()
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def _texts(spark, bits, n=500):
    r = random.Random(5)
    return spark.createDataFrame([(t,) for t in (None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 8))) for _ in range(n)))], "t string")


def test_critiques_are_searched_only_where_a_label_is(spark):
    d = _texts(spark, ["STATUS:", "status: ", "Correct", "INCORRECT", "feedback:", "FEEDBACK: ", "\n", " ", "right", "wrong", "İ", "K", "x y", "logic", "\u0085"])
    d = d.withColumn("l", F.lower("t"))
    st = F.nullif(F.regexp_extract("t", CR.STATUS, 1), F.lit(""))
    fallback = CR.count_present("l", CR.CORRECT_WORDS) > CR.count_present("l", CR.INCORRECT_WORDS)
    ok = F.when(st.isNotNull(), F.upper(st) == "CORRECT").otherwise(fallback)
    fb = strip(F.regexp_extract("t", CR.FEEDBACK, 1))
    types = CR.error_types("t", ok)
    assert d.where(~CR.is_correct("t", "l").eqNullSafe(ok)).isEmpty()
    assert d.where(~CR.feedback_section("t", "l").eqNullSafe(fb)).isEmpty()
    assert d.where(~CR.correction_feedback(ok, fb, lowered="l").eqNullSafe(CR.correction_feedback(ok, fb, types))).isEmpty()
    assert "lambda" not in d.select(types, CR.feedback_actionability("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_ascii_texts(spark):
    d = _texts(spark, ["a", "ab", "_", "1", "12", " ", "-", "\n", ".", "é", "é", "中文", "B"])
    assert d.where(~PT.tokens("t").eqNullSafe(F.regexp_extract_all(F.lower("t"), F.lit(PT.TOKEN), 0))).isEmpty()


def test_contexts_of_evaluated_steps_deal_nothing(spark, sf):
    assert "Exchange" not in _plan(evaluation.eval_contexts(spark, sf))
    first = base.first_executions(spark, sf).select("problem_id", "step_number", "execution").join(base.step_truth(spark, sf).select("problem_id", "step_number"), ["problem_id", "step_number"])
    got = evaluation.eval_contexts(spark, sf).select("problem_id", "step_number", "execution")
    assert got.count() > 300 and got.exceptAll(first).isEmpty() and first.exceptAll(got).isEmpty()


def test_a_log_writes_no_sums(spark, sf):
    fx.critiques_fx(spark, sf)
    for name in ("attempts_fx", "critiques_fx"):
        written = next(t for (_, d, n), t in fx._MATERIALIZED.items() if n == name and d == sf)
        assert not {"prev", "shown"} & set(spark.table(written).columns)
