"""C26 by printed floats and the first-occurrence index, against the rule on the whole context."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracekit.functions import execution as EX

PIECES = ["2.5", "12.50", "0.5", "05.0", "-2.5", "7", "7.0", "10.05", "1.2.3", "3.", ".5", "a", "100", "+4", "4.0", "0", "0.0", "-0", "00.10", "x9.90y", "12"]


def used(context, execution):
    nums = re.findall(r"[+-]?\d+(?:\.\d+)?", context)
    return any(str(float(n)) in execution for n in nums)


def test_printed_floats_like_substrings(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(PIECES, k=rng.randint(1, 4))), rng.choice(["", " "]).join(rng.choices(PIECES, k=rng.randint(1, 4)))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "c string, e string")
    got = [(r.c, r.e, r.u) for r in df.select("c", "e", EX.context_used("c", "e").alias("u")).collect()]
    assert [g for g in got if g[2] != used(g[0], g[1])] == []
    assert any(g[2] for g in got) and not all(g[2] for g in got)


def test_step_scores_join_no_text(spark):
    import os

    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["step_scores"](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "question" not in plan
    assert df.where("used_context").count() > 0 and df.where(~F.col("used_context")).count() > 0
