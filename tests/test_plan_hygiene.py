"""Every registered query plans without cross joins, nested-loop joins or Python UDFs."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# sinks and streams do their work eagerly and return a plain re-read of the files they wrote
EAGER_IO = {"read_records", "write_records", "append_resume", "write_eval_report", "incremental_curation", "live_progress"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_no_cross_joins_or_python_udfs(spark):
    import __spark_entry__ as entry
    flagged = {}
    for key, fn in entry.queries().items():
        if key in EAGER_IO:
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in FORBIDDEN if w in plan]
        if hits:
            flagged[key] = hits
    assert flagged == {}


# key -> the step table that lies by problem and step in its step join; and whether the other side has to be dealt, too
STEP_JOINS = {"join_plan_steps": ("attempts_fx", True), "step_scores": ("step_truth", False), "confusion": ("critiques_fx", False),
              "detection_scores": ("critiques_fx", False), "runtime_prompts": ("critiques_fx", True), "eval_report": ("critiques_fx", False)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_step_joins_use_both_keys(spark):
    """Without broadcasts, the step table is not dealt anew, and the side joined with it lies, or is dealt, by problem and step."""
    import re

    import __spark_entry__ as entry
    by_both = r"hashpartitioning\(problem_id#\d+L, (pos|step_number)#\d+L"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key, (table, dealt) in STEP_JOINS.items():
            plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
            if dealt:
                assert re.search(by_both, plan), key
            else:  # all sides lie by step: below a join by step nothing is dealt
                for at in re.finditer(r"\n( *[:+|\- ]*)SortMergeJoin \[problem_id#\d+L, step_number#\d+L\]", plan):
                    assert "Exchange" not in plan[at.end():at.end() + plan[at.end():].index("FileScan")], key
            scans = re.findall(rf"FileScan parquet \S*tk_{table}_\d+\[.*?\] Batched: \w+, Bucketed: (\w+)", plan)
            assert "true" in scans, (key, scans)
        from tracekit.operators import loop
        from tracekit.plans import base
        plan = loop.resolve_attempts(base.verdicts(spark, SF))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
