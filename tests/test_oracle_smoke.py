"""A sample of registered keys against their DuckDB oracle at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["gate_problems", "problem_steps", "trace_answers", "solve_results", "failure_breakdown", "plan_scores",
        "step_scores", "critique_facts", "confusion", "ordinal", "shuffle_split", "latest_success", "sft_critic",
        "masked_sequence", "module_totals", "sft_executor", "generation_requests", "runtime_prompts",
        "timeout_cut", "quota_cut", "running_progress"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, key):
    import __spark_entry__ as entry
    from oracle_check import compare, duck
    r = compare(spark, duck(SF), key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and set(df.columns) >= {"complete", "correct", "n"}
