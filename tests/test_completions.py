"""Request ids, admission of completions and the rows made of them."""

import os

import pytest
from pyspark.sql import functions as F

from tracekit.functions import execution as EX
from tracekit.operators import completions as C
from tracekit.operators import gates

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
STEP = "Line 2 adds 17 + 36 = 53 units"


@pytest.mark.parametrize("flawed,label", [
    ("Line 2 adds 17 + 36 = 54 units", "calculation_error"), ("Line 2 adds 17 - 36 = 53 units", "wrong_operation"),
    ("Line 2 adds 17 + 36 = 53 boxes", "unit_error"), ("Line 2 adds 17 + 36 units", "incomplete_step"),
    ("Since only this line counts: " + STEP, "logical_error"), ("Read as a loss: " + STEP, "interpretation_error")])
def test_flawed_text_fits_only_its_own_label(spark, flawed, label):
    types = [t for t, _ in __import__("tracekit.plans.critic_data", fromlist=["x"]).ERROR_INSTRUCTIONS]
    df = spark.createDataFrame([(t, STEP, flawed) for t in types], "t string, correct string, flawed string")
    ok = {r.t for r in df.where(C.fits(F.col("t"), F.col("correct"), F.col("flawed"))).collect()}
    added = {"logical_error", "interpretation_error"}  # the two are told apart by no rule
    assert ok == (added if label in added else {label})


@pytest.mark.parametrize("text,holds", [("3 + 4 = 7 and 8 ÷ 2 = 4", True), ("3 + 4 = 8", False), ("5 × 2 = 10, 9 - 4 = 6", False),
                                        ("no sums", True), ("1 / 0 = 3", False)])
def test_equations_hold(spark, text, holds):
    assert spark.createDataFrame([(text,)], "t string").select(C.equations_hold(F.col("t"))).first()[0] is holds


def test_triples_name_their_operator(spark):
    got = spark.createDataFrame([("9 - 2 = 7, 3 × 4 = 12",)], "t string").select(EX.calculations("t").alias("c")).first().c
    assert [(x["a"], x["b"], x["c"], x["op"]) for x in got] == [("3", "4", "12", "multiplication"), ("9", "2", "7", "subtraction")]


def test_a_changed_prompt_is_an_open_request(spark):
    def ids(text):
        df = spark.createDataFrame([(1, text)], "problem_id long, plan string")
        return C.with_request(df, "variation", ["problem_id"], F.lit("s"), F.concat(F.lit("Plan: "), "plan"), 300)
    store = ids("1. Add").select("request_id", F.lit("1. Sum up").alias("completion"))
    assert C.attach(ids("1. Add"), store).first().completion == "1. Sum up"
    assert C.attach(ids("1. Add all"), store).first().completion is None


@pytest.mark.parametrize("flawed,outcome", [(None, "no_completion"), ("  ", "unchanged"), ("We add 1 + 2 = 4", "accepted"),
                                            ("we add  1 + 2 = 3", "unchanged"), ("Adding 1 + 2 gives 3", "same_result")])
def test_error_rules(spark, flawed, outcome):
    correct = "We add 1 + 2 = 3" if flawed != "  " else " "
    df = spark.createDataFrame([(correct, flawed)], "correct string, flawed string")
    rule = gates.first_failure(C.error_rules("correct", "flawed"))
    assert df.select(F.coalesce(rule, F.lit("accepted"))).first()[0] == outcome


def test_error_rules_want_a_base_that_holds(spark):
    df = spark.createDataFrame([("1 + 2 = 4", "1 + 2 = 5")], "correct string, flawed string")
    assert df.select(gates.first_failure(C.error_rules("correct", "flawed"))).first()[0] == "base_wrong"


@needs_data
def test_augmented_rows(spark):
    from tracekit.plans import augmentation as A
    err = A.error_examples(spark, SF)
    assert err.count() > 0
    assert err.where(C.same_text("execution", "correct_execution")).isEmpty()
    assert err.where(~C.equations_hold("correct_execution")).isEmpty() and err.where(C.equations_hold("execution")).isEmpty()
    new = A.augment_errors(spark, SF).where("draw > 0")
    assert new.count() > 0
    assert new.where(~C.fits(F.col("error_type"), F.col("correct_execution"), F.col("flawed_execution"))).isEmpty()
    assert new.where(~F.contains("feedback", F.regexp_replace("error_type", "_", " "))).isEmpty()
    outcomes = {(r.kind, r.outcome): r.n for r in A.completion_admission(spark, SF).collect()}
    for kind, rules in (("variation", {"no_completion", "unchanged", "too_few_steps"}),
                        ("execution_error", {"no_completion", "unchanged", "same_result", "base_wrong"}),
                        ("error_injection", {"no_completion", "unchanged", "label_mismatch", "no_feedback", "feedback_mismatch"})):
        assert {o for k, o in outcomes if k == kind} == rules | {"accepted"}
    mix = A.executor_mix(spark, SF).where("is_error")
    assert mix.count() == err.count() == outcomes["execution_error", "accepted"]
