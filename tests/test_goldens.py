"""Hand-listed cases for the exact-semantics ledger (expected values from the stated rules)."""

import pytest
from pyspark.sql import functions as F

from tracekit.functions import critique as CR
from tracekit.functions import execution as EX
from tracekit.functions import plan_text as PT
from tracekit.functions import text as TX
from tracekit.functions.common import py_float_text
from tracekit.operators import loop


def one(spark, value, expr_fn, schema="t string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn(F.col(df.columns[0])).alias("r")).first()["r"]


def parsed(spark, plan, mode="c5"):
    df = PT.with_plan_steps(spark.createDataFrame([(plan,)], "plan string"), "plan", "steps", mode=mode)
    return [(s["step_number"], s["description"]) for s in df.first()["steps"]]


@pytest.mark.parametrize("answer,solution,final", [
    ("x #### $1,234", "x", 1234.0),
    ("a #### b #### 5", "a #### b", 5.0),
    ("no marker", "no marker", None),
])
def test_clean_answer(spark, answer, solution, final):
    assert one(spark, answer, TX.solution_text) == solution
    assert one(spark, answer, TX.final_numeric_answer) == final


def test_reasoning_steps_fold(spark):
    text = "Tom has 3 * 5 = 15 apples. They are red. Then he eats 2. So 15 - 2 = 13 left"
    assert one(spark, text, TX.reasoning_steps) == [
        "Tom has 3 * 5 = 15 apples They are red", "Then he eats 2", "So 15 - 2 = 13 left"]


def test_parse_plan_drops_unnumbered_tail(spark):
    assert parsed(spark, "1. Add the apples\n2. Subtract 3.5 from it\nthen stop") == [(1, "Add the apples"), (2, "Subtract 3.5 from it")]


def test_parse_plan_bullet_fallback(spark):
    plan = "- Count the red apples\n- Add the green apples"
    assert parsed(spark, plan) == [(1, "Count the red apples"), (2, "Add the green apples")]
    assert parsed(spark, plan, "strict") == []


@pytest.mark.parametrize("plan,mode,expected", [
    ("1) Add the apples\n2) Take it", "c5", [(1, "Add the apples"), (2, "Take it")]),
    ("Step 1: Add the apples\nStep 2: Take them all", "c5", [(1, "Add the apples"), (2, "Take them all")]),
    ("2. Add the apples\n1. Take them all", "c5", [(2, "Add the apples"), (1, "Take them all")]),
    ("1. Go\n2. Take them all", "c5", [(2, "Take them all")]),       # five characters or fewer are dropped
    ("1. Go\n2. Take them all", "runtime", [(1, "Go"), (2, "Take them all")]),
    ("Plan:\nGo home\n- eat", "runtime", [(1, "Go home"), (2, "eat")]),
    ("", "c5", []), ("", "runtime", []),
])
def test_plan_modes(spark, plan, mode, expected):
    assert parsed(spark, plan, mode) == expected


def test_plan_order_and_verbs(spark):
    assert one(spark, "1. a\n3. b", PT.has_numbering) is True and one(spark, "1. a\n3. b", PT.is_sequential) is False
    assert one(spark, "1. a\n2. b", PT.is_sequential) is True
    assert one(spark, "Calculate it, then find and solve", lambda c: PT.clarity(c, F.lit(2))) == 1.0
    assert one(spark, "Calculate it", lambda c: PT.clarity(c, F.lit(4))) == 0.25


@pytest.mark.parametrize("shown", ["3 + 4 = 7", "9 - 2 = 7", "3 × 4 = 12", "12 ÷ 4 = 3"])
def test_execution_triples(spark, shown):
    got = one(spark, f"We get {shown} now", EX.parse_execution)
    a, op, b, _, r = shown.split()
    assert len(got["calculations"]) == 1, got
    flags = {"+": "addition", "-": "subtraction", "×": "multiplication", "÷": "division"}
    assert [k for k in flags.values() if got[k]] == [flags[op]]


def test_context_used_needs_a_printed_float(spark):
    df = spark.createDataFrame([("Step 1: 2.5 kg", "take 2.5 of it"), ("Step 1: 7 kg", "take 7 of it"), ("", "take 2.5")],
                               "c string, e string")
    assert [r[0] for r in df.select(EX.context_used("c", "e")).collect()] == [True, False, False]


def test_eval_plan_steps_keeps_number_lines_inside(spark):
    assert one(spark, "1. a\n2. b\n3 apples", PT.eval_plan_steps) == ["1. a", "2. b\n3 apples"]


@pytest.mark.parametrize("text,expected", [("1,234,567", 1234567.0), ("1,2,3", 3.0), ("The answer is 42.", 42.0),
                                           ("#### -7 then 9", -7.0), ("no numbers", None)])
def test_extract_answer(spark, text, expected):
    assert one(spark, text, TX.extract_answer) == expected


def test_ground_truth_keeps_commas(spark):
    assert one(spark, "a #### 1,234", TX.ground_truth) == 1.0


def test_extract_numbers_signs(spark):
    assert one(spark, "a 16-3 b 2.50", TX.extract_numbers) == [16.0, -3.0, 2.5]


@pytest.mark.parametrize("text,expected", [("STATUS: incorrect\nREASONING: x", False),
                                           ("This is incorrect", False), ("STATUS: CORRECT", True)])
def test_critique_verdict(spark, text, expected):
    assert one(spark, text, CR.is_correct) is expected


def test_confidence_and_flags(spark):
    assert one(spark, "", CR.confidence) == 0.5
    assert one(spark, "no errors found", CR.error_flagged) is True
    assert one(spark, "Wrong sum. Redo.", CR.feedback_reasoning) == "Wrong sum."
    assert one(spark, "Redo", CR.feedback_reasoning) == CR.FALLBACK_REASONING


@pytest.mark.parametrize("actual,expected,cat", [(None, 5.0, "format"), (5.0, None, "none"),
                                                 (5.004, 5.0, "none"), (6.0, 5.0, "arithmetic")])
def test_error_category(spark, actual, expected, cat):
    df = spark.createDataFrame([(actual, expected)], "a double, e double")
    assert df.select(EX.error_category("a", "e")).first()[0] == cat


def test_float_text_like_python(spark):
    for s in ["16", "2.50", "-3", "007.10", "+5", "0"]:
        assert one(spark, s, py_float_text) == str(float(s))


def test_recent_context_parity_and_fixed(spark):
    ctx = "Step 1: a\n\nStep 2: b\n\n"
    assert one(spark, ctx, lambda c: loop.recent_context(c)) == ""
    assert one(spark, ctx, lambda c: loop.recent_context(c, fixed=True)) == "Step 2: b"


def test_resolve_attempts_cases(spark):
    rows = [(1, 1, 1, False, "e", 1), (1, 1, 2, False, "e", 1), (1, 1, 3, True, "e", 1),
            (2, 1, 1, False, "e", 1), (2, 1, 2, False, "e", 1), (2, 1, 3, False, "e", 1),
            (3, 1, 1, True, "e", 1), (3, 1, 2, False, "e", 1)]
    df = spark.createDataFrame(rows, "problem_id long, step_number long, attempt long, is_correct boolean, "
                                     "execution string, duration_s long")
    got = {r.problem_id: (r.chosen_attempt, r.corrections, r.success) for r in loop.resolve_attempts(df).collect()}
    assert got == {1: (3, 2, True), 2: (3, 2, False), 3: (1, 0, True)}


@pytest.mark.parametrize("row,outcome", [
    (("i", "x", "long enough", None, None), "accepted"), (("i", "x", "abc", None, None), "output"), (("i", None, "long enough", None, None), "output"),
    ((None, None, None, "q", "long enough"), "accepted"), ((None, None, None, "q", "abc"), "answer"), ((None, None, None, "q", None), "answer"),
    ((None, None, None, None, "answer only"), "no_format")])
def test_sft_gate_rejections(spark, row, outcome):
    from tracekit.operators import gates
    df = spark.createDataFrame([row], "instruction string, input string, output string, question string, answer string")
    rules = gates.sft_rules(F.col("instruction").isNotNull(), F.col("question").isNotNull())
    assert df.select(F.coalesce(gates.first_failure(rules), F.lit("accepted"))).first()[0] == outcome


@pytest.mark.parametrize("execution,step,outcome", [
    ("We add 3 and 4 to get seven units", "Add the two numbers", "accepted"), ("Sum: 7", "Add the two numbers", "execution"),
    ("There is nothing to be counted in this line.", "Calculate the total", "math_content"), ("We add 3 and 4 to get seven units", "Add", "step")])
def test_execution_gate_rejections(spark, execution, step, outcome):
    from tracekit.operators import gates
    df = spark.createDataFrame([("How many units are there in all?", step, execution)], "question string, step_description string, execution string")
    assert df.select(F.coalesce(gates.first_failure(gates.execution_rules()), F.lit("accepted"))).first()[0] == outcome


@pytest.mark.parametrize("text,expected", [
    ("so we have 4 and then 5", "4"), ("The answer: 3\nresult 8 items", "8"), ("a = 5. b = 7, c", "7"), ("we hold 12 people and 3 dogs", "12"),
    ("only 9 and 10", "10"), ("nothing", TX.FALLBACK_ANSWER), ("x = 5\n", "5")])
def test_final_answer_families(spark, text, expected):
    assert one(spark, text, TX.final_answer_text) == expected
