"""Quality gates (B1-B7): one scan, accepted rows plus a reject ledger.

A gate is an ordered list of ``(rule, failing_condition)`` native Columns. Each
row is tagged with the first rule it fails (the reference returns at the first
failed check); the ledger is one small aggregate over that tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.functions.common import D, contains_any
from tracekit.functions import plan_text, execution

Rule = tuple[str, Column]

# Fixed values (reference word lists)
EXECUTION_MATH_WORDS = ("calculate", "find", "compute")
ACTIONABLE_WORDS = ("should", "need to", "must", "recalculate", "check", "correct",
                    "instead", "rather", "fix", "revise", "change")


def empty(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def first_failure(rules: Sequence[Rule]) -> Column:
    out = None
    for name, failing in rules:
        cond = F.coalesce(failing, F.lit(True))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def apply_gate(df: DataFrame, rules: Sequence[Rule], tag: str = "reject_rule") -> tuple[DataFrame, DataFrame]:
    """Return (accepted rows, ledger(outcome, n)) for an ordered rule list."""
    tagged = df.withColumn(tag, first_failure(rules))
    accepted = tagged.where(F.col(tag).isNull()).drop(tag)
    ledger = (tagged.groupBy(F.coalesce(F.col(tag), F.lit("accepted")).alias("outcome"))
              .agg(F.count(F.lit(1)).alias("n")))
    return accepted, ledger


# B1 ------------------------------------------------------------------------
def problem_rules() -> list[Rule]:
    q, a = F.col("question"), F.col("answer")
    return [
        ("empty", empty(q) | empty(a)),
        ("question_length", (F.length(q) < 20) | (F.length(q) > 500)),
        ("answer_length", (F.length(a) < 20) | (F.length(a) > 1000)),
        ("question_digit", ~q.rlike(r"\d+")),
        ("answer_marker", ~a.contains("####")),
    ]


# B2 ------------------------------------------------------------------------
def plan_rules(steps_col: str = "steps") -> list[Rule]:
    q, p, s = F.col("question"), F.col("plan"), F.col(steps_col)
    return [
        ("question", empty(q) | (F.length(q) < 20)),
        ("plan", empty(p) | (F.length(p) < 50)),
        ("step_count", s.isNull() | (F.size(s) < 2) | (F.size(s) > 8)),
        ("step_detail", ~F.forall(s, lambda x: ~empty(x["description"]) & (F.length(x["description"]) >= 10))),
    ]


# B3 ------------------------------------------------------------------------
def execution_rules() -> list[Rule]:
    q, d, e = F.col("question"), F.col("step_description"), F.col("execution")
    asks = contains_any(F.lower(d), EXECUTION_MATH_WORDS)
    return [
        ("question", empty(q) | (F.length(q) < 20)),
        ("step", empty(d) | (F.length(d) < 10)),
        ("execution", empty(e) | (F.length(e) < 30)),
        ("math_content", asks & ~e.rlike(r"\d+")),
    ]


# B4 ------------------------------------------------------------------------
def critique_example_rules() -> list[Rule]:
    req = ["question", "step_description", "correct_execution", "flawed_execution", "feedback", "error_type"]
    fl, fb = F.col("flawed_execution"), F.col("feedback")
    return [
        ("missing_field", F.lit(False) if not req else F.greatest(*[F.col(c).isNull() for c in req])),
        ("flawed", empty(fl) | (F.length(fl) < 30)),
        ("feedback", empty(fb) | (F.length(fb) < 20)),
        ("actionable", ~contains_any(F.lower(fb), ACTIONABLE_WORDS)),
    ]


# B5 ------------------------------------------------------------------------
def sft_rules(has_instruction: Column, has_question: Column) -> list[Rule]:
    """Instruction rows need string instruction/input/output and output >= 5 chars;
    Q/A rows need string question/answer and answer >= 5 chars."""
    return [
        ("no_format", ~has_instruction & ~has_question),
        ("output", has_instruction & (F.col("output").isNull() | F.col("input").isNull()
                                      | F.col("instruction").isNull() | (F.length("output") < 5))),
        ("answer", ~has_instruction & has_question & (F.col("answer").isNull() | F.col("question").isNull()
                                                      | (F.length("answer") < 5))),
    ]


# B6 ------------------------------------------------------------------------
def plan_issues(steps_col: str = "steps") -> Column:
    """Issue labels of one parsed plan (array of strings); empty plan -> only "No steps generated"."""
    s = F.col(steps_col)
    n = F.size(s)
    brief = F.transform(F.filter(s, lambda x: F.length(x["description"]) < 10),
                        lambda x: F.concat(F.lit("Step "), x["step_number"].cast("string"),
                                           F.lit(" description is too brief")))
    general = F.filter(F.array(
        F.when(n < 2, F.lit("Plan may be too simple (< 2 steps)"))
        .when(n > 8, F.lit("Plan may be too complex (> 8 steps)")),
        F.when(~plan_text.is_sequence(F.transform(s, lambda x: x["step_number"])),
               F.lit("Steps are not sequentially numbered"))), lambda x: x.isNotNull())
    return F.when(n == 0, F.array(F.lit("No steps generated"))).otherwise(F.concat(general, brief))


def plan_is_valid(issues: Column) -> Column:
    """B6 validity: invalid only when an issue mentions 'no steps' or 'empty' (L26)."""
    return ~F.exists(issues, lambda x: F.lower(x).contains("no steps") | F.lower(x).contains("empty"))


# B7 ------------------------------------------------------------------------
EXECUTION_TOTAL_WORDS = ("calculate", "find", "compute", "total")
REASONING_WORDS = ("because", "therefore", "since", "so", "thus", "then")


def execution_confidence(raw: Column, step_description: Column, has_result: Column,
                         n_calcs: Column, n_numbers: Column) -> tuple[Column, Column]:
    """(confidence, is_valid). Adjustments are applied in the reference's order."""
    asks = contains_any(F.lower(step_description), EXECUTION_TOTAL_WORDS)
    no_math = (n_calcs == 0) & (n_numbers == 0)
    adj = F.lit(0.0)
    adj = F.when(~has_result, adj - 0.3).otherwise(adj)
    adj = F.when(asks & no_math, adj - 0.4).when(asks, adj + 0.3).otherwise(adj)
    adj = F.when(F.length(raw) < 50, adj - 0.2).when(F.length(raw) > 20, adj + 0.1).otherwise(adj)
    adj = F.when(contains_any(F.lower(raw), REASONING_WORDS), adj + 0.2).otherwise(adj)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.7) + adj))
    critical = ~has_result | (asks & no_math)
    return conf, ~critical & (conf > 0.3)
