"""Teacher completions: content-derived request ids, the join with a completion store, admission rules.

A request's id is a hash of its kind, its keys and the prompt it sends, so a completion can only ever meet the text
it was asked about: when the text changes, the id does, and the request is open again. Admission rules
are gates (``operators.gates``): each rejected row keeps the first rule that it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.functions import execution as EX
from tracekit.functions.common import col, strip
from tracekit.operators.gates import Rule, empty


def request_id(kind: str, keys: list[str], user: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(kind), *[F.col(k).cast("string") for k in keys], user))


def with_request(df: DataFrame, kind: str, keys: list[str], system, user, max_tokens: int) -> DataFrame:
    """``df`` plus one request per row: ``request_id, kind, system, user, max_tokens``."""
    return df.withColumns({"request_id": request_id(kind, keys, user), "kind": F.lit(kind), "system": col(system),
                           "user": user, "max_tokens": F.lit(max_tokens)})


def attach(requests: DataFrame, completions: DataFrame, out: str = "completion", by: tuple[str, ...] = ()) -> DataFrame:
    """Requests with their completion under ``out`` (null: none is stored). ``completions`` has one row per id.

    ``by``: keys of the request (none null) that the store carries, too; where both sides lie by them, nothing is dealt anew.
    """
    keys = [*by, "request_id"]
    return requests.join(completions.select(*keys, F.col("completion").alias(out)).hint("merge"), keys, "left")


def normal(text) -> Column:
    return F.lower(strip(F.regexp_replace(col(text), r"\s+", " ")))


def same_text(a, b) -> Column:
    """Equal but for case and white space."""
    return normal(a) == normal(b)


def equations_hold(text) -> Column:
    """Every printed ``a op b = c`` holds to within the tolerance; true without any."""
    def holds(z):
        a, b, c = (z[k].cast("double") for k in "abc")
        value = (F.when(z["op"] == "multiplication", a * b).when(z["op"] == "addition", a + b)
                 .when(z["op"] == "subtraction", a - b).otherwise(F.try_divide(a, b)))
        return F.coalesce(F.abs(value - c) < EX.TOLERANCE, F.lit(False))
    return F.forall(EX.calculations(text), holds)


# What tells an error of a type, by comparison with the correct text
_DIGITS, _OPERATORS, _LETTERS = r"\d+", r"[+×*÷/−-]", r"[A-Za-z]+"


def fits(error_type: Column, correct: Column, flawed: Column) -> Column:
    """Whether ``flawed`` departs from ``correct`` the way its label says.

    calculation_error: only numbers differ; wrong_operation: only operators; unit_error: only words; incomplete_step:
    shorter, with fewer numbers; logical_error and interpretation_error: the working is kept and a premise added.
    """
    def only(what: str) -> Column:
        return (correct != flawed) & (F.regexp_replace(correct, what, "~") == F.regexp_replace(flawed, what, "~"))
    added = (correct != flawed) & F.contains(flawed, correct)
    fewer = (F.length(flawed) < F.length(correct)) & (F.regexp_count(flawed, F.lit(_DIGITS)) < F.regexp_count(correct, F.lit(_DIGITS)))
    return F.coalesce(F.when(error_type == "calculation_error", only(_DIGITS)).when(error_type == "wrong_operation", only(_OPERATORS))
                      .when(error_type == "unit_error", only(_LETTERS)).when(error_type == "incomplete_step", fewer)
                      .when(error_type.isin("logical_error", "interpretation_error"), added), F.lit(False))


def variation_rules(original: str, variation: str, steps: str) -> list[Rule]:
    """A rephrased plan: another text with at least two steps."""
    return [("no_completion", empty(variation)), ("unchanged", same_text(original, variation)), ("too_few_steps", F.size(steps) < 2)]


def error_rules(correct: str, flawed: str) -> list[Rule]:
    """An error version of an execution: another text with another result, of an execution whose own sums hold."""
    result = lambda c: EX.last_number(c)
    return [("no_completion", empty(flawed)), ("unchanged", same_text(correct, flawed)),
            ("same_result", result(correct).eqNullSafe(result(flawed))), ("base_wrong", ~equations_hold(correct))]


def injection_rules(correct: str, flawed: str, error_type: str, feedback: str, catalog: tuple[str, ...]) -> list[Rule]:
    """A flawed step of a type and feedback on it, which names no other type."""
    says = F.lower(F.col(feedback))
    other = F.lit(False)
    for t in catalog:
        other = other | ((F.col(error_type) != t) & says.contains(t.replace("_", " ")))
    return [("no_completion", empty(flawed)), ("unchanged", same_text(correct, flawed)),
            ("label_mismatch", ~fits(F.col(error_type), F.col(correct), F.col(flawed))),
            ("no_feedback", empty(feedback)), ("feedback_mismatch", other)]
