"""Critic output parsing and feedback scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekit.functions.common import col, contains_any, count_present, strip, word_count_expr

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's patterns, word lists and texts)
# ---------------------------------------------------------------------------
STATUS = r"(?i)STATUS:\s*(CORRECT|INCORRECT)"
REASONING = r"(?isd)REASONING:\s*(.+?)(?=FEEDBACK:|$)"
FEEDBACK = r"(?isd)FEEDBACK:\s*(.+?)$"
CORRECT_WORDS = ("correct", "right", "accurate", "valid", "good")
INCORRECT_WORDS = ("wrong", "incorrect", "error", "mistake", "invalid", "bad")
ERROR_PATTERNS = (
    (r"calculation|arithmetic|math", "calculation_error"),
    (r"logic|reasoning|step", "logical_error"),
    (r"misunderstand|misinterpret", "interpretation_error"),
    (r"missing|incomplete|forgot", "incomplete_error"),
)
SURE_WORDS = ("clearly", "obviously", "definitely", "certainly")
HEDGE_WORDS = ("might be", "possibly", "unclear", "hard to tell")
GENERIC_FEEDBACK = (
    ("calculation_error", "Please double-check your calculations and arithmetic operations."),
    ("logical_error", "Please reconsider the logical approach to this step."),
    ("interpretation_error", "Please re-read the problem and ensure you understand what's being asked."),
    ("incomplete_error", "Please complete all parts of this reasoning step."),
)
DEFAULT_FEEDBACK = "Please review and revise this step for accuracy."
FLAG_WORDS = ("incorrect", "wrong", "error", "mistake")
FALLBACK_REASONING = "The approach contains an error that needs to be addressed."


def status_word(raw) -> Column:
    return F.nullif(F.regexp_extract(col(raw), STATUS, 1), F.lit(""))


def is_correct(raw, lowered=None) -> Column:
    """C19 verdict: STATUS word when present, else strictly more correct than incorrect words.

    Pass ``lowered`` (a column holding ``lower(raw)``) to share the lower-casing
    with other rules instead of recomputing it inside the CASE branch.
    """
    r = col(raw)
    lr = col(lowered) if lowered is not None else F.lower(r)
    st = F.when(lr.contains("status:"), F.regexp_extract(r, STATUS, 1)).otherwise("")
    fallback = count_present(lr, CORRECT_WORDS) > count_present(lr, INCORRECT_WORDS)
    return F.when(st != "", F.upper(st) == "CORRECT").otherwise(fallback)


def reasoning_section(raw) -> Column:
    return strip(F.regexp_extract(col(raw), REASONING, 1))


def feedback_section(raw, lowered=None) -> Column:
    """The text after the label; a text whose lower case (``lowered``) has no label is not searched."""
    found = strip(F.regexp_extract(col(raw), FEEDBACK, 1))
    if lowered is None:
        return found
    lr = col(lowered)
    return F.when(lr.contains("feedback:"), found).when(lr.isNotNull(), F.lit(""))


def error_types(raw, correct: Column, lowered=None) -> Column:
    """Error labels (in catalog order) of an incorrect verdict; empty when correct.

    The patterns are alternations of lower-case literals searched in the
    lower-cased text, i.e. substring tests, so they run as ``contains``.
    """
    lr = col(lowered) if lowered is not None else F.lower(col(raw))
    labels = F.array_remove(F.array(*[F.when(contains_any(lr, p.split("|")), F.lit(name)).otherwise("") for p, name in ERROR_PATTERNS]), "")
    return F.when(correct, F.array().cast("array<string>")).otherwise(labels)


def confidence(raw) -> Column:
    """C20: 0.5 +0.2 sure, -0.2 hedge, +0.1 STATUS, +0.1 long; clamped to [0.1, 1]."""
    r = col(raw)
    lr = F.lower(r)
    c = F.lit(0.5)
    c = F.when(contains_any(lr, SURE_WORDS), c + 0.2).otherwise(c)
    c = F.when(contains_any(lr, HEDGE_WORDS), c - 0.2).otherwise(c)
    c = F.when(r.rlike(STATUS), c + 0.1).otherwise(c)
    c = F.when(F.length(r) > 100, c + 0.1).otherwise(c)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))


def correction_feedback(correct: Column, feedback: Column, types: Column | None = None, lowered=None) -> Column:
    """C21: '' when correct; own feedback; else generic text by first matching error type, which is looked for in ``lowered`` where
    the types are not given."""
    generic, words = None, {name: p.split("|") for p, name in ERROR_PATTERNS}
    for name, text in GENERIC_FEEDBACK:
        cond = F.array_contains(types, name) if types is not None else contains_any(lowered, words[name])
        generic = F.when(cond, F.lit(text)) if generic is None else generic.when(cond, F.lit(text))
    generic = generic.otherwise(F.lit(DEFAULT_FEEDBACK))
    return F.when(correct, F.lit("")).when(feedback != "", feedback).otherwise(generic)


def error_flagged(feedback) -> Column:
    """Any of incorrect / wrong / error / mistake (so 'no errors found' counts)."""
    return contains_any(F.lower(col(feedback)), FLAG_WORDS)


def feedback_specificity(feedback) -> Column:
    """Mean of 4 indicators."""
    f = col(feedback)
    lf = F.lower(f)
    ind = [f.rlike(r"\d"), lf.contains("calculation") | lf.contains("compute"),
           lf.contains("incorrect"), lf.contains("should be")]
    return sum(i.cast("double") for i in ind) / 4.0


def feedback_actionability(feedback) -> Column:
    """Mean of 4 indicators."""
    f = col(feedback)
    lf = F.lower(f)
    ind = [lf.contains("correct") | lf.contains("fix"), lf.contains("should"),
           lf.contains("=") | lf.contains("calculate"), word_count_expr(f) > 15]
    return sum(i.cast("double") for i in ind) / 4.0


def feedback_reasoning(feedback) -> Column:
    """Text before the first '.' plus '.'; else a fixed sentence."""
    f = col(feedback)
    return F.when(f.contains("."), F.concat(F.substring_index(f, ".", 1), F.lit("."))) \
        .otherwise(F.lit(FALLBACK_REASONING))
