"""Executor output parsing and step scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekit.functions.common import NUM, SIGNED_NUM, col, py_float_text, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's patterns)
# ---------------------------------------------------------------------------
_N = r"(\d+(?:\.\d+)?)"
CALC_PATTERNS = (
    ("multiplication", _N + r"\s*[×x*]\s*" + _N + r"\s*=\s*" + _N),
    ("addition", _N + r"\s*[+]\s*" + _N + r"\s*=\s*" + _N),
    ("subtraction", _N + r"\s*[-−]\s*" + _N + r"\s*=\s*" + _N),
    ("division", _N + r"\s*[÷/]\s*" + _N + r"\s*=\s*" + _N),
)
RESULT_PATTERNS = (
    r"(?id)Result:?\s*(.+?)(?:\n|$)",
    r"(?id)Answer:?\s*(.+?)(?:\n|$)",
    r"(?id)Therefore,?\s*(.+?)(?:\n|$)",
    r"(?id)Final(?:ly)?:?\s*(.+?)(?:\n|$)",
)
OPERATION_FLAGS = (("multiplication", r"[×x*]"), ("addition", r"[+]"),
                   ("subtraction", r"[-−]"), ("division", r"[÷/]"))
TOLERANCE = 0.01


def calculations(raw) -> Column:
    """All a∘b=c triples, all multiplications first, then +, -, / (with the operator kept)."""
    r = col(raw)
    parts = []
    for op, pat in CALC_PATTERNS:
        a = F.regexp_extract_all(r, F.lit(pat), 1)
        b = F.regexp_extract_all(r, F.lit(pat), 2)
        c = F.regexp_extract_all(r, F.lit(pat), 3)
        parts.append(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), _triple(op)))
    return F.concat(*parts)


def _triple(op: str):
    # a function of one argument: a second one would be bound to the position
    return lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), z["c"].alias("c"), F.lit(op).alias("op"))


def result_line(raw) -> Column:
    """Text after the first matching Result/Answer/Therefore/Final label, to line end."""
    r = col(raw)
    hits = [F.when(r.rlike(p), strip(F.regexp_extract(r, p, 1))) for p in RESULT_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def numbers_used(raw) -> Column:
    return F.regexp_extract_all(col(raw), F.lit(f"({NUM})"), 1)


def operation_flag(raw, name: str) -> Column:
    return col(raw).rlike(dict(OPERATION_FLAGS)[name])


def parse_execution(raw) -> Column:
    """C17 as one struct column."""
    r = col(raw)
    res = result_line(r)
    return F.struct(
        calculations(r).alias("calculations"), res.alias("result"), numbers_used(r).alias("numbers_used"),
        *[operation_flag(r, n).alias(n) for n, _ in OPERATION_FLAGS], (res != "").alias("has_result"))


def last_number(text) -> Column:
    """Last signed number as double (C16's last element)."""
    return F.try_element_at(F.regexp_extract_all(col(text), F.lit(f"({SIGNED_NUM})"), 1), F.lit(-1)).cast("double")


def error_category(actual, expected) -> Column:
    """Format (no number) / none (no expectation or within 0.01) / arithmetic."""
    a, e = col(actual), col(expected)
    return (F.when(a.isNull(), F.lit("format")).when(e.isNull(), F.lit("none"))
            .when(F.abs(a - e) < TOLERANCE, F.lit("none")).otherwise(F.lit("arithmetic")))


def step_correct(actual, truth, is_final) -> Column:
    """Final step within 0.01 of the truth; other steps: any number present."""
    a, t, f = col(actual), col(truth), col(is_final)
    return F.when(f & a.isNotNull(), F.coalesce(F.abs(a - t) < TOLERANCE, F.lit(False))).otherwise(a.isNotNull())


def printed_numbers(text) -> Column:
    """Every signed number of the text as Python prints it as a float, once each."""
    plain = lambda n: F.when(n.rlike(r"^[1-9]\d*$"), F.concat(n, F.lit(".0"))).otherwise(py_float_text(n))
    return F.transform(F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"({SIGNED_NUM})"), 1)), plain)


def printed_floats(text) -> Column:
    """Every printed float that the text holds somewhere, also inside longer numbers (12.50 holds 12.5 and 2.5), once each.

    A printed float has no leading zero, and no trailing zero but that of ``.0``; so it is an end of the digits before a
    point and a begin of those after it.
    """
    points = F.arrays_zip(F.regexp_extract_all(col(text), F.lit(_POINT), 1).alias("l"), F.regexp_extract_all(col(text), F.lit(_POINT), 2).alias("r"))

    def whole(z):
        digits = F.regexp_replace(z["l"], "^-", "")
        ends = F.filter(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda n: F.right(digits, n)), lambda x: (F.length(x) == 1) | ~x.startswith("0"))
        return F.when(z["l"].startswith("-"), F.concat(ends, F.filter(F.array(z["l"]), lambda x: F.array_contains(ends, F.substring(x, 2, 1 << 30))))).otherwise(ends)

    def fraction(z):
        return F.filter(F.transform(F.sequence(F.lit(1), F.length(z["r"])), lambda n: F.left(z["r"], n)), lambda x: (F.length(x) == 1) | ~x.endswith("0"))

    each = F.transform(points, lambda z: F.flatten(F.transform(whole(z), lambda a: F.transform(fraction(z), lambda b: F.concat(a, F.lit("."), b)))))
    return F.array_distinct(F.flatten(each))


_POINT = r"(-?\d+)\.(?=(\d+))"


def context_used(context, execution) -> Column:
    """Some number of the context, printed as Python prints a float, occurs in the execution. Context numbers are below 1e16."""
    return F.coalesce(F.arrays_overlap(printed_floats(execution), printed_numbers(context)), F.lit(False))
