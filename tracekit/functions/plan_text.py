"""Plan parsing and plan scores (C5-C12) and two-document TF-IDF coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekit.functions.common import col, count_present, strip, strip_value

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's patterns and word lists)
# ---------------------------------------------------------------------------
# A text is taken line by line up to the first line that ends it, instead of asking at every character whether
# the reference's look-ahead holds; ``*+`` never goes back. The matches are the reference's, given below each.
_UP_TO = r"(.[^\n]*+(?:\n(?!%s)[^\n]*+)*+)"
PLAN_PATTERNS = (
    r"(?isd)(\d+)\.\s*" + _UP_TO % r"\d+\.|[A-Z]",            # (\d+)\.\s*(.+?)(?=\n\d+\.|\n[A-Z]|\z)
    r"(?isd)(\d+)\)\s*" + _UP_TO % r"\d+\)|[A-Z]",            # (\d+)\)\s*(.+?)(?=\n\d+\)|\n[A-Z]|\z)
    r"(?isd)Step\s+(\d+):?\s*" + _UP_TO % r"Step|[A-Z]",      # Step\s+(\d+):?\s*(.+?)(?=\nStep|\n[A-Z]|\z)
)
EVAL_STEP = r"(?msd)^\s*(\d+\.?\s*(?:(?!^\s*\d+\.)(?:[^\n]++\n?+|\n))*+)"     # ^\s*(\d+\.?\s*.*?)(?=^\s*\d+\.|\z)
NUMBERED_LINE = r"(?m)^\s*(\d+)\."
SPECIFIC_TERMS = r"\d+|calculate|solve|find|determine|compute"
GENERIC_TERMS = r"understand|analyze|consider|think|look"
ACTION_VERBS = ("calculate", "find", "determine", "solve", "compute", "identify")
TOKEN = r"(?U)\b\w\w+\b"
ASCII_TOKEN = r"\w\w++"


def _step(num: Column, desc: Column) -> Column:
    return F.struct(num.try_cast("int").alias("step_number"), desc.alias("description"))


def _clean_line(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^\d+[\.\)]\s*", ""), r"^[-\*]\s*", "")


def _fallback_lines(plan: Column) -> Column:
    """Every line of a plan, as it stands and without number or bullet."""
    lines = F.transform(F.split(strip_value(plan), "\n"), lambda x: strip_value(x))
    # most lines begin with neither a digit nor a bullet: they are passed by their first character
    marked = lambda x: F.ascii(x).between(48, 57) | F.ascii(x).isin(42, 45)
    return F.transform(lines, lambda x: F.struct(x.alias("raw"), F.when(marked(x), _clean_line(x)).otherwise(x).alias("clean")))


def _fallback(lines: str, runtime: bool) -> Column:
    if runtime:
        kept = F.filter(lines, lambda x: (x["raw"] != "") & ~x["raw"].startswith("Plan:") & (x["clean"] != ""))
    else:
        kept = F.filter(lines, lambda x: (F.length(x["raw"]) > 10) & (x["clean"] != ""))
    return F.transform(kept, lambda x, i: _step(i + 1, x["clean"]))


def eval_plan_steps(plan) -> Column:
    """Multiline numbered split; else the first 6 pieces of a split on '.'."""
    p = col(plan)
    hits = F.regexp_extract_all(p, F.lit(EVAL_STEP), 1)
    found = F.filter(F.transform(hits, lambda x: strip(x)), lambda x: x != "")
    pieces = F.filter(F.transform(F.split(p, r"\."), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(hits) > 0, found) \
        .otherwise(F.slice(pieces, 1, 6))


def is_sequence(nums: Column) -> Column:
    """Array equals [1, 2, ..., n] (n >= 1); an empty array counts as a sequence."""
    return F.when(F.size(nums) == 0, F.lit(True)).otherwise(
        F.coalesce(F.forall(F.transform(nums, lambda x, i: x == i + 1), lambda b: b), F.lit(False)))


def has_numbering(plan) -> Column:
    """C9a."""
    return col(plan).rlike(NUMBERED_LINE)


def is_sequential(plan) -> Column:
    """Numbers at line starts equal 1..n (false when there are none)."""
    nums = F.transform(F.regexp_extract_all(col(plan), F.lit(NUMBERED_LINE), 1), lambda x: x.try_cast("bigint"))
    return (F.size(nums) > 0) & is_sequence(nums)


def specificity(plan) -> Column:
    """Specific / (specific + generic + 1), on lower-cased text."""
    lp = F.lower(col(plan))
    # most characters begin no term: they are passed by their class
    sp = F.regexp_count(lp, F.lit(f"(?=[0-9csfd])(?:{SPECIFIC_TERMS})")).cast("double")
    gn = F.regexp_count(lp, F.lit(f"(?=[uactl])(?:{GENERIC_TERMS})")).cast("double")
    return sp / (sp + gn + F.lit(1.0))


def clarity(plan, n_steps) -> Column:
    """C11: verbs present / steps, capped at 1; 0 with no steps."""
    n = col(n_steps)
    present = count_present(F.lower(col(plan)), ACTION_VERBS).cast("double")
    return F.when(n > 0, F.least(present / n, F.lit(1.0))).otherwise(F.lit(0.0))


def quality(numbered, sequential, coverage, spec, clar, n_steps) -> Column:
    """0-100 plan score (terms added in the reference's order)."""
    n = col(n_steps).cast("double")
    return (F.when(col(numbered), 10.0).otherwise(0.0) + F.when(col(sequential), 10.0).otherwise(0.0)
            + col(coverage) * 20 + col(spec) * 20 + col(clar) * 20 + F.least(n / 5, F.lit(1.0)) * 20)


# ---------------------------------------------------------------------------
# Two-document TF-IDF cosine (lower-case, tokens of >= 2 word characters,
# raw tf, smooth idf ln((1+N)/(1+df)) + 1 with N = 2, L2 norm). Empty
# vocabulary -> 0.5 (the reference's failure value).
# ---------------------------------------------------------------------------
IDF_SHARED = 1.0                      # ln(3/3) + 1
IDF_SINGLE = math.log(1.5) + 1.0      # ln(3/2) + 1
# all lines of one term: those of the first text (\x01), then those of the second (\x02)
TERM_RUN = r"([^\x01\x02\n]++)(?:\x01\n(?:\1\x01\n)*+|\x02\n)(?:\1\x02\n)*+"


def tokens(text) -> Column:
    """In a text of ASCII alone a word is a run of these characters; only other texts need Unicode's classes and borders."""
    lower = F.lower(col(text))
    return F.when(F.octet_length(lower) == F.length(lower), F.regexp_extract_all(lower, F.lit(ASCII_TOKEN), 0)).otherwise(
        F.regexp_extract_all(lower, F.lit(TOKEN), 0))


# ---------------------------------------------------------------------------
# DataFrame-level staging: each regex runs once per row, then cheap HOFs.
# ---------------------------------------------------------------------------
def _with_matches(df, plan: Column):
    """Add ``_pnum`` (the numbered steps of the first pattern that matches) and ``_pfmt`` (its name); a pattern
    is searched only where the ones before it found nothing and the text holds what every match of it holds."""
    tmp, open_ = [f"_pm{i}" for i in range(3)], F.lit(True)
    needs = (F.contains(plan, F.lit(".")), F.contains(plan, F.lit(")")), F.contains(F.lower(plan), F.lit("step")))
    numbers = texts = fmt = F.when(F.lit(False), None)
    for name, pat, need, form in zip(tmp, PLAN_PATTERNS, needs, ("dot", "paren", "step")):
        df = df.withColumn(name, F.when(open_ & need, F.regexp_extract_all(plan, F.lit(pat), 1)))
        found = F.coalesce(F.size(name) > 0, F.lit(False))
        numbers, fmt = numbers.when(found, F.col(name)), fmt.when(found, F.lit(form))
        texts = texts.when(found, F.regexp_extract_all(plan, F.lit(pat), 2))
        open_ = open_ & ~found
    df = df.withColumn("_pt", texts).withColumn("_pm", F.arrays_zip(numbers.alias("n"), F.col("_pt").alias("t")))
    num = F.transform(F.coalesce("_pm", F.array().cast("array<struct<n:string,t:string>>")),
                      lambda z: _step(z["n"], F.replace(strip_value(z["t"]), F.lit("\n"), F.lit(" "))))
    return df.withColumn("_pnum", num).withColumn("_pfmt", fmt).drop(*tmp, "_pt", "_pm")


def with_parsed_plans(df, plan_col: str, outs: dict[str, str], format_col: str | None = None):
    """Add the parsed steps of every mode in ``outs`` (mode: column) from one search: C5 ``c5``, C6 ``strict``, C7 ``runtime``."""
    p = F.col(plan_col)
    df = _with_matches(df, p).withColumn("_plong", F.filter("_pnum", lambda x: F.length(x["description"]) > 5))
    if set(outs) != {"strict"}:
        df = df.withColumn("_plines", F.when(F.size("_plong") == 0, _fallback_lines(p)))
    for mode, out_col in outs.items():
        num = F.col("_pnum" if mode == "runtime" else "_plong")
        df = df.withColumn(out_col, num if mode == "strict" else F.when(F.size(num) > 0, num).otherwise(_fallback("_plines", runtime=(mode == "runtime"))))
    if format_col:
        df = df.withColumn(format_col, F.when(F.size("_pnum" if set(outs) == {"runtime"} else "_plong") > 0, F.col("_pfmt")).otherwise(F.lit("fallback")))
    return df.drop("_pnum", "_plong", "_pfmt", "_plines")


def with_plan_steps(df, plan_col: str, out_col: str = "steps", mode: str = "c5",
                    format_col: str | None = None):
    """Add parsed steps (C5 ``c5``, C6 ``strict``, C7 ``runtime``) as staged columns."""
    return with_parsed_plans(df, plan_col, {mode: out_col}, format_col)


def with_tfidf_cosine(df, a: str, b: str, out_col: str = "coverage"):
    """D6 as staged columns: the tokens of both texts, each with the sign of its side, sorted together and joined to one
    text, in which a regex finds the run of every term. A run's two counts are its term's frequencies; only runs, not
    tokens, pass through a lambda.
    """
    def signed(c: str, sign: str) -> Column:
        return F.when(F.size(c) == 0, F.array().cast("array<string>")).otherwise(
            F.split(F.concat(F.array_join(c, f"{sign}\n"), F.lit(sign)), "\n"))
    df = df.withColumn("_ta", tokens(a)).withColumn("_tb", tokens(b))
    both = F.concat(signed("_ta", "\x01"), signed("_tb", "\x02"))
    df = df.withColumn("_tt", F.concat(F.array_join(F.sort_array(both), "\n"), F.lit("\n")))
    # in a run of equal terms every line has the same length, so the first places of both signs give the counts
    at = F.transform(F.regexp_extract_all("_tt", F.lit(TERM_RUN), 0), lambda x: F.struct(
        F.instr(x, "\x01").alias("i"), F.instr(x, "\x02").alias("j"), F.length(x).alias("n")))
    count = lambda n, line: (n / line).cast("double")
    df = df.withColumn("_tr", F.transform(at, lambda x: F.when(x["i"] == 0, F.struct(F.lit(0.0).alias("a"), count(x["n"], x["j"] + 1).alias("b")))
                                          .when(x["j"] == 0, F.struct(count(x["n"], x["i"] + 1).alias("a"), F.lit(0.0).alias("b")))
                                          .otherwise(F.struct(count(x["j"] - x["i"], x["i"] + 1).alias("a"),
                                                              count(x["n"] - x["j"] + x["i"], x["i"] + 1).alias("b")))))
    zero = F.lit(0.0)

    def add(acc, x):
        w = F.when((x["a"] > 0) & (x["b"] > 0), IDF_SHARED * IDF_SHARED).otherwise(IDF_SINGLE * IDF_SINGLE)
        return F.struct((acc["dot"] + x["a"] * x["b"] * w).alias("dot"), (acc["aa"] + x["a"] * x["a"] * w).alias("aa"),
                        (acc["bb"] + x["b"] * x["b"] * w).alias("bb"))

    df = df.withColumn("_tw", F.aggregate("_tr", F.struct(zero.alias("dot"), zero.alias("aa"), zero.alias("bb")), add))
    cos = (F.when(F.size("_tr") == 0, F.lit(0.5)).when((F.col("_tw.aa") == 0) | (F.col("_tw.bb") == 0), F.lit(0.0))
           .otherwise(F.col("_tw.dot") / (F.sqrt("_tw.aa") * F.sqrt("_tw.bb"))))
    return df.withColumn(out_col, cos).drop("_ta", "_tb", "_tt", "_tr", "_tw")
