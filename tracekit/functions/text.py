"""Answer cleaning, sentence-step folds and number extraction.

All are native Column expressions (regex functions and higher-order
functions), so they run inside whole-stage codegen with no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekit.functions.common import (D, SIGNED_NUM, NUM, col, contains_any, extract_or_null,
                                       strip, to_double_strict, word_count_expr)

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's word lists and patterns)
# ---------------------------------------------------------------------------
PROBLEM_STEP_WORDS = ("first", "then", "next", "so", "therefore", "now", "finally")
CRITIC_STEP_WORDS = ("therefore", "so", "thus", "finally", "result")
SENTENCE_SPLIT = r"[.!?]+"
CALCULATION = r"\d+.*[+\-*/×÷=].*\d+"
ANSWER_MARKER = r"####\s*([+-]?\d+(?:\.\d+)?)"
ANSWER_PHRASES = (
    r"(?:the\s+)?answer\s+is\s*:?\s*\$?\s*([+-]?\d+(?:\.\d+)?)",
    r"final\s+answer\s*:?\s*\$?\s*([+-]?\d+(?:\.\d+)?)",
    r"(?:total|result)\s+is\s*:?\s*\$?\s*([+-]?\d+(?:\.\d+)?)",
    r"(?:makes?|earns?|gets?)\s+\$?\s*([+-]?\d+(?:\.\d+)?)",
)
FINAL_ANSWER_FAMILIES = (
    r"(?:final (?:answer|result)|answer|result|therefore|thus|so).*?(\d+(?:\.\d+)?)",
    r"=\s*(\d+(?:\.\d+)?)\s*(?:$|\.|,)",
    r"(\d+(?:\.\d+)?)\s*(?:dollars?|cents?|items?|people?|things?)",
)
FALLBACK_ANSWER = "Solution completed (see steps above)"


# ---------------------------------------------------------------------------
# C1 clean_answer
# ---------------------------------------------------------------------------
def solution_text(answer) -> Column:
    """Text before the *last* ``####``, stripped; the whole answer when there is no marker."""
    a = col(answer)
    return F.when(a.contains("####"), strip(F.regexp_extract(a, r"(?s)^(.*)####", 1))).otherwise(a)


def final_numeric_answer(answer) -> Column:
    """Number after the last ``####`` with ``,`` and ``$`` removed; null when absent/unparsable."""
    a = col(answer)
    tail = strip(F.regexp_replace(strip(F.substring_index(a, "####", -1)), r"[,$]", ""))
    return F.when(a.contains("####"), to_double_strict(tail))


# ---------------------------------------------------------------------------
# C2 / C3 sentence fold
# ---------------------------------------------------------------------------
def sentences(text) -> Column:
    """Stripped, non-empty pieces of ``re.split('[.!?]+', text)``."""
    return F.filter(F.transform(F.split(col(text), SENTENCE_SPLIT), lambda x: strip(x)), lambda x: x != "")


def sentence_steps(text, starters=PROBLEM_STEP_WORDS, min_len: int = 10) -> Column:
    """Fold sentences into steps: a sentence with a calculation or a starter word opens a
    new step, others are appended with a space; keep steps longer than ``min_len``."""
    def opens(sn: Column) -> Column:
        return sn.rlike(D + CALCULATION) | contains_any(F.lower(sn), starters)

    init = F.struct(F.array().cast("array<string>").alias("steps"), F.lit("").alias("cur"))

    def merge(acc, sn):
        new_step = opens(sn) & (acc["cur"] != "")
        return F.when(new_step, F.struct(F.concat(acc["steps"], F.array(acc["cur"])).alias("steps"),
                                         sn.alias("cur"))) \
            .otherwise(F.struct(acc["steps"].alias("steps"),
                                F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(" "), sn))
                                .otherwise(sn).alias("cur")))

    def finish(acc):
        done = F.when(acc["cur"] != "", F.concat(acc["steps"], F.array(acc["cur"]))).otherwise(acc["steps"])
        return F.filter(done, lambda x: F.length(x) > min_len)

    return F.aggregate(sentences(text), init, merge, finish)


def reasoning_steps(solution) -> Column:
    """Steps of a reference solution."""
    return sentence_steps(solution, PROBLEM_STEP_WORDS, 10)


def critic_solution_steps(solution) -> Column:
    """The critic generator's variant (other starters, steps longer than 20)."""
    return sentence_steps(solution, CRITIC_STEP_WORDS, 20)


# ---------------------------------------------------------------------------
# C13 extract_answer, C14 ground_truth, C15 final_answer_text, C16, C27
# ---------------------------------------------------------------------------
def _comma_free(text) -> Column:
    return F.regexp_replace(col(text), r"(\d),(\d)", "$1$2")


def answer_strategy(text) -> Column:
    """Which rule of C13 finds the answer: marker, phrase1..phrase4, last_number or none."""
    t = _comma_free(text)
    lt = F.lower(t)
    out = F.when(t.rlike(ANSWER_MARKER), F.lit("marker"))
    for i, p in enumerate(ANSWER_PHRASES, 1):
        out = out.when(lt.rlike(p), F.lit(f"phrase{i}"))
    return out.when(t.rlike(SIGNED_NUM), F.lit("last_number")).otherwise(F.lit("none"))


def extract_answer(text) -> Column:
    """Number after the first ``####``; else the first answer phrase (on lower case);
    else the last signed number; else null. Commas between digits removed first."""
    t = _comma_free(text)
    lt = F.lower(t)
    cands = [extract_or_null(t, ANSWER_MARKER)] + [extract_or_null(lt, p) for p in ANSWER_PHRASES]
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(f"({SIGNED_NUM})"), 1), F.lit(-1))
    cands.append(last)
    return F.coalesce(*[c.try_cast("double") for c in cands])


def ground_truth(answer) -> Column:
    """C14: first number after the first ``####``; commas are *not* removed."""
    return extract_or_null(col(answer), ANSWER_MARKER).try_cast("double")


def final_answer_text(joined) -> Column:
    """Last match of the first pattern family that matches; else the last number;
    else a fixed sentence. ``joined`` is the executions joined by newline (null if none)."""
    j = col(joined)
    fams = [F.try_element_at(F.regexp_extract_all(j, F.lit("(?id)" + p), 1), F.lit(-1)) for p in FINAL_ANSWER_FAMILIES]
    last = F.try_element_at(F.regexp_extract_all(j, F.lit(f"({NUM})"), 1), F.lit(-1))
    return F.when(j.isNotNull(), F.coalesce(*fams, last, F.lit(FALLBACK_ANSWER)))


def extract_numbers(text) -> Column:
    """Every signed decimal, as doubles."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(f"({SIGNED_NUM})"), 1), lambda x: x.cast("double"))


def word_count(text) -> Column:
    """Whitespace-separated tokens (``len(text.split())``)."""
    return word_count_expr(text)
