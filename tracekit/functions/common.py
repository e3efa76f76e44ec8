"""Small Column builders shared by every operator (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flag prefix for free text: `.` stops only at "\n" (as in Python).
D = "(?d)"

# A plain decimal as Python's float() accepts it after the reference's
# cleaning (no exponent, no underscores, no inf/nan).
STRICT_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
NUM = r"\d+(?:\.\d+)?"
SIGNED_NUM = r"[+-]?\d+(?:\.\d+)?"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITESPACE = " \t\n\x0b\f\r"                  # what ``\\s`` matches in Java
LINE_ENDS = ("\u0085", "\u2028", "\u2029")     # ``$`` also stands before one of these, when a text ends with it


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def strip_value(c) -> Column:
    """:func:`strip` of a column or lambda variable, which stands in the expression several times; only a text that ends
    like a line is searched for whitespace at every character."""
    c, line_end = col(c), F.lit(False)
    for x in LINE_ENDS:
        line_end = line_end | F.endswith(c, F.lit(x))
    return F.when(line_end, strip(c)).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def contains_any(c, words) -> Column:
    """Substring test against a fixed word list, on an already lower-cased column."""
    c = col(c)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def count_present(c, words) -> Column:
    """Number of words of the list that occur (substring) in the column."""
    c = col(c)
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def to_double_strict(c) -> Column:
    """Parse text to double the way Python ``float`` does for plain decimals; else null."""
    c = col(c)
    return F.when(c.rlike(STRICT_DECIMAL), c.try_cast("double"))


def extract_or_null(c, pattern: str, idx: int = 1) -> Column:
    """``regexp_extract`` that returns null instead of '' when nothing matched."""
    return F.nullif(F.regexp_extract(col(c), pattern, idx), F.lit(""))


def hash8(tag: str, *keys) -> Column:
    """Deterministic 32-bit hash: first 8 hex digits of md5(tag|k1|k2...).

    Equal to ``('0x' || substr(md5(concat_ws('|', tag, ...)), 1, 8))::BIGINT``
    in DuckDB, so seeded choices match the oracle.
    """
    parts = [F.lit(tag)] + [col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def r6(c) -> Column:
    """Round a double to 6 places so value hashes are engine independent."""
    return F.round(col(c).cast("double"), 6)


def safe_ratio(num, den) -> Column:
    """num / den, 0.0 on a zero or null denominator (the reference's guard)."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def word_count_expr(c) -> Column:
    """Whitespace-separated tokens (``len(text.split())``)."""
    return F.size(F.array_remove(F.split(col(c), r"\s+"), ""))


def py_float_text(num) -> Column:
    """Python ``str(float(s))`` for a plain decimal string ``s`` (|x| in [1e-4, 1e16)).

    Normalises the text instead of formatting a double, so it is exact and the
    same in every engine: drop '+', leading zeros of the integer part and
    trailing zeros of the fraction, keep at least ``.0``.
    """
    s = col(num)
    neg = s.startswith("-")
    body = F.regexp_replace(s, r"^[+-]", "")
    ip = F.regexp_replace(F.regexp_extract(body, r"^(\d+)", 1), r"^0+(?=\d)", "")
    fp = F.regexp_replace(F.regexp_extract(body, r"\.(\d+)$", 1), r"0+$", "")
    txt = F.concat(ip, F.lit("."), F.when(fp == "", F.lit("0")).otherwise(fp))
    return F.when(neg, F.concat(F.lit("-"), txt)).otherwise(txt)
