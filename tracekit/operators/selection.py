"""Exact splits by distributed selection (H7): the k-th key is found by refining a histogram, nothing is sorted.

A key is a tuple of 16-bit digits. One pass counts the rows by the first digit; the digit that holds rank k
is kept, and the next pass counts the second digit of its rows only. Every pass is a narrow scan with a partial
aggregate of at most 65,536 counts for each rank, and the passes end as soon as a rank falls on the end of a digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.functions.common import hash8

DIGIT = 16
_MASK = (1 << DIGIT) - 1


def long_digits(c: Column) -> list[Column]:
    """The digits of a long, ordered as the number is (the sign bit turned)."""
    x = F.coalesce(c, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(x, at).bitwiseAND(F.lit(_MASK)).cast("int") for at in (48, 32, 16, 0)]


def hash_digits(seed: str, *keys: str) -> list[Column]:
    h = hash8(seed, *keys)
    return [F.shiftright(h, DIGIT).cast("int"), h.bitwiseAND(F.lit(_MASK)).cast("int")]


def kth_prefixes(df: DataFrame, digits: Sequence[Column], ranks: Sequence[int]) -> list[tuple[int, ...]]:
    """For each rank k, a prefix of digits: exactly k rows have digits up to and with it (rank 0: the empty tuple, none).

    Rows with wholly equal digits cannot be told apart and stay on one side.
    """
    names = [f"_d{i}" for i in range(len(digits))]
    keyed = df.select(*[d.alias(n) for d, n in zip(digits, names)])
    found: dict[int, tuple[int, ...]] = {}
    open_ranks = {k: ((), k) for k in set(ranks) if k > 0}       # rank -> prefix so far, rank inside it
    for depth in range(1, len(digits) + 1):
        if not open_ranks:
            break
        heads = {p for p, _ in open_ranks.values()}
        inside = F.lit(False)
        for p in heads:
            same = F.lit(True)
            for n, v in zip(names, p):
                same = same & (F.col(n) == v)
            inside = inside | same
        counts = keyed.where(inside).groupBy(*names[:depth]).agg(F.count(F.lit(1)).alias("n")).collect()
        bins: dict[tuple, list[tuple[int, int]]] = {p: [] for p in heads}
        for r in counts:
            bins[tuple(r[:depth - 1])].append((r[depth - 1], r["n"]))
        following = {}
        for k, (p, left) in open_ranks.items():
            for digit, n in sorted(bins[p]):
                if left <= n:
                    break
                left -= n
            if left == n or depth == len(digits):
                found[k] = (*p, digit)
            else:
                following[k] = ((*p, digit), left)
        open_ranks = following
    return [found.get(k, ()) for k in ranks]


def up_to(digits: Sequence[Column], prefix: tuple[int, ...]) -> Column:
    """Whether a row's digits come up to ``prefix``."""
    out = F.lit(bool(prefix))
    for d, v in reversed(list(zip(digits, prefix))):
        out = (d < v) | ((d == v) & out)
    return out


def shuffle_split(df: DataFrame, ratios: dict[str, float], seed: str, key: str) -> DataFrame:
    """``df`` plus ``split``: a seeded shuffle cut into exact sizes, floor(n * ratio) for all parts but the last, which takes the rest.

    ``key`` is a unique long. The ratios must sum to 1 within 1e-6.
    """
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError("Ratios must sum to 1.0")
    digits = [*hash_digits(seed, key), *long_digits(F.col(key))]
    n, ends, at = df.count(), [], 0
    for r in list(ratios.values())[:-1]:
        at += int(n * r)
        ends.append(at)
    split = F.lit(list(ratios)[-1])
    for name, prefix in reversed(list(zip(ratios, kth_prefixes(df, digits, ends)))):
        split = F.when(up_to(digits, prefix), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)
