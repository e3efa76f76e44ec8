"""The clipped running quota against the plain loop over batches."""

import random

import pytest
from pyspark.sql import functions as F

from tracekit.operators.quota import clipped_quota

SIZE = 10


def plain(batches, target):
    """batches: lists of verdicts in order -> kept (batch, place), ledger rows."""
    kept, ledger = [], []
    for b, oks in batches:
        needed = min(SIZE, target - len(kept))
        if needed <= 0:
            break
        made = oks[:needed]
        good = [(b, k + 1) for k, ok in enumerate(made) if ok]
        kept += good
        if made:
            ledger.append((b, len(made), len(good), len(kept)))
    return kept, ledger


def run(spark, batches, target):
    rows = [(b, k, ok) for b, oks in batches for k, ok in enumerate(oks)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "batch long, k long, ok boolean")
    kept, ledger = clipped_quota(df, ["k"], lambda d: d["ok"], target, SIZE)
    return (sorted((r.batch, r.place) for r in kept.collect()),
            sorted((r.batch, r.generated, r.valid, r.total) for r in ledger.collect()))


@pytest.mark.parametrize("share,target", [(0.9, 137), (0.5, 100), (0.5, 7), (0.05, 19), (0.02, 8), (1.0, 250), (0.3, 10_000), (0.0, 5), (0.4, 10)])
def test_quota_like_the_loop(spark, share, target):
    rng = random.Random(int(share * 100) + target)
    batches = [(b, [rng.random() < share for _ in range(rng.choice([SIZE, SIZE, 3]))]) for b in range(60)]
    assert run(spark, batches, target) == plain(batches, target)


def test_target_inside_a_batch(spark):
    """The last batch is cut short; an invalid row in its shorter part is made up for by the next one."""
    batches = [(0, [True] * 10), (1, [False, True, True] + [True] * 7), (2, [False] * 10), (3, [True] * 10)]
    kept, ledger = run(spark, batches, 13)
    assert len(kept) == 13 and kept[-3:] == [(1, 2), (1, 3), (3, 1)]
    assert ledger == [(0, 10, 10, 10), (1, 3, 2, 12), (2, 1, 0, 12), (3, 1, 1, 13)]


def test_null_verdicts_empty_tables_and_columns(spark):
    assert run(spark, [(0, [None, True, None])], 5) == ([(0, 2)], [(0, 3, 1, 1)])
    df = spark.createDataFrame([], "batch long, k long, ok boolean, question string")
    kept, ledger = clipped_quota(df, ["k"], F.col("ok"), 5, SIZE)
    assert kept.columns == [*df.columns, "place"] and kept.count() == ledger.count() == 0
