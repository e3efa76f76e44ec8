"""Exact splits by selection against the sort; progress rows of a stream against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tracekit.functions.common import hash8
from tracekit.operators import selection
from tracekit.session import scratch_path
from tracekit.streaming.progress import PROGRESS, run_progress


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 1003])
def test_split_sizes_and_members_equal_the_sort(spark, n):
    rng = random.Random(n)
    ids = list({rng.getrandbits(64) - (1 << 63) for _ in range(n)})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.split for r in selection.shuffle_split(df, {"train": 0.8, "val": 0.1, "test": 0.1}, "s", "id").collect()}
    order = [r.id for r in df.orderBy(hash8("s", "id"), "id").collect()]
    a, b = int(n * 0.8), int(n * 0.8) + int(n * 0.1)
    assert got == {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(order)}


def test_ties_in_the_hash_are_cut_by_the_key(spark, monkeypatch):
    monkeypatch.setattr(selection, "hash8", lambda seed, *keys: F.lit(77).cast("bigint"))
    df = spark.range(-50, 50)
    got = sorted(r.id for r in selection.shuffle_split(df, {"a": 0.37, "b": 0.63}, "s", "id").where("split = 'a'").collect())
    assert got == list(range(-50, -13))


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        selection.shuffle_split(spark.range(5), {"a": 0.5, "b": 0.4}, "s", "id")
    assert selection.shuffle_split(spark.range(5), {"a": 0.5, "b": 0.5 + 5e-7}, "s", "id").count() == 5


def test_split_plan_has_no_exchange(spark):
    df = selection.shuffle_split(spark.range(1000), {"a": 0.5, "b": 0.5}, "s", "id")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


SCHEMA = "run string, module string, ts timestamp, event_id long, ok boolean"


@pytest.mark.parametrize("cuts", [[], [137], [5, 9, 300]])
def test_progress_rows_do_not_depend_on_restarts(spark, cuts):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.choice(["planner", "critic"]), k // 3, k, rng.random() < 0.7) for k in range(400)]
    df = spark.createDataFrame(rows, "run string, module string, t long, event_id long, ok boolean").select(
        "run", "module", F.timestamp_seconds("t").alias("ts"), "event_id", "ok")
    src, sink, ck = (scratch_path(spark, x) for x in ("p-src", "p-sink", "p-ck"))
    for a, b in zip([0, *cuts], [*cuts, 400]):
        df.where(F.col("event_id").between(a, b - 1)).repartition(3).write.mode("append").parquet(src)
        run_progress(spark, src, SCHEMA, sink, ck, 4)
    want, n, ok = [], {}, {}
    for run, module, _, _, good in rows:
        k = (run, module)
        n[k], ok[k] = n.get(k, 0) + 1, ok.get(k, 0) + good
        if n[k] % 10 == 0:
            want.append((run, module, n[k], ok[k]))
    assert sorted(tuple(r) for r in spark.read.schema(PROGRESS).parquet(sink).collect()) == sorted(want)
