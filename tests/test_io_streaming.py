"""Sources/sinks and streaming: round trips, resume without duplicates, restart from checkpoint."""

import pytest
from pyspark.sql import functions as F

from tracekit.session import scratch_path
from tracekit.sources import records as R
from tracekit.streaming import ledger


def test_jsonl_and_csv_round_trip(spark):
    df = spark.createDataFrame([(1, "Étienne dit: «oui»", "a\nb, \"c\""), (2, "plain", "")],
                               "id bigint, name string, note string")
    for fmt in ("jsonl", "csv"):
        path = scratch_path(spark, f"rt-{fmt}")
        R.write_records(df, path, fmt)
        back = R.read_records(spark, path, fmt, "id bigint, name string, note string")
        got = sorted((r.id, r.name, r.note or "") for r in back.collect())
        assert got == [(1, "Étienne dit: «oui»", "a\nb, \"c\""), (2, "plain", "")]


def test_json_array_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "é"},\n {"id": 2, "name": null}]', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": 1, "name": "é"}\n\n{"id": 2, "name": null}\n', encoding="utf-8")
    for fmt, name in (("json", "a.json"), ("jsonl", "b.jsonl")):
        got = R.read_records(spark, str(tmp_path / name), fmt, "id bigint, name string").collect()
        assert sorted((r.id, r.name) for r in got) == [(1, "é"), (2, None)]
    with pytest.raises(ValueError):
        R.read_records(spark, str(tmp_path / "a.json"), "xml", "id bigint")


def test_problems_by_split(spark, tmp_path):
    R.write_records(spark.createDataFrame([("q", "a #### 1")], "question string, answer string"), str(tmp_path / "train"), "jsonl")
    assert [tuple(r) for r in R.read_problems(spark, str(tmp_path)).collect()] == [("q", "a #### 1")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.read_problems(spark, str(tmp_path), "test").collect()


def test_precheck_reports_missing_columns(spark):
    df = spark.createDataFrame([("i", "o")], "instruction string, output string")
    got = {r.check: r.ok for r in R.training_precheck(df, ["instruction", "input", "output"], 1).collect()}
    assert got == {"required_columns": False, "null_fields": True, "row_count": True}


class Died(Exception):
    pass


def die_at(call):
    """A function that raises on its n-th call."""
    seen = []

    def f():
        seen.append(1)
        if len(seen) == call:
            raise Died
    return f


ROWS = "k bigint, v bigint"


def parts(spark, n=5, size=100, calls=None):
    """n batches of ``size`` rows; ``calls`` notes the batches that are computed."""
    def of(b):
        if calls is not None:
            calls.append(b)
        return spark.range(b * size, (b + 1) * size).select(F.col("id").alias("k"), F.lit(b).cast("bigint").alias("v"))
    return [lambda b=b: of(b) for b in range(n)]


@pytest.mark.parametrize("call", [1, 2, 3])
def test_killed_between_rows_and_record(spark, call):
    root = scratch_path(spark, "ledger")
    with pytest.raises(Died):
        ledger.append_batches(spark, root, "m", parts(spark), between=die_at(call))
    assert ledger.dataset(spark, root, "m", ROWS).count() == 100 * (call - 1)   # the torn batch is not seen
    calls = []
    assert ledger.append_batches(spark, root, "m", parts(spark, calls=calls)) == ledger.Progress(4, 500)
    assert calls == list(range(call - 1, 5))
    out = ledger.dataset(spark, root, "m", ROWS)
    assert out.count() == out.select("k").distinct().count() == 500


def test_finished_module_is_skipped(spark):
    root, calls = scratch_path(spark, "ledger"), []
    for _ in range(3):
        assert ledger.append_batches(spark, root, "a", parts(spark, calls=calls), target=250) == ledger.Progress(2, 300)
    assert calls == [0, 1, 2]
    ledger.append_batches(spark, root, "b", parts(spark, 2), target=1000)
    got = {(r.module, r.batch): (r.rows, r.total, r.target) for r in ledger.ledger(spark, root).collect()}
    assert got == {("a", 0): (100, 100, 250), ("a", 1): (100, 200, 250), ("a", 2): (100, 300, 250),
                   ("b", 0): (100, 100, 1000), ("b", 1): (100, 200, 1000)}
    assert ledger.dataset(spark, root, "none", ROWS).count() == 0


def stream_files(spark, files=6, rows=120):
    src = scratch_path(spark, "s-src")
    data = spark.range(0, rows * files).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    data.repartition(files).write.parquet(src)
    return src, data


def test_stream_killed_between_rows_and_record(spark):
    src, data = stream_files(spark)
    root, ck = scratch_path(spark, "s-root"), scratch_path(spark, "s-ck")
    keep = lambda df: df.where("v < 5")
    with pytest.raises(Exception, match="Died"):
        ledger.run_module(spark, root, "m", src, data.schema, keep, ck, files_per_trigger=1, between=die_at(3))
    assert ledger.progress(spark, root, "m").last_batch == 1
    for _ in range(2):
        ledger.run_module(spark, root, "m", src, data.schema, keep, ck, files_per_trigger=1)
    out = ledger.dataset(spark, root, "m", ROWS)
    assert sorted(r.k for r in out.collect()) == [r.k for r in keep(data).orderBy("k").collect()]


def test_recorded_batch_that_comes_again_is_skipped(spark):
    """Killed after the record and before the stream's own commit: the stream sends the batch once more."""
    root, calls = scratch_path(spark, "s-root"), []
    one = parts(spark, calls=calls)[0]
    assert ledger.commit_batch(one(), root, "m", 0) == ledger.commit_batch(one().limit(3), root, "m", 0) == ledger.Progress(0, 100)
    assert ledger.dataset(spark, root, "m", ROWS).count() == 100


def test_stream_stops_at_target_also_after_restart(spark):
    src, data = stream_files(spark)
    root, ck = scratch_path(spark, "s-root"), scratch_path(spark, "s-ck")
    run = lambda **k: ledger.run_module(spark, root, "m", src, data.schema, lambda d: d, ck, target=300, files_per_trigger=1, **k)
    assert run(batches=1).last_batch == 0
    done = run()
    assert done.total >= 300 and done.last_batch == 2
    assert run() == done
    assert ledger.dataset(spark, root, "m", ROWS).count() == done.total
    # a higher target goes on with the files that are left: none was passed over
    more = ledger.run_module(spark, root, "m", src, data.schema, lambda d: d, ck, target=10_000, files_per_trigger=1)
    assert more.total == data.count() == ledger.dataset(spark, root, "m", ROWS).select("k").distinct().count()
