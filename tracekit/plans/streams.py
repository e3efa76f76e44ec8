"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.plans.curation import _SFT_PLANNER_SQL, _PLAN_ROWS, PLAN_SOURCE, _sft_planner_rows
from tracekit.plans.registry import register
from tracekit.plans.sql_fixtures import with_fixtures
from tracekit.session import scratch_path
from tracekit.sources import fixtures as fx
from tracekit.streaming import ledger
from tracekit.streaming.progress import EVERY, PROGRESS, run_progress


@register("incremental_curation", with_fixtures("SELECT problem_id, instruction, input, output, source, num_steps FROM sftp",
                                                "plans_fx", "problems_fx", extra={"pr": _PLAN_ROWS, "sftp": _SFT_PLANNER_SQL}))
def incremental_curation(spark, sf):
    """Teacher plans arrive as files; a checkpointed stream parses, filters and formats them batch by batch into the planner's
    dataset. It is stopped after its first batch and started again; the ledger keeps every row once."""
    from tracekit.functions import plan_text as PT
    src, root, ck = scratch_path(spark, "j1-src"), scratch_path(spark, "j1-root"), scratch_path(spark, "j1-ck")
    plans = fx.plans_fx(spark, sf)
    plans.write.parquet(src)
    questions = fx.problems_fx(spark, sf).select("problem_id", "question")

    def curate(batch):
        ex = PT.with_plan_steps(batch.join(questions, "problem_id"), "plan", "steps").where(F.size("steps") >= 2)
        return _sft_planner_rows(spark, sf, ex.withColumn("source", F.lit(PLAN_SOURCE)))

    ledger.run_module(spark, root, "planner", src, plans.schema, curate, ck, files_per_trigger=1, batches=1)
    ledger.run_module(spark, root, "planner", src, plans.schema, curate, ck)
    schema = "problem_id bigint, instruction string, input string, output string, source string, num_steps bigint"
    return ledger.dataset(spark, root, "planner", schema).drop("batch")


@register("live_progress", with_fixtures(f"""
SELECT run, module, results, successes FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS run, module, row_number() OVER w AS results, CAST(sum(CAST(ok AS INTEGER)) OVER w AS BIGINT) AS successes
  FROM request_log_fx WINDOW w AS (PARTITION BY strftime(ts, '%Y-%m-%d'), module ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE results % {EVERY} = 0""", "request_log_fx"))
def live_progress(spark, sf):
    """Request results arrive as files in order of completion (a run is a day); after every tenth result of a run and module, the
    results and successes so far. The stream is stopped in the middle and started again."""
    src, sink, ck = scratch_path(spark, "j2-src"), scratch_path(spark, "j2-sink"), scratch_path(spark, "j2-ck")
    log = fx.request_log_fx(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("run"), "module", "ts", "event_id", "ok")
    middle = log.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(middle)
    for part in (early, ~early):
        log.where(part).write.mode("append").parquet(src)
        run_progress(spark, src, log.schema, sink, ck)
    return spark.read.schema(PROGRESS).parquet(sink)
