"""Registered SFT-formatting, summary and loop-report queries
(E4-E6, B5, F17, D9, F13, A5, W5, T9, F19, K1-K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.functions import text as TX
from tracekit.functions.common import hash8, r6, strip
from tracekit.operators import gates, hooks
from tracekit.operators import positional as P
from tracekit.plans import base
from tracekit.plans import sqlfn as S
from tracekit.plans.curation import _PLAN_ROWS, _SFT_PLANNER_SQL, sft_planner
from tracekit.plans.evaluation import _E2_INPUT, _EX_CTES, EXECUTOR_INSTRUCTION, sft_executor
from tracekit.plans.refinement import _OUTCOME_SQL, _outcomes
from tracekit.plans.registry import register
from tracekit.plans.sql_chain import TRUTH, chain_sql
from tracekit.plans.sql_fixtures import H, with_fixtures
from tracekit.sources import fixtures as fx

# Fixed values of the reference's trainer configuration
EXECUTOR_SYSTEM = ("You are a precise mathematical executor. Execute each step with detailed calculations and clear "
                   "reasoning.")
PLANNER_SYSTEM = ("You are a strategic planner for mathematical problem solving. Generate a high-level, multi-step "
                  "strategic blueprint with 3-6 clear, sequential steps.")
MAX_LENGTH = 2048
BATCH_PER_DEVICE = 2
GRAD_ACCUM = 4
EPOCHS = 2
SECONDS_PER_STEP = 3.5
VOCAB = 32000
PROJECTION_RATES = (0.25, 0.5, 0.75, 1.0)

_SFTP = {"pr": _PLAN_ROWS, "sftp": _SFT_PLANNER_SQL}
_SFTP_FIX = ("plans_fx", "problems_fx")


def _instruction_prompt(instr, inp):
    has_input = strip(inp) != ""
    return F.concat(F.lit("### Instruction:\n"), instr, F.lit("\n\n"),
                    F.when(has_input, F.concat(F.lit("### Input:\n"), inp, F.lit("\n\n"))).otherwise(F.lit("")),
                    F.lit("### Response:\n"))


def prompts(spark, sf):
    pairs = fx.pairs_fx(spark, sf).select(
        F.concat(F.lit("pair-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"),
        F.lit("qa").alias("form"), F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: ")).alias("prompt"),
        F.col("answer").alias("response"))
    sft = sft_planner(spark, sf).select(
        F.concat(F.lit("plan-"), F.col("problem_id").cast("string")).alias("key"), F.lit("instruction").alias("form"),
        _instruction_prompt(F.col("instruction"), F.col("input")).alias("prompt"), F.col("output").alias("response"))
    return pairs.unionByName(sft)


_PROMPTS_SQL = f"""
SELECT 'pair-' || conv_id || '-' || turn AS key, 'qa' AS form, 'Question: ' || question || chr(10) || 'Answer: ' AS prompt,
  answer AS response FROM pairs_fx
UNION ALL
SELECT 'plan-' || problem_id, 'instruction', '### Instruction:' || chr(10) || instruction || chr(10) || chr(10)
  || CASE WHEN {S.strip('input')} <> '' THEN '### Input:' || chr(10) || input || chr(10) || chr(10) ELSE '' END
  || '### Response:' || chr(10), output FROM sftp"""


@register("instruction_prompt", with_fixtures("SELECT key, form, prompt, response FROM pm", "pairs_fx", *_SFTP_FIX,
                                              extra={**_SFTP, "pm": _PROMPTS_SQL}))
def instruction_prompt(spark, sf):
    """instruction/input/response or Q/A prompt text per training row."""
    return prompts(spark, sf)


def _ids(words):
    """Token ids as texts."""
    return F.transform(words, lambda w: (hash8("tok", w) % VOCAB).cast("string"))


@register("masked_sequence", with_fixtures(f"""
SELECT key, CAST(len(ids) AS BIGINT) AS n_ids, CAST(least(pl, len(ids)) AS BIGINT) AS prompt_len,
  array_to_string(ids, ' ') AS input_ids, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= pl THEN -100 ELSE x END), ' ') AS labels,
  array_to_string(list_transform(ids, lambda x: 1), ' ') AS attention_mask
FROM (SELECT key, least(len(pw), {MAX_LENGTH}) AS pl,
        list_transform(fw[1:{MAX_LENGTH}], lambda w: ({H('tok', 'w')}) % {VOCAB}) AS ids
      FROM (SELECT key, list_filter(regexp_split_to_array(prompt, '\\s+'), lambda x: x <> '') AS pw,
                   list_filter(regexp_split_to_array(prompt || response, '\\s+'), lambda x: x <> '') AS fw FROM pm))""",
                                           "pairs_fx", *_SFTP_FIX, extra={**_SFTP, "pm": _PROMPTS_SQL}))
def masked_sequence(spark, sf):
    """E5: token ids of prompt+response (whitespace words, hashed ids) truncated to max_length;
    labels mask the prompt part with -100. The arrays are returned as texts, split by blanks."""
    p = prompts(spark, sf)
    words = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    p = p.select("key", F.least(F.size(words(F.col("prompt"))), F.lit(MAX_LENGTH)).alias("pl"),
                 _ids(F.slice(words(F.concat("prompt", "response")), 1, MAX_LENGTH)).alias("ids"))
    # only the ids need a look at every word; labels and mask are the ids' tail and repeated texts
    p = p.withColumn("n", F.size("ids")).withColumn("masked", F.least("pl", "n"))
    labels = F.concat(F.array_repeat(F.lit("-100"), F.col("masked")), F.slice("ids", F.col("masked") + 1, F.col("n")))
    return p.select("key", F.col("n").cast("bigint").alias("n_ids"), F.col("masked").cast("bigint").alias("prompt_len"),
                    F.array_join("ids", " ").alias("input_ids"), F.array_join(labels, " ").alias("labels"),
                    F.array_join(F.array_repeat(F.lit("1"), F.col("n")), " ").alias("attention_mask"))


@register("chat_rows", with_fixtures(f"""
SELECT module, problem_id, pos, idx, role, CASE idx WHEN 1 THEN system WHEN 2 THEN instruction || chr(10) || chr(10) || before || input
  ELSE output END AS content
FROM (SELECT 'planner' AS module, problem_id, CAST(0 AS BIGINT) AS pos, {S.q(PLANNER_SYSTEM)} AS system, instruction, '' AS before, input, output FROM sftp
      UNION ALL SELECT 'executor', problem_id, pos, {S.q(EXECUTOR_SYSTEM)}, {S.q(EXECUTOR_INSTRUCTION)}, 'Context: ', {_E2_INPUT}, execution FROM ex),
  (VALUES (1, 'system'), (2, 'user'), (3, 'assistant')) m(idx, role)""", *_SFTP_FIX, "attempts_fx", extra={**_SFTP, **_EX_CTES}))
def chat_rows(spark, sf):
    """System / user / assistant messages of the planner and the executor trainer, one row per message."""
    cols = ["problem_id", "instruction", "input", "output"]
    s = sft_planner(spark, sf).select(F.lit("planner").alias("module"), F.lit(0).cast("bigint").alias("pos"),
                                      F.lit(PLANNER_SYSTEM).alias("system"), F.lit("").alias("before"), *cols)
    s = s.unionByName(sft_executor(spark, sf).select(
        F.lit("executor").alias("module"), "pos", F.lit(EXECUTOR_SYSTEM).alias("system"), F.lit("Context: ").alias("before"), *cols))
    msgs = F.array(F.struct(F.lit(1).alias("idx"), F.lit("system").alias("role"), F.col("system").alias("content")),
                   F.struct(F.lit(2).alias("idx"), F.lit("user").alias("role"),
                            F.concat("instruction", F.lit("\n\n"), "before", "input").alias("content")),
                   F.struct(F.lit(3).alias("idx"), F.lit("assistant").alias("role"), F.col("output").alias("content")))
    return s.select("module", "problem_id", "pos", F.explode(msgs).alias("m")).select(
        "module", "problem_id", "pos", "m.idx", "m.role", "m.content")


@register("gate_sft", with_fixtures("""
SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN output IS NULL OR length(output) < 5 THEN 'output' ELSE 'accepted' END AS outcome FROM sftp
  UNION ALL
  SELECT CASE WHEN answer IS NULL OR length(answer) < 5 THEN 'answer' ELSE 'accepted' END FROM pairs_fx)
GROUP BY outcome""", "pairs_fx", *_SFTP_FIX, extra=_SFTP))
def gate_sft(spark, sf):
    """Instruction rows and Q/A rows through one rule list."""
    ins = sft_planner(spark, sf).select("instruction", "input", "output", F.lit(None).cast("string").alias("question"),
                                        F.lit(None).cast("string").alias("answer"))
    qa = fx.pairs_fx(spark, sf).select(*[F.lit(None).cast("string").alias(c) for c in ("instruction", "input", "output")],
                                       "question", "answer")
    rows = ins.unionByName(qa)
    rules = gates.sft_rules(F.col("instruction").isNotNull(), F.col("question").isNotNull())
    _, ledger = gates.apply_gate(rows, rules)
    return ledger


@register("train_sizing", with_fixtures(f"""
SELECT n, train, n - train AS eval, steps_per_epoch, steps_per_epoch * {EPOCHS} AS total_steps,
  round(steps_per_epoch * {EPOCHS} * {SECONDS_PER_STEP} / 3600, 6) AS est_hours
FROM (SELECT n, train, train // {BATCH_PER_DEVICE * GRAD_ACCUM} AS steps_per_epoch FROM
      (SELECT count(*) AS n, CAST(floor(0.9 * count(*)) AS BIGINT) AS train FROM sftp))""", *_SFTP_FIX, extra=_SFTP))
def train_sizing(spark, sf):
    """train/eval sizes, steps per epoch, total steps and hours at 3.5 s/step."""
    a = sft_planner(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    a = a.withColumn("train", F.floor(F.col("n") * 0.9).cast("bigint"))
    spe = F.floor(F.col("train") / (BATCH_PER_DEVICE * GRAD_ACCUM)).cast("bigint")
    return a.select("n", "train", (F.col("n") - F.col("train")).alias("eval"), spe.alias("steps_per_epoch"),
                    (spe * EPOCHS).alias("total_steps"), r6(spe * EPOCHS * SECONDS_PER_STEP / 3600).alias("est_hours"))


@register("variant_diff", with_fixtures("""
SELECT prompt_id, output_a = output_b AS identical, CAST(length(output_a) AS BIGINT) AS base_length,
  CAST(length(output_b) AS BIGINT) AS adapter_length, CASE WHEN output_a = output_b THEN 'FAILED' ELSE 'PASSED' END AS verdict,
  bool_and(output_a <> output_b) OVER () AS all_passed FROM variants_fx""", "variants_fx"))
def variant_diff(spark, sf):
    """Same prompt under two variants; PASSED when the outputs differ; all-pass over the batch."""
    v = fx.variants_fx(spark, sf)
    all_passed = v.agg(F.bool_and(F.col("output_a") != F.col("output_b"))).scalar()
    return v.select("prompt_id", (F.col("output_a") == F.col("output_b")).alias("identical"),
                    F.length("output_a").cast("bigint").alias("base_length"),
                    F.length("output_b").cast("bigint").alias("adapter_length"),
                    F.when(F.col("output_a") == F.col("output_b"), "FAILED").otherwise("PASSED").alias("verdict"),
                    all_passed.alias("all_passed"))


@register("running_progress", chain_sql("""
SELECT pos, round(ok / pos, 6) AS success_rate, round(secs / pos, 6) AS avg_time FROM (
  SELECT row_number() OVER w AS pos, sum(CAST(success AS INTEGER)) OVER w AS ok, sum(seconds) OVER w AS secs
  FROM solved WINDOW w AS (ORDER BY problem_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE pos % 10 = 0"""))
def running_progress(spark, sf):
    """Every 10 results, success rate and mean time so far (distributed prefix sums)."""
    s = base.solved(spark, sf).select("problem_id", F.col("success").cast("bigint").alias("ok"), "seconds")
    c = P.prefix_sums(s, ["problem_id"], ["ok", "seconds"], suffix="_cum", pos_col="pos")
    return c.where(F.col("pos") % 10 == 0).select(
        "pos", r6(F.col("ok_cum") / F.col("pos")).alias("success_rate"), r6(F.col("seconds_cum") / F.col("pos")).alias("avg_time"))


@register("failure_report", chain_sql(f"""
SELECT problem_id, CASE WHEN predicted IS NULL THEN 'no_answer' WHEN steps_run = 0 THEN 'no_steps'
    WHEN steps_run < n_steps THEN 'incomplete' ELSE 'calculation' END AS primary_issue,
  CAST(length(plan) AS BIGINT) AS plan_chars, CAST(n_steps AS BIGINT) AS n_steps, CAST(steps_run AS BIGINT) AS n_executions,
  round(abs(predicted - ground_truth), 6) AS abs_error
FROM (SELECT s.*, p.plan, t.ground_truth, {S.extract_answer('s.executions')} AS predicted
      FROM solved s JOIN truth t USING (problem_id) JOIN plans_fx p USING (problem_id) WHERE t.ground_truth IS NOT NULL)
WHERE predicted IS NULL OR NOT abs(predicted - ground_truth) < 0.01""", extra={"truth": TRUTH}, fixtures=("problems_fx", "plans_fx")))
def failure_report(spark, sf):
    """T9 (C29, C30): primary issue and sizes of every wrong result."""
    s = base.solved(spark, sf).join(base.truth(spark, sf), "problem_id").join(fx.plans_fx(spark, sf), "problem_id")
    s = s.where(F.col("predicted").isNull() | ~(F.abs(F.col("predicted") - F.col("ground_truth")) < 0.01))
    issue = (F.when(F.col("predicted").isNull(), "no_answer").when(F.col("steps_run") == 0, "no_steps")
             .when(F.col("steps_run") < F.col("n_steps"), "incomplete").otherwise("calculation"))
    return s.select("problem_id", issue.alias("primary_issue"), F.length("plan").cast("bigint").alias("plan_chars"),
                    F.col("n_steps").cast("bigint").alias("n_steps"), F.col("steps_run").cast("bigint").alias("n_executions"),
                    r6(F.abs(F.col("predicted") - F.col("ground_truth"))).alias("abs_error"))


@register("recovery_projection", chain_sql(
    "SELECT CAST(r AS DOUBLE) AS r, round((correct + r * incomplete) / total, 6) AS projected_accuracy FROM (SELECT count(*) FILTER (WHERE correct) AS correct, "
    "count(*) FILTER (WHERE NOT complete) AS incomplete, count(*) AS total FROM outcomes), (VALUES "
    + ", ".join(f"({r})" for r in PROJECTION_RATES) + ") v(r)",
    extra={"truth": TRUTH, "outcomes": _OUTCOME_SQL}, fixtures=("problems_fx",)))
def recovery_projection(spark, sf):
    """accuracy if a share r of incomplete traces became correct."""
    o = _outcomes(spark, sf).agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("complete")).alias("incomplete"),
                                 F.count(F.lit(1)).alias("total"))
    o = o.withColumn("r", F.explode(F.array(*[F.lit(r) for r in PROJECTION_RATES])))
    return o.select(F.col("r").cast("double").alias("r"),
                    r6((F.col("correct") + F.col("r") * F.col("incomplete")) / F.col("total")).alias("projected_accuracy"))


# K1-K3 ----------------------------------------------------------------------------
@register("generator_hook", with_fixtures(
    "SELECT problem_id, CAST(count(*) AS BIGINT) AS num_steps FROM pr GROUP BY problem_id", "plans_fx", extra={"pr": _PLAN_ROWS}))
def generator_hook(spark, sf):
    """K2: a user generation step (parse the teacher plan) applied with ``DataFrame.transform``."""
    from tracekit.functions import plan_text as PT
    gen = lambda df: PT.with_plan_steps(df, "plan", "steps").where(F.size("steps") > 0)
    out = hooks.generate(fx.plans_fx(spark, sf), gen)
    return out.select("problem_id", F.size("steps").cast("bigint").alias("num_steps"))


@register("format_hook", with_fixtures("SELECT problem_id, instruction, input, output FROM sftp", *_SFTP_FIX, extra=_SFTP))
def format_hook(spark, sf):
    """K3: the per-module training format supplied as a transform."""
    from tracekit.plans.curation import _plan_examples, _sft_planner_rows, PLAN_SOURCE
    ex = _plan_examples(spark, sf).where(F.size("steps") >= 2).withColumn("source", F.lit(PLAN_SOURCE))
    out = hooks.format_rows(ex, lambda df: _sft_planner_rows(spark, sf, df))
    return out.select("problem_id", "instruction", "input", "output")
