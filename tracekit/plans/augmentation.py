"""Registered teacher requests and the augmentations made from their completions.

A request's id is derived from its prompt. ``completions_fx`` is the store of teacher answers (D1): what a teacher wrote
for the augmentation requests, some missing, some copies of the original, some of another kind than asked for. Each augmentation
joins its requests with the store and admits only the completions that pass its rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekit.functions import execution as EX
from tracekit.functions import plan_text as PT
from tracekit.functions.common import hash8
from tracekit.operators import completions as C
from tracekit.operators import gates
from tracekit.operators import positional as P
from tracekit.plans import base
from tracekit.plans import sqlfn as S
from tracekit.plans.critic_data import (DEFAULT_INSTRUCTION, ERROR_INSTRUCTIONS, ERROR_TYPES, VARIATION_SOURCE as ERROR_VARIATION,
                                        _CTES as _CX_CTES, _VAR_SQL, critic_examples, flawed_sql, flawed_text, variations)
from tracekit.plans.curation import (_PLAN_ROWS, _SFT_PLANNER_SQL, PLAN_SOURCE, VARIATION_SOURCE, _plan_examples, _sft_planner_rows)
from tracekit.plans.evaluation import (_E2_INPUT, _EX_CTES, _EX_FIX, _RANKED, CONTEXT_VARIATION, EXECUTOR_INSTRUCTION, _sft_exec,
                                       context_variations, exec_candidates, exec_examples)
from tracekit.plans.registry import register
from tracekit.plans.requests import (ERROR_EXECUTION_SYSTEM, EXECUTION_SYSTEM, FEEDBACK_SYSTEM, INJECTION_SYSTEM_HEAD,
                                     INJECTION_SYSTEM_TAIL, OWN_EXTRACT_SYSTEM, OWN_EXTRACT_TAIL, PLAN_EXTRACT_SYSTEM,
                                     SOLUTION_SYSTEM, SOLUTION_USER, VARIATION_SYSTEM)
from tracekit.plans.sql_fixtures import H, with_fixtures
from tracekit.sources import fixtures as fx

ERROR_SOURCE = "error_correction"
BY = ("problem_id",)   # the store and the requests lie by problem
REQUEST = ("request_id", "problem_id", "kind", "system", "user", "max_tokens")


def _say(*parts) -> Column:
    """Prompt text of literals and ``{column}`` names."""
    return F.concat(*[F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts])


# ---------------------------------------------------------------------------
# Requests of the augmentations, with the columns that their rows are made of
# ---------------------------------------------------------------------------
def variation_requests(spark, sf) -> DataFrame:
    """One rephrasing of each plan of the first half (>= 2 steps)."""
    ex = _plan_examples(spark, sf).where(F.size("steps") >= 2)
    last = fx.once(spark, sf, "plan_half", lambda: P.last_key(ex, ["problem_id"], P.share(1, 2)))
    half = P.up_to(ex, ["problem_id"], last).select("problem_id", "question", "plan")
    return C.with_request(half, "variation", ["problem_id"], F.lit(VARIATION_SYSTEM),
                          _say("Original Plan:\n", "{plan}", "\n\nCreate a rephrased version:"), 300)


def error_requests(spark, sf) -> DataFrame:
    """H9: an error version for the first int(0.3 * m) executions of the first quarter (m = len // 4)."""
    ex, order = exec_examples(spark, sf), ["problem_id", "pos"]
    chosen = P.up_to(ex, order, fx.once(spark, sf, "error_part", lambda: P.last_key(ex, order, lambda n: P.share(3, 10)(P.share(1, 4)(n)))))
    return C.with_request(chosen, "execution_error", ["problem_id", "pos"], F.lit(ERROR_EXECUTION_SYSTEM),
                          _say("Original correct execution:\n", "{execution}", "\n\nCreate a version with a subtle error:"), 400)


def injection_requests(ex: DataFrame, error_type: str = "error_type") -> DataFrame:
    """A flawed version of every critic example (problem_id, k, draw), of the given type."""
    cat = ex.sparkSession.createDataFrame(list(ERROR_INSTRUCTIONS), f"{error_type} string, instruction string")
    ex = ex.join(F.broadcast(cat), error_type, "left").withColumn("instruction", F.coalesce("instruction", F.lit(DEFAULT_INSTRUCTION)))
    return C.with_request(ex, "error_injection", ["problem_id", "k", "draw"],
                          _say(INJECTION_SYSTEM_HEAD, "{instruction}", INJECTION_SYSTEM_TAIL),
                          _say("Problem: ", "{question}", "\nCorrect solution: ", "{correct_execution}",
                               "\n\nCreate a version with the specified error type (", f"{{{error_type}}}", "):"), 400)


def feedback_requests(ex: DataFrame) -> DataFrame:
    """Feedback on ``flawed_execution``: the id changes with the flawed text."""
    return C.with_request(ex, "feedback", ["problem_id", "k", "draw"], F.lit(FEEDBACK_SYSTEM),
                          _say("Problem: ", "{question}", "\nStep being executed: ", "{step_description}", "\n\nCORRECT execution:\n",
                               "{correct_execution}", "\n\nSTUDENT'S flawed execution:\n", "{flawed_execution}",
                               "\n\nProvide specific, actionable feedback to help the student correct their error:"), 300)


def _with_flawed(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Injection requests with the stored flawed text, as the base of the feedback requests."""
    return C.attach(requests, completions, "flawed_execution", BY).drop(*[c for c in REQUEST if c != "problem_id"])


# ---------------------------------------------------------------------------
# The store: what the teacher answered (derived, like every trace table)
# ---------------------------------------------------------------------------
def _answers_variation(spark, sf) -> DataFrame:
    var = variation_requests(spark, sf)
    c = hash8("cvar", "problem_id") % 8
    new = F.array_join(F.transform("lines", lambda x: F.concat(x["o"].cast("string"), F.lit(". Bring in "), x["q"].cast("string"),
                                                               F.lit(" more units from line "), x["o"].cast("string"))), "\n")
    return var.join(fx.gathered_lines(fx.order_lines(spark, sf)), "problem_id").select(
        "problem_id", "request_id", F.when(c == 0, F.lit(None)).when(c == 1, F.col("plan"))
        .when(c == 2, F.lit("Do it all in one go.")).otherwise(new).alias("completion"))


def _answers_execution_error(spark, sf) -> DataFrame:
    e = hash8("cerr", "problem_id", "pos") % 10
    wrong = F.regexp_replace("execution", F.lit(r"(= |Result: |answer is )(\d+)"), F.concat(F.lit("$1$2"), e.cast("string")))
    return error_requests(spark, sf).select(
        "problem_id", "request_id", F.when(e == 0, F.lit(None)).when(e == 1, F.col("execution"))
        .when(e == 2, F.regexp_replace("execution", "^We add", "Adding")).otherwise(wrong).alias("completion"))


def _answers_error_injection(spark, sf) -> DataFrame:
    inj = injection_requests(variations(spark, sf).drop("flawed_execution", "feedback"), "new_error_type")
    i = hash8("cinj", "problem_id", "k", "draw") % 10
    other = F.element_at(F.array(*[F.lit(t) for t in ERROR_TYPES[3:] + ERROR_TYPES[:3]]),
                         F.array_position(F.array(*[F.lit(t) for t in ERROR_TYPES]), F.col("new_error_type")).cast("int"))
    return inj.withColumn("completion", F.when(i == 0, F.lit(None)).when(i == 1, F.col("correct_execution"))
                          .when(i == 2, flawed_text(F.col("correct_execution"), other))
                          .otherwise(flawed_text(F.col("correct_execution"), F.col("new_error_type"))))


def _answers_feedback(spark, sf) -> DataFrame:
    inj = _answers_error_injection(spark, sf).where("completion is not null").drop(*[x for x in REQUEST if x != "problem_id"])
    fb = feedback_requests(inj.withColumnRenamed("completion", "flawed_execution"))
    f = hash8("cfb", "problem_id", "k", "draw") % 8
    named = F.regexp_replace(F.when(f == 1, F.col("error_type")).otherwise(F.col("new_error_type")), "_", " ")
    return fb.select("problem_id", "request_id", F.when(f == 0, F.lit(None)).otherwise(F.concat(
        F.lit("The "), named, F.lit(" in step "), F.col("k").cast("string"), F.lit(" is incorrect. You should recalculate it."))).alias("completion"))


_ANSWERS = {"variation": _answers_variation, "execution_error": _answers_execution_error,
            "error_injection": _answers_error_injection, "feedback": _answers_feedback}


def completions_fx(spark, sf, kind: str) -> DataFrame:
    """``problem_id, request_id, completion`` of the answers to requests of a kind: written once per session and bucketed by
    problem, as the requests lie, so that their texts are neither dealt to the store nor to the answers."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    build = lambda: _ANSWERS[kind](spark, sf).where("completion is not null").select("problem_id", "request_id", "completion")
    return fx.materialized(spark, sf, f"completions_{kind}", build, BY)


_OTHER_SQL = "[" + ", ".join(S.q(t) for t in ERROR_TYPES[3:] + ERROR_TYPES[:3]) + "][list_position([" \
    + ", ".join(S.q(t) for t in ERROR_TYPES) + "], new_error_type)]"
_EI = " UNION ALL ".join(f"SELECT {S.q(a)} AS error_type, {S.q(b)} AS instruction" for a, b in ERROR_INSTRUCTIONS)


def _inj_user(t: str) -> str:
    return (f"'Problem: ' || question || chr(10) || 'Correct solution: ' || correct_execution || chr(10) || chr(10)"
            f" || 'Create a version with the specified error type (' || {t} || '):'")


_FB_USER = ("'Problem: ' || question || chr(10) || 'Step being executed: ' || step_description || chr(10) || chr(10)"
            " || 'CORRECT execution:' || chr(10) || correct_execution || chr(10) || chr(10) || 'STUDENT''S flawed execution:'"
            " || chr(10) || flawed_execution || chr(10) || chr(10)"
            " || 'Provide specific, actionable feedback to help the student correct their error:'")
_STORE_CTES = {
    **_CX_CTES, "pr": _PLAN_ROWS, **_EX_CTES, "rk": _RANKED, "ei": _EI,
    "half": """SELECT problem_id, question, plan FROM (
        SELECT p.problem_id, p.plan, q.question, row_number() OVER (ORDER BY p.problem_id) AS rn, count(*) OVER () AS n
        FROM plans_fx p JOIN (SELECT problem_id FROM pr GROUP BY problem_id HAVING count(*) >= 2) g USING (problem_id)
        JOIN problems_fx q USING (problem_id)) WHERE rn <= n // 2""",
    "var_req": """SELECT *, md5('variation|' || problem_id || '|' || user) AS request_id FROM (SELECT *,
        'Original Plan:' || chr(10) || plan || chr(10) || chr(10) || 'Create a rephrased version:' AS user FROM half)""",
    "err_req": """SELECT *, md5('execution_error|' || problem_id || '|' || pos || '|' || user) AS request_id FROM (SELECT *,
        'Original correct execution:' || chr(10) || execution || chr(10) || chr(10) || 'Create a version with a subtle error:' AS user
        FROM rk WHERE rn <= floor(floor(n_all / 4) * 3 / 10))""",
    "inj_req": f"""SELECT *, md5('error_injection|' || problem_id || '|' || k || '|' || draw || '|' || user) AS request_id
        FROM (SELECT v.problem_id, v.k, v.draw, v.new_error_type, cx.* EXCLUDE (problem_id, k, flawed_execution, feedback),
                {_inj_user('new_error_type')} AS user
              FROM ({_VAR_SQL}) v JOIN cx USING (problem_id, k))""",
    "inj_comp": f"""SELECT *, CASE {H('cinj', 'problem_id', 'k', 'draw')} % 10 WHEN 0 THEN NULL WHEN 1 THEN correct_execution
          WHEN 2 THEN {flawed_sql('correct_execution', f'({_OTHER_SQL})')}
          ELSE {flawed_sql('correct_execution', 'new_error_type')} END AS completion FROM inj_req""",
    "fb_req": f"""SELECT *, md5('feedback|' || problem_id || '|' || k || '|' || draw || '|' || user) AS request_id
        FROM (SELECT *, {_FB_USER} AS user FROM (SELECT * EXCLUDE (request_id, user, completion), completion AS flawed_execution
              FROM inj_comp WHERE completion IS NOT NULL))""",
    "comp": f"""SELECT * FROM (
        SELECT request_id, CASE {H('cvar', 'problem_id')} % 8 WHEN 0 THEN NULL WHEN 1 THEN plan WHEN 2 THEN 'Do it all in one go.'
          ELSE new END AS completion FROM var_req JOIN (SELECT problem_id, string_agg(step_number || '. Bring in ' || q
            || ' more units from line ' || step_number, chr(10) ORDER BY step_number) AS new FROM steps_fx GROUP BY problem_id) USING (problem_id)
        UNION ALL
        SELECT request_id, CASE e WHEN 0 THEN NULL WHEN 1 THEN execution WHEN 2 THEN regexp_replace(execution, '^We add', 'Adding')
          ELSE regexp_replace(execution, '(= |Result: |answer is )(\\d+)', '\\1\\2' || e, 'g') END
        FROM (SELECT *, {H('cerr', 'problem_id', 'pos')} % 10 AS e FROM err_req)
        UNION ALL SELECT request_id, completion FROM inj_comp
        UNION ALL
        SELECT request_id, CASE f WHEN 0 THEN NULL ELSE 'The ' || replace(CASE f WHEN 1 THEN error_type ELSE new_error_type END, '_', ' ')
          || ' in step ' || k || ' is incorrect. You should recalculate it.' END
        FROM (SELECT *, {H('cfb', 'problem_id', 'k', 'draw')} % 8 AS f FROM fb_req)
      ) WHERE completion IS NOT NULL""",
}
_STORE_FIX = ("problems_fx", "plans_fx", "attempts_fx")


def _same(a: str, b: str) -> str:
    norm = lambda x: f"lower({S.strip(f'regexp_replace({x}, {S.q(chr(92) + chr(115) + chr(43))}, {S.q(chr(32))}, {S.q(chr(103))})')})"
    return f"{norm(a)} = {norm(b)}"


def _fits_sql(t: str, a: str, b: str) -> str:
    only = lambda p: f"({a} <> {b} AND regexp_replace({a}, {S.q(p)}, '~', 'g') = regexp_replace({b}, {S.q(p)}, '~', 'g'))"
    n = lambda x: f"len(regexp_extract_all({x}, '\\d+'))"
    return f"""CASE {t} WHEN 'calculation_error' THEN {only(C._DIGITS)} WHEN 'wrong_operation' THEN {only(C._OPERATORS)}
      WHEN 'unit_error' THEN {only(C._LETTERS)} WHEN 'incomplete_step' THEN length({b}) < length({a}) AND {n(b)} < {n(a)}
      ELSE {a} <> {b} AND contains({b}, {a}) END"""


def _equations_sql(t: str) -> str:
    calc = dict(EX.CALC_PATTERNS)
    each = []
    for op, value in (("multiplication", "{0} * {1}"), ("addition", "{0} + {1}"), ("subtraction", "{0} - {1}"), ("division", "{0} / {1}")):
        got = [f"regexp_extract_all({t}, {S.q(calc[op])}, {g})" for g in (1, 2, 3)]
        num = [f"CAST(x[{g}] AS DOUBLE)" for g in (1, 2, 3)]
        each.append(f"len(list_filter(list_zip({', '.join(got)}), lambda x: NOT coalesce(abs({value.format(*num)} - {num[2]}) < {EX.TOLERANCE}, false))) = 0")
    return "(" + " AND ".join(each) + ")"


_OUTCOMES = {
    "variation": f"""SELECT r.*, c.completion, CASE WHEN coalesce(c.completion, '') = '' THEN 'no_completion'
        WHEN {_same('r.plan', 'c.completion')} THEN 'unchanged' WHEN coalesce(s.n, 0) < 2 THEN 'too_few_steps' ELSE 'accepted' END AS outcome
      FROM var_req r LEFT JOIN comp c USING (request_id) LEFT JOIN (SELECT problem_id, count(*) AS n FROM vr GROUP BY problem_id) s USING (problem_id)""",
    "error": f"""SELECT r.*, c.completion, CASE WHEN coalesce(c.completion, '') = '' THEN 'no_completion'
        WHEN {_same('r.execution', 'c.completion')} THEN 'unchanged'
        WHEN {S.last_number('r.execution')} IS NOT DISTINCT FROM {S.last_number('c.completion')} THEN 'same_result'
        WHEN NOT {_equations_sql('r.execution')} THEN 'base_wrong' ELSE 'accepted' END AS outcome
      FROM err_req r LEFT JOIN comp c USING (request_id)""",
    "injection": f"""SELECT r.* EXCLUDE (flawed_execution), flawed_execution, c.completion AS feedback,
        CASE WHEN coalesce(flawed_execution, '') = '' THEN 'no_completion' WHEN {_same('correct_execution', 'flawed_execution')} THEN 'unchanged'
          WHEN NOT {_fits_sql('new_error_type', 'correct_execution', 'flawed_execution')} THEN 'label_mismatch'
          WHEN coalesce(c.completion, '') = '' THEN 'no_feedback'
          WHEN {' OR '.join(f"(new_error_type <> {S.q(t)} AND contains(lower(c.completion), {S.q(t.replace('_', ' '))}))" for t in ERROR_TYPES)}
            THEN 'feedback_mismatch' ELSE 'accepted' END AS outcome
      FROM (SELECT *, md5('feedback|' || problem_id || '|' || k || '|' || draw || '|' || fuser) AS frid FROM (
              SELECT *, {_FB_USER} AS fuser FROM (
                SELECT i.*, c.completion AS flawed_execution FROM inj_req i LEFT JOIN comp c USING (request_id)))) r
      LEFT JOIN comp c ON c.request_id = r.frid""",
}
_AUG_CTES = {**_STORE_CTES, "vplans": "SELECT problem_id, completion AS plan FROM var_req JOIN comp USING (request_id)",
             "vr": S.plan_steps("vplans", "problem_id", "plan"), "varied": _OUTCOMES["variation"], "erred": _OUTCOMES["error"],
             "injected": _OUTCOMES["injection"]}


# ---------------------------------------------------------------------------
# Admission
# ---------------------------------------------------------------------------
def varied_plans(spark, sf) -> DataFrame:
    """Plan variations with ``_rule`` (null: admitted); ``steps`` are those of the completion."""
    got = C.attach(variation_requests(spark, sf), completions_fx(spark, sf, "variation"), by=BY)
    got = PT.with_plan_steps(got, "completion", "steps")
    return got.withColumn("_rule", gates.first_failure(C.variation_rules("plan", "completion", "steps")))


def error_versions(spark, sf) -> DataFrame:
    """Error versions of executions with ``_rule``."""
    got = C.attach(error_requests(spark, sf), completions_fx(spark, sf, "execution_error"), by=BY)
    return got.withColumn("_rule", gates.first_failure(C.error_rules("execution", "completion")))


def flawed_copies(spark, sf) -> DataFrame:
    """New-error copies of critic examples (D7) with the stored flawed text (D1; null: none is stored)."""
    asked = injection_requests(variations(spark, sf).drop("flawed_execution", "feedback"), "new_error_type")
    return _with_flawed(asked, completions_fx(spark, sf, "error_injection"))


def injected_errors(spark, sf) -> DataFrame:
    """New-error copies of critic examples with ``_rule``: D7, then D1 for the flawed text, then D1 for feedback on that text."""
    got = C.attach(feedback_requests(flawed_copies(spark, sf)), completions_fx(spark, sf, "feedback"), "feedback", BY)
    return got.withColumn("_rule", gates.first_failure(
        C.injection_rules("correct_execution", "flawed_execution", "new_error_type", "feedback", ERROR_TYPES)))


@register("completion_admission", with_fixtures("""
SELECT kind, outcome, count(*) AS n FROM (SELECT 'variation' AS kind, outcome FROM varied UNION ALL SELECT 'execution_error', outcome FROM erred
  UNION ALL SELECT 'error_injection', outcome FROM injected) GROUP BY kind, outcome""", *_STORE_FIX, extra=_AUG_CTES))
def completion_admission(spark, sf):
    """D1 and the admission rules: outcomes of the augmentation requests by kind."""
    rows = [df.select(F.lit(kind).alias("kind"), F.coalesce("_rule", F.lit("accepted")).alias("outcome")) for kind, df in (
        ("variation", varied_plans(spark, sf)), ("execution_error", error_versions(spark, sf)), ("error_injection", injected_errors(spark, sf)))]
    return reduce(DataFrame.unionByName, rows).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@register("augment_plans", with_fixtures(
    f"""SELECT * FROM ({_SFT_PLANNER_SQL})
      UNION ALL
      SELECT * REPLACE ({S.q(VARIATION_SOURCE)} AS source) FROM ({_SFT_PLANNER_SQL.replace("FROM pr ", "FROM vr ").replace("JOIN pr ", "JOIN vr ")})
      WHERE problem_id IN (SELECT problem_id FROM varied WHERE outcome = 'accepted')""", *_STORE_FIX, extra=_AUG_CTES))
def augment_plans(spark, sf):
    """Originals plus the admitted rephrasing of each plan of the first half."""
    plans = _plan_examples(spark, sf).where(F.size("steps") >= 2).withColumn("source", F.lit(PLAN_SOURCE))
    varied = varied_plans(spark, sf).where("_rule is null").withColumn("source", F.lit(VARIATION_SOURCE))
    return _sft_planner_rows(spark, sf, plans).unionByName(_sft_planner_rows(spark, sf, varied))


@register("augment_errors", with_fixtures(
    f"""SELECT problem_id, k, 0 AS draw, source, error_type, question, step_description, correct_execution, flawed_execution, feedback FROM cx
      UNION ALL SELECT problem_id, k, draw, '{ERROR_VARIATION}', new_error_type, question, step_description, correct_execution,
        flawed_execution, feedback FROM injected WHERE outcome = 'accepted'""", *_STORE_FIX, extra=_AUG_CTES))
def augment_errors(spark, sf):
    """Originals plus the admitted new-error copies of the first half (two draws): their own flawed text and feedback on it."""
    ex = critic_examples(spark, sf).withColumn("draw", F.lit(0).cast("bigint"))
    v = injected_errors(spark, sf).where("_rule is null").withColumns({"source": F.lit(ERROR_VARIATION), "error_type": F.col("new_error_type")})
    cols = ["problem_id", "k", "draw", "source", "error_type", "question", "step_description", "correct_execution", "flawed_execution", "feedback"]
    return ex.select(*cols).unionByName(v.select(*cols))


def error_examples(spark, sf) -> DataFrame:
    """H9: the admitted error versions, in the columns of the executor examples."""
    e = error_versions(spark, sf).where("_rule is null")
    return e.withColumns({"correct_execution": F.col("execution"), "execution": F.col("completion"), "is_error": F.lit(True),
                          "source": F.lit(ERROR_SOURCE)}).drop("completion", "_rule", *[c for c in REQUEST if c != "problem_id"])


@register("subset_error_examples", with_fixtures(
    "SELECT problem_id, pos, completion AS execution, execution AS correct_execution, true AS is_error FROM erred WHERE outcome = 'accepted'",
    *_STORE_FIX, extra=_AUG_CTES))
def subset_error_examples(spark, sf):
    """H9 (rows)."""
    return error_examples(spark, sf).select("problem_id", "pos", "execution", "correct_execution", "is_error")


@register("executor_mix", with_fixtures(
    f"""SELECT problem_id, pos, {S.q(EXECUTOR_INSTRUCTION)} AS instruction, {_E2_INPUT} AS input, execution AS output,
      CAST(step_number AS BIGINT) AS step_number, context <> '' AS has_context, source, is_error FROM (
      SELECT problem_id, pos, question, step_number, step_description, context, execution, 'base' AS source, false AS is_error FROM ex
      UNION ALL
      SELECT problem_id, pos, question, step_number, step_description, string_split(context, chr(10) || chr(10))[-1], execution,
        '{CONTEXT_VARIATION}', false FROM rk
      WHERE rn <= n_all // 3 AND context <> '' AND len(string_split(context, chr(10) || chr(10))) > 1
      UNION ALL
      SELECT problem_id, pos, question, step_number, step_description, context, completion, '{ERROR_SOURCE}', true
      FROM erred WHERE outcome = 'accepted')""", *_STORE_FIX, extra=_AUG_CTES))
def executor_mix(spark, sf):
    """I4: context variations and error versions, formatted as one executor SFT set."""
    u = context_variations(spark, sf)
    return _sft_exec(u.unionByName(error_examples(spark, sf).select(*u.columns)))


# ---------------------------------------------------------------------------
# E7
# ---------------------------------------------------------------------------
_DRAWN = f"""SELECT problem_id, k, 0 AS draw, question, step_description, correct_execution, flawed_execution, error_type FROM cx
  UNION ALL SELECT problem_id, k, draw, question, step_description, correct_execution, flawed_execution, new_error_type FROM injected"""
_REQ_SQL = f"""
SELECT md5(kind || '|' || problem_id || '|' || CASE WHEN key <> '' THEN key || '|' ELSE '' END || user) AS request_id, problem_id, kind, system, user, max_tokens FROM (
SELECT problem_id, '' AS key, 'solution' AS kind, {S.q(SOLUTION_SYSTEM)} AS system, {S.q(SOLUTION_USER)} || question AS user, 500 AS max_tokens FROM acc
UNION ALL
SELECT problem_id, '', 'plan', {S.q(PLAN_EXTRACT_SYSTEM)},
  'Problem: ' || question || chr(10) || 'Solution: ' || solution || chr(10) || chr(10) || 'Extract a strategic plan:', 300 FROM acc
UNION ALL
SELECT problem_id, '', 'plan_extraction', {S.q(OWN_EXTRACT_SYSTEM)},
  'Problem: ' || question || chr(10) || 'Solution: ' || solution || chr(10) || chr(10) || {S.q(OWN_EXTRACT_TAIL)}, 300 FROM acc
UNION ALL
SELECT problem_id, '', 'variation', {S.q(VARIATION_SYSTEM)}, user, 300 FROM var_req
UNION ALL
SELECT problem_id, CAST(pos AS VARCHAR), 'execution_error', {S.q(ERROR_EXECUTION_SYSTEM)}, user, 400 FROM err_req
UNION ALL
SELECT problem_id, k || '|' || draw, 'error_injection',
  {S.q(INJECTION_SYSTEM_HEAD)} || coalesce(i.instruction, {S.q(DEFAULT_INSTRUCTION)}) || {S.q(INJECTION_SYSTEM_TAIL)}, {_inj_user('error_type')}, 400
FROM drawn LEFT JOIN ei i USING (error_type)
UNION ALL
SELECT problem_id, k || '|' || draw, 'feedback', {S.q(FEEDBACK_SYSTEM)}, {_FB_USER}, 300 FROM drawn WHERE flawed_execution IS NOT NULL
UNION ALL
SELECT problem_id, CAST(pos AS VARCHAR), 'execution', {S.q(EXECUTION_SYSTEM)},
  'Question: ' || question || chr(10) || 'Step to execute: ' || step_description || chr(10)
    || 'Context from previous steps: ' || CASE WHEN context <> '' THEN context ELSE 'None' END || chr(10) || chr(10)
    || 'Based on the reference solution, execute this specific step with detailed work:' || chr(10)
    || 'Reference (for guidance): ' || reference_solution || chr(10) || chr(10) || 'Execution:', 400
FROM exc)"""


@register("generation_requests", with_fixtures(_REQ_SQL, *_STORE_FIX, extra={**_AUG_CTES, "drawn": _DRAWN}))
def generation_requests(spark, sf):
    """The teacher's prompts (solution, both plan extractions, plan variation, error version, error injection, feedback on every
    flawed text, step execution) with an id derived from the prompt."""
    acc = base.accepted_problems(spark, sf)
    extract = lambda tail: _say("Problem: ", "{question}", "\nSolution: ", "{solution}", "\n\n", tail)
    # the prompts ask about the flawed texts alone: feedback that is stored for them is not read
    drawn = critic_examples(spark, sf).withColumn("draw", F.lit(0).cast("bigint")).drop("feedback")
    again = flawed_copies(spark, sf).withColumn("error_type", F.col("new_error_type"))
    drawn = drawn.unionByName(again.select(*drawn.columns))
    ec = exec_candidates(spark, sf).withColumn("shown", F.when(F.col("context") != "", F.col("context")).otherwise(F.lit("None")))
    made = [
        C.with_request(acc, "solution", ["problem_id"], F.lit(SOLUTION_SYSTEM), _say(SOLUTION_USER, "{question}"), 500),
        C.with_request(acc, "plan", ["problem_id"], F.lit(PLAN_EXTRACT_SYSTEM), extract("Extract a strategic plan:"), 300),
        C.with_request(acc, "plan_extraction", ["problem_id"], F.lit(OWN_EXTRACT_SYSTEM), extract(OWN_EXTRACT_TAIL), 300),
        variation_requests(spark, sf), error_requests(spark, sf), injection_requests(drawn),
        feedback_requests(drawn.where("flawed_execution is not null")),
        C.with_request(ec, "execution", ["problem_id", "pos"], F.lit(EXECUTION_SYSTEM), _say(
            "Question: ", "{question}", "\nStep to execute: ", "{step_description}", "\nContext from previous steps: ", "{shown}",
            "\n\nBased on the reference solution, execute this specific step with detailed work:\nReference (for guidance): ",
            "{reference_solution}", "\n\nExecution:"), 400)]
    return reduce(DataFrame.unionByName, [m.select(*REQUEST) for m in made])
