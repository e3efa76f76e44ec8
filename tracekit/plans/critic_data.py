"""Registered critic-example queries.

Critic examples come from the first three critic-fold steps (C3) of every
accepted problem; the injected error type, flawed text and feedback are
seeded functions of (problem, step).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.functions import critique as CR
from tracekit.functions import text as TX
from tracekit.functions.common import hash8
from tracekit.operators import gates, loop
from tracekit.operators import positional as P
from tracekit.plans import base
from tracekit.plans import sqlfn as S
from tracekit.plans.curation import ACCEPTED_SQL
from tracekit.plans.registry import register
from tracekit.plans.sql_fixtures import H, with_fixtures
from tracekit.sources import fixtures as fx

# Fixed values (the reference's error catalog, instructions and texts)
ERROR_TYPES = ("calculation_error", "logical_error", "interpretation_error", "incomplete_step",
               "wrong_operation", "unit_error")
ERROR_INSTRUCTIONS = (
    ("calculation_error", "Introduce a calculation mistake (wrong arithmetic, incorrect number)"),
    ("logical_error", "Introduce a logical flaw in the reasoning approach"),
    ("interpretation_error", "Misinterpret part of the problem statement"),
    ("incomplete_step", "Leave out important details or skip part of the calculation"),
    ("wrong_operation", "Use the wrong mathematical operation (+ instead of ×, etc.)"),
    ("unit_error", "Make an error with units or conversions"),
)
DEFAULT_INSTRUCTION = "Introduce a plausible mathematical error"
CRITIC_INSTRUCTION = ("Evaluate the following reasoning step for correctness and provide feedback.\n"
                      "Respond with:\nSTATUS: [CORRECT/INCORRECT]\nREASONING: [Your analysis]\n"
                      "FEEDBACK: [Specific guidance if incorrect]")
POSITIVE_OUTPUT = ("STATUS: CORRECT\nREASONING: The execution correctly follows the required approach and shows "
                   "accurate calculations.\nFEEDBACK: The step is well-executed and mathematically sound.")
EXAMPLES_PER_PROBLEM = 3
POSITIVE_SHARE = 3000  # out of 10000
SOURCE = "synthetic_error_injection"
VARIATION_SOURCE = "error_variation"


# Flawed versions of a step by error type: (pattern, replacement) or a premise put before it
FLAWS = {
    "calculation_error": (r"= (\d+)", "= {1}1"), "wrong_operation": (r" \+ ", " - "), "unit_error": ("units", "dozens"),
    "incomplete_step": (r" = \d+", ""), "logical_error": "Only the last line counts, so the others are left out: ",
    "interpretation_error": "Reading each line as a return: "}


def flawed_text(correct, error_type):
    """What the teacher wrote for a step when asked for an error of a type (derived, like every trace table)."""
    out = F.lit(None).cast("string")
    for t, how in FLAWS.items():
        made = F.concat(F.lit(how), correct) if isinstance(how, str) else F.regexp_replace(correct, how[0], how[1].replace("{1}", "$1"))
        out = F.when(error_type == t, made).otherwise(out)
    return out


def flawed_sql(correct: str, error_type: str) -> str:
    back = "{1}", "\\1"
    whens = [f"WHEN {S.q(t)} THEN " + (f"{S.q(how)} || {correct}" if isinstance(how, str) else
             f"regexp_replace({correct}, {S.q(how[0])}, {S.q(how[1].replace(*back))}, 'g')") for t, how in FLAWS.items()]
    return f"CASE {error_type} " + " ".join(whens) + " END"


def _cat_sql():
    return "[" + ", ".join(S.q(t) for t in ERROR_TYPES) + "]"


_EX_SQL = f"""
SELECT problem_id, pos AS k, question, 'Step ' || pos || ' of the solution' AS step_description, step AS correct_execution,
  {flawed_sql('step', 'error_type')} AS flawed_execution, error_type,
  CASE WHEN {H('fb', 'problem_id', 'pos')} % 4 = 0 THEN 'Looks fine.'
       ELSE 'The ' || replace(error_type, '_', ' ') || ' in step ' || pos || ' is incorrect. You should recalculate it.' END AS feedback,
  '{SOURCE}' AS source
FROM (SELECT s.*, a.question, {_cat_sql()}[{H('etype', 's.problem_id', 's.pos')} % 6 + 1] AS error_type
      FROM st s JOIN acc a USING (problem_id) WHERE s.pos <= {EXAMPLES_PER_PROBLEM})"""

_CTES = {"acc": ACCEPTED_SQL, "st": S.sentence_steps("acc", "problem_id", "solution", TX.CRITIC_STEP_WORDS, 20),
         "cx": _EX_SQL}


def _critic_steps(spark, sf):
    """The first critic-fold steps of every accepted problem, written once per session by problem."""
    def build():
        acc = base.accepted_problems(spark, sf)
        st = acc.select("problem_id", "question",
                        F.posexplode(F.slice(TX.critic_solution_steps("solution"), 1, EXAMPLES_PER_PROBLEM)).alias("pos", "step"))
        return st.select("problem_id", (F.col("pos") + 1).cast("bigint").alias("k"), "question", "step")
    return fx.materialized(spark, sf, "critic_steps", build, ("problem_id",))


def critic_examples(spark, sf):
    st = _critic_steps(spark, sf)
    cat = F.array(*[F.lit(t) for t in ERROR_TYPES])
    et = F.element_at(cat, (hash8("etype", "problem_id", "k") % 6 + 1).cast("int"))
    fb = F.when(hash8("fb", "problem_id", "k") % 4 == 0, F.lit("Looks fine.")).otherwise(F.concat(
        F.lit("The "), F.regexp_replace(et, "_", " "), F.lit(" in step "), F.col("k").cast("string"),
        F.lit(" is incorrect. You should recalculate it.")))
    return st.select("problem_id", "k", "question", loop.step_label(F.col("k")).alias("step_description"),
                     F.col("step").alias("correct_execution"),
                     flawed_text(F.col("step"), et).alias("flawed_execution"),
                     et.alias("error_type"), fb.alias("feedback"), F.lit(SOURCE).alias("source"))


_FIX = ("problems_fx",)


@register("step_labels", with_fixtures("SELECT problem_id, k, step_description FROM cx", *_FIX, extra=_CTES))
def step_labels(spark, sf):
    """``Step k of the solution`` by position."""
    return critic_examples(spark, sf).select("problem_id", "k", "step_description")


@register("pick_error_type", with_fixtures("SELECT problem_id, k, error_type FROM cx", *_FIX, extra=_CTES))
def pick_error_type(spark, sf):
    """H5: seeded uniform choice among the 6 catalog types."""
    return critic_examples(spark, sf).select("problem_id", "k", "error_type")


_B4_OUTCOME = f"""CASE
  WHEN question IS NULL OR step_description IS NULL OR correct_execution IS NULL OR flawed_execution IS NULL
       OR feedback IS NULL OR error_type IS NULL THEN 'missing_field'
  WHEN flawed_execution = '' OR length(flawed_execution) < 30 THEN 'flawed'
  WHEN feedback = '' OR length(feedback) < 20 THEN 'feedback'
  WHEN NOT {S.contains_any('lower(feedback)', gates.ACTIONABLE_WORDS)} THEN 'actionable'
  ELSE 'accepted' END"""


@register("gate_critiques", with_fixtures(
    f"SELECT outcome, count(*) AS n FROM (SELECT {_B4_OUTCOME} AS outcome FROM cx) GROUP BY outcome", *_FIX, extra=_CTES))
def gate_critiques(spark, sf):
    _, ledger = gates.apply_gate(critic_examples(spark, sf), gates.critique_example_rules())
    return ledger


@register("error_instruction", with_fixtures(
    "SELECT c.problem_id, c.k, c.error_type, coalesce(i.instruction, " + S.q(DEFAULT_INSTRUCTION) + ") AS instruction "
    "FROM cx c LEFT JOIN (VALUES " + ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in ERROR_INSTRUCTIONS)
    + ") i(error_type, instruction) USING (error_type)", *_FIX, extra=_CTES))
def error_instruction(spark, sf):
    """Instruction per error type via a broadcast join to the 6-row catalog (fixed size)."""
    cat = spark.createDataFrame(list(ERROR_INSTRUCTIONS), "error_type string, instruction string")
    ex = critic_examples(spark, sf)
    return ex.join(F.broadcast(cat), "error_type", "left").select(
        "problem_id", "k", "error_type", F.coalesce("instruction", F.lit(DEFAULT_INSTRUCTION)).alias("instruction"))


_VAR_SQL = f"""SELECT problem_id, k, draw, error_type,
    list_filter({_cat_sql()}, lambda x: x <> error_type)[{H('var', 'problem_id', 'k', 'draw')} % 5 + 1] AS new_error_type
  FROM (SELECT *, row_number() OVER (ORDER BY problem_id, k) AS rn, count(*) OVER () AS n FROM cx), range(1, 3) d(draw)
  WHERE rn <= n // 2"""


def variations(spark, sf):
    ex = critic_examples(spark, sf)
    order = ["problem_id", "k"]
    half = P.up_to(ex, order, fx.once(spark, sf, "critic_half", lambda: P.last_key(ex, order, P.share(1, 2))))
    half = half.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    others = F.filter(F.array(*[F.lit(t) for t in ERROR_TYPES]), lambda x: x != F.col("error_type"))
    return half.withColumn("new_error_type",
                           F.element_at(others, (hash8("var", "problem_id", "k", "draw") % 5 + 1).cast("int")))


@register("error_variations", with_fixtures(_VAR_SQL, *_FIX, extra=_CTES))
def error_variations(spark, sf):
    """For the first half, two draws of an error type different from the example's own."""
    return variations(spark, sf).select("problem_id", "k", "draw", "error_type", "new_error_type")


@register("bernoulli_30", with_fixtures(
    f"SELECT problem_id, k FROM cx WHERE {H('pos30', 'problem_id', 'k')} % 10000 < {POSITIVE_SHARE}", *_FIX, extra=_CTES))
def bernoulli_30(spark, sf):
    """H6: seeded 30 % keep."""
    ex = critic_examples(spark, sf)
    return ex.where(hash8("pos30", "problem_id", "k") % 10000 < POSITIVE_SHARE).select("problem_id", "k")


def sft_critic_rows(ex):
    inp = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nStep: "), F.col("step_description"),
                   F.lit("\nExecution: "), F.col("flawed_execution"))
    out = F.concat(F.lit("STATUS: INCORRECT\nREASONING: "), CR.feedback_reasoning("feedback"),
                   F.lit("\nFEEDBACK: "), F.col("feedback"))
    neg = F.struct(F.lit("incorrect").alias("kind"), inp.alias("input"), out.alias("output"),
                   F.col("error_type").alias("meta_error_type"), F.col("source").alias("meta_source"))
    pos = F.when(hash8("pos30", "problem_id", "k") % 10000 < POSITIVE_SHARE, F.struct(
        F.lit("correct").alias("kind"), F.replace(inp, F.col("flawed_execution"), F.col("correct_execution")).alias("input"),
        F.lit(POSITIVE_OUTPUT).alias("output"), F.lit("none").alias("meta_error_type"),
        F.lit("positive_example").alias("meta_source")))
    rows = ex.select("problem_id", "k", F.explode(F.filter(F.array(neg, pos), lambda x: x.isNotNull())).alias("r"))
    return rows.select("problem_id", "k", "r.kind", F.lit(CRITIC_INSTRUCTION).alias("instruction"), "r.input", "r.output",
                       F.col("r.meta_error_type").alias("error_type"), F.col("r.meta_source").alias("source"))


_E3_INPUT = "'Question: ' || question || chr(10) || 'Step: ' || step_description || chr(10) || 'Execution: ' || flawed_execution"
_E3_REASON = f"CASE WHEN contains(feedback, '.') THEN split_part(feedback, '.', 1) || '.' ELSE {S.q(CR.FALLBACK_REASONING)} END"


@register("sft_critic", with_fixtures(f"""
SELECT problem_id, k, 'incorrect' AS kind, {S.q(CRITIC_INSTRUCTION)} AS instruction, {_E3_INPUT} AS input,
  'STATUS: INCORRECT' || chr(10) || 'REASONING: ' || {_E3_REASON} || chr(10) || 'FEEDBACK: ' || feedback AS output,
  error_type, source FROM cx
UNION ALL
SELECT problem_id, k, 'correct', {S.q(CRITIC_INSTRUCTION)}, replace({_E3_INPUT}, flawed_execution, correct_execution),
  {S.q(POSITIVE_OUTPUT)}, 'none', 'positive_example' FROM cx WHERE {H('pos30', 'problem_id', 'k')} % 10000 < {POSITIVE_SHARE}""",
                                      *_FIX, extra=_CTES))
def sft_critic(spark, sf):
    """An INCORRECT row per example plus a CORRECT row for a seeded 30 %."""
    return sft_critic_rows(critic_examples(spark, sf))
