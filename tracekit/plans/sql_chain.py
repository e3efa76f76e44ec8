"""Oracle CTEs for shared intermediate tables (parsed critiques, resolved steps, results)."""

from __future__ import annotations

from tracekit.functions import critique as CR
from tracekit.operators.loop import TIMEOUT_S
from tracekit.plans import sqlfn as S
from tracekit.plans.sql_fixtures import with_fixtures

STATUS = "'(?i)STATUS:\\s*(CORRECT|INCORRECT)'"


def is_correct(raw: str) -> str:
    lr = f"lower({raw})"
    return (f"CASE WHEN regexp_matches({raw}, {STATUS}) THEN upper(regexp_extract({raw}, {STATUS}, 1)) = 'CORRECT' "
            f"ELSE {S.count_present(lr, CR.CORRECT_WORDS)} > {S.count_present(lr, CR.INCORRECT_WORDS)} END")


def error_types(raw: str, correct: str) -> str:
    lr = f"lower({raw})"
    items = ", ".join(f"CASE WHEN regexp_matches({lr}, {S.q(p)}) THEN {S.q(n)} END" for p, n in CR.ERROR_PATTERNS)
    return f"CASE WHEN {correct} THEN CAST([] AS VARCHAR[]) ELSE list_filter([{items}], lambda x: x IS NOT NULL) END"


def feedback_section(raw: str) -> str:
    # FEEDBACK:\s*(.+?)$ with DOTALL: everything after the first FEEDBACK: label
    return S.strip(f"regexp_extract({raw}, '(?is)FEEDBACK:\\s*(.+)$', 1)")


def reasoning_section(raw: str) -> str:
    # REASONING:\s*(.+?)(?=FEEDBACK:|$): cut the tail at the first FEEDBACK: label
    body = f"regexp_extract({raw}, '(?is)REASONING:\\s*(.+)$', 1)"
    return S.strip(f"regexp_replace({body}, '(?is)FEEDBACK:.*$', '')")


VERDICTS = f"""
SELECT a.*, c.critique, {is_correct('c.critique')} AS is_correct
FROM attempts_fx a JOIN critiques_fx c USING (problem_id, step_number, attempt)"""

RESOLVED = """
SELECT problem_id, step_number, max(attempt) AS chosen_attempt, count(*) AS total_attempts,
  count(*) - 1 AS corrections, arg_max(is_correct, attempt) AS success,
  arg_max(execution, attempt) AS final_execution, CAST(sum(duration_s) AS BIGINT) AS step_seconds
FROM (
  SELECT *, coalesce(sum(CAST(is_correct AS INTEGER)) OVER (PARTITION BY problem_id, step_number ORDER BY attempt
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_ok
  FROM verdicts
) WHERE prior_ok = 0 GROUP BY problem_id, step_number"""

CUT = f"""
SELECT *, elapsed_before <= {TIMEOUT_S} AS kept FROM (
  SELECT *, coalesce(sum(step_seconds) OVER (PARTITION BY problem_id ORDER BY step_number
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS elapsed_before,
         count(*) OVER (PARTITION BY problem_id) AS n_steps
  FROM resolved
)"""

SOLVED = f"""
SELECT problem_id, n_steps, steps_run, total_attempts, corrections, successful_corrections, seconds, executions,
  final_answer, error_message,
  (final_answer IS NOT NULL AND final_answer <> '' AND error_message IS NULL) AS success
FROM (
  SELECT *, {S.final_answer_text('executions')} AS final_answer,
    CASE WHEN steps_run < n_steps THEN 'Timeout after {TIMEOUT_S}s' END AS error_message
  FROM (
    SELECT problem_id, max(n_steps) AS n_steps, count(*) FILTER (WHERE kept) AS steps_run,
      CAST(coalesce(sum(total_attempts) FILTER (WHERE kept), 0) AS BIGINT) AS total_attempts,
      CAST(coalesce(sum(corrections) FILTER (WHERE kept), 0) AS BIGINT) AS corrections,
      CAST(count(*) FILTER (WHERE kept AND corrections > 0 AND success) AS BIGINT) AS successful_corrections,
      CAST(coalesce(sum(step_seconds) FILTER (WHERE kept), 0) AS BIGINT) AS seconds,
      string_agg(final_execution, chr(10) ORDER BY step_number) FILTER (WHERE kept) AS executions
    FROM cut GROUP BY problem_id
  )
)"""

TRUTH = f"""
SELECT problem_id, {S.ground_truth('answer')} AS ground_truth FROM problems_fx"""

CHAIN = {"verdicts": VERDICTS, "resolved": RESOLVED, "cut": CUT, "solved": SOLVED}


def chain_sql(select: str, upto: str = "solved", extra: dict[str, str] | None = None,
              fixtures: tuple[str, ...] = ()) -> str:
    """Oracle SQL over the refinement chain up to ``upto``, then ``extra`` CTEs, then ``select``."""
    names = list(CHAIN)
    ctes = {n: CHAIN[n] for n in names[: names.index(upto) + 1]}
    ctes.update(extra or {})
    return with_fixtures(select, "attempts_fx", "critiques_fx", *fixtures, extra=ctes)
