"""The derived fixtures as DuckDB SQL CTEs, for the oracle side of every key.

Mirrors ``tracekit.sources.fixtures`` row for row. ``with_fixtures(sql, ...)``
prefixes a query with the CTEs it names (and their dependencies).
"""

from __future__ import annotations


def H(tag: str, *keys: str) -> str:
    args = ", ".join([f"'{tag}'"] + list(keys))
    return f"('0x' || substr(md5(concat_ws('|', {args})), 1, 8))::BIGINT"


_K3 = ("problem_id", "step_number", "attempt")

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "steps_fx": ("""
SELECT problem_id, step_number, n_steps, run - q AS prev, q, run FROM (
  SELECT l_orderkey AS problem_id, CAST(l_quantity AS BIGINT) AS q,
    row_number() OVER w AS step_number,
    count(*) OVER (PARTITION BY l_orderkey) AS n_steps,
    sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))
)""", ()),
    "problems_fx": ("""
SELECT problem_id,
  CASE WHEN problem_id % 10 = 9 THEN 'Sum order ' || problem_id || '?'
       WHEN problem_id % 3 = 0 THEN 'Order ' || problem_id || ' ships ' || n || ' lines. How many units are shipped in total?'
       WHEN problem_id % 3 = 1 THEN 'A store sells order ' || problem_id || ' in ' || n || ' lines. What is the sum of units per order?'
       ELSE 'Order ' || problem_id || ' has ' || n || ' lines each week. How many units does it cost to ship?' END AS question,
  CASE WHEN problem_id % 10 = 8 THEN body
       WHEN problem_id % 10 = 7 THEN body || ' #### 1,' || lpad(CAST(total AS VARCHAR), 3, '0')
       ELSE body || ' #### ' || total END AS answer
FROM (
  SELECT problem_id, count(*) AS n, CAST(sum(q) AS BIGINT) AS total,
    string_agg('Line ' || step_number || ' adds ' || prev || ' + ' || q || ' = ' || run || ' units.', ' ' ORDER BY step_number) AS body
  FROM steps_fx GROUP BY problem_id
)""", ("steps_fx",)),
    "plans_fx": ("""
SELECT problem_id,
  CASE WHEN problem_id % 5 = 4 THEN string_agg(line, ' ' ORDER BY step_number)
       ELSE string_agg(line, chr(10) ORDER BY step_number) END AS plan
FROM (
  SELECT problem_id, step_number,
    CASE problem_id % 5
      WHEN 0 THEN step_number || '. ' || t
      WHEN 1 THEN step_number || ') ' || t
      WHEN 2 THEN 'Step ' || step_number || ': ' || t
      WHEN 3 THEN '- ' || t
      ELSE t || '.' END AS line
  FROM (SELECT *, CASE WHEN problem_id % 7 = 0 THEN 'Calculate line ' ELSE 'Add line ' END || step_number || ' with ' || q || ' units to the total'
      || CASE WHEN problem_id % 11 = 0 THEN ' and write the running total down before going on with the line after it' ELSE '' END AS t FROM steps_fx)
) GROUP BY problem_id""", ("steps_fx",)),
    "attempts_fx": (f"""
SELECT problem_id, step_number, n_steps, attempt, prev, q, run, shown,
  CASE WHEN form = 2 THEN said || '.'
       WHEN form = 3 THEN 'We put ' || q || ' items to the ' || prev || ' items and hold ' || shown || ' items'
       WHEN style = 1 THEN 'Sum: ' || shown
       WHEN style = 4 THEN 'The earlier total is carried on to the next line.'
       ELSE CASE style WHEN 0 THEN 'Carry over ' || prev || '.0. ' WHEN 2 THEN 'Check by ' || shown || ' - ' || q || ' = ' || prev || '. '
              WHEN 3 THEN 'Two lots: ' || q || ' × 2 = ' || (2 * q) || ', halved ' || (2 * q) || ' ÷ 2 = ' || q || '. ' ELSE '' END
         || said || chr(10) || 'Result: ' || shown || ' units so far'
         || CASE WHEN step_number <> n_steps THEN ''
              WHEN form = 0 THEN chr(10) || '#### ' || shown WHEN form = 1 THEN chr(10) || 'All in all ' || shown || ' items'
              WHEN form = 4 THEN chr(10) || 'It makes $' || shown WHEN form = 5 THEN chr(10) || 'Final answer: ' || shown
              WHEN form = 6 THEN chr(10) || 'The total is ' || shown ELSE chr(10) || 'The answer is ' || shown END END AS execution,
  wrong, CAST((5 + {H('dur', *_K3)} % 20) * CASE WHEN {H('slow', 'problem_id')} % 20 = 0 THEN 6 ELSE 1 END AS BIGINT) AS duration_s
FROM (SELECT *, 'We add ' || q || ' units to ' || prev || ': ' || prev || ' + ' || q || ' = ' || shown AS said,
    {H('style', *_K3)} % 20 AS style, {H('form', 'problem_id')} % 12 AS form FROM (
  SELECT *, run + CAST(wrong AS BIGINT) AS shown FROM (
    SELECT *, ({H('wrong', *_K3)} % 10) < 3 AS wrong
    FROM (SELECT s.*, CAST(a.attempt AS BIGINT) AS attempt FROM steps_fx s, range(1, 4) a(attempt))
  )
))""", ("steps_fx",)),
    "critiques_fx": (f"""
SELECT problem_id, step_number, attempt,
  CASE WHEN structured AND says_correct THEN
         'STATUS: CORRECT' || chr(10) || 'REASONING: The sum ' || prev || ' + ' || q || ' = ' || shown || ' is accurate.'
       WHEN structured THEN
         'STATUS: INCORRECT' || chr(10) || 'REASONING: The calculation ' || prev || ' + ' || q || ' should be ' || run
         || ', not ' || shown || '.' || chr(10) || 'FEEDBACK: The arithmetic is incorrect. You should recalculate '
         || prev || ' + ' || q || ' = ' || run || ' and fix the result.'
       WHEN says_correct THEN 'Looks right to me, the work is clearly accurate.'
       ELSE 'There is a mistake here; possibly the total should be ' || run || '.' END AS critique
FROM (
  SELECT *, (NOT wrong) <> (({H('flip', *_K3)} % 10) = 9) AS says_correct,
         ({H('form', *_K3)} % 4) <> 2 AS structured
  FROM attempts_fx
)""", ("attempts_fx",)),
    "request_log_fx": ("""
SELECT request_id, attempt, ts, event_id, ok,
  CASE WHEN NOT ok THEN (['Rate limit exceeded', 'Request timeout after 60s', 'Failed to parse response JSON',
                          'Upstream generate failure'])[event_id % 4 + 1] END AS error_text,
  CASE WHEN ok THEN 'response ' || event_id END AS response,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  (['planner', 'executor', 'critic'])[user_id % 3 + 1] AS module
FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS attempt FROM (
    SELECT *, event_type <> 'error' AS ok,
      user_id || '-' || CAST(year(ts) * 1000000 + month(ts) * 10000 + day(ts) * 100 + hour(ts) AS BIGINT) AS request_id
    FROM events
  )
)""", ()),
    "pairs_fx": ("""
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""", ()),
    "variants_fx": (f"""
SELECT item_id AS prompt_id, text AS output_a,
  CASE WHEN {H('variant', 'item_id')} % 2 = 1 THEN text || ' (revised)' ELSE text END AS output_b
FROM benchmark""", ()),
    "flags_fx": ("""
SELECT d.doc_id, d.source, l.quality = 0 AS actual, d.n_chars < 2000 AS predicted
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""", ()),
}


# CTEs that several others read: computed once
STORED = {"acc", "st", "cx", "pr", "ex", "exc", "rk", "comp", "inj_req", "inj_comp", "fb_req", "err_req", "var_req", "injected"}


def with_fixtures(sql: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named fixture CTEs (dependencies first), then ``extra`` CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]}\n)" for n in order]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS {'MATERIALIZED ' if k in STORED else ''}({v}\n)")
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql
