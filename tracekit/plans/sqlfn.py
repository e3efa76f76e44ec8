"""DuckDB SQL snippets mirroring ``tracekit.functions`` (oracle side only).

RE2 has no look-around, so rules written with it in Spark are restated here
as line/marker splits; each helper documents the rule it mirrors.
"""

from __future__ import annotations

from tracekit.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def count_present(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INTEGER)" for w in words) + ")"


def strict_double(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') THEN TRY_CAST({x} AS DOUBLE) END"


def solution_text(a: str) -> str:
    return f"CASE WHEN contains({a}, '####') THEN {strip(f'regexp_extract({a}, {q(chr(40) + '?s' + chr(41) + '^(.*)####')}, 1)')} ELSE {a} END"


def final_numeric_answer(a: str) -> str:
    tail = strip(f"regexp_replace({strip(f'string_split({a}, {q(chr(35) * 4)})[-1]')}, '[,$]', '', 'g')")
    return f"CASE WHEN contains({a}, '####') THEN {strict_double(tail)} END"


def _nz(x: str) -> str:
    return f"nullif({x}, '')"


def extract_answer(t: str) -> str:
    cf = f"regexp_replace({t}, '(\\d),(\\d)', '\\1\\2', 'g')"
    lt = f"lower({cf})"
    parts = [f"TRY_CAST({_nz(f'regexp_extract({cf}, {q(T.ANSWER_MARKER)}, 1)')} AS DOUBLE)"]
    parts += [f"TRY_CAST({_nz(f'regexp_extract({lt}, {q(p)}, 1)')} AS DOUBLE)" for p in T.ANSWER_PHRASES]
    parts.append(f"TRY_CAST(regexp_extract_all({cf}, '([+-]?\\d+(?:\\.\\d+)?)', 1)[-1] AS DOUBLE)")
    return "coalesce(" + ", ".join(parts) + ")"


def answer_strategy(t: str) -> str:
    cf = f"regexp_replace({t}, '(\\d),(\\d)', '\\1\\2', 'g')"
    lt = f"lower({cf})"
    whens = [f"WHEN regexp_matches({cf}, {q(T.ANSWER_MARKER)}) THEN 'marker'"]
    whens += [f"WHEN regexp_matches({lt}, {q(p)}) THEN 'phrase{i}'" for i, p in enumerate(T.ANSWER_PHRASES, 1)]
    whens.append(f"WHEN regexp_matches({cf}, '[+-]?\\d+(?:\\.\\d+)?') THEN 'last_number'")
    return "CASE " + " ".join(whens) + " ELSE 'none' END"


def ground_truth(a: str) -> str:
    return f"TRY_CAST({_nz(f'regexp_extract({a}, {q(T.ANSWER_MARKER)}, 1)')} AS DOUBLE)"


def final_answer_text(j: str) -> str:
    fams = [f"regexp_extract_all({j}, {q('(?i)' + p)}, 1)[-1]" for p in T.FINAL_ANSWER_FAMILIES]
    last = f"regexp_extract_all({j}, '(\\d+(?:\\.\\d+)?)', 1)[-1]"
    return f"CASE WHEN {j} IS NOT NULL THEN coalesce({', '.join(fams)}, {last}, {q(T.FALLBACK_ANSWER)}) END"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda s: s <> ''))"


def sentence_steps(src: str, key: str, text: str, words, min_len: int) -> str:
    """Rows (key, pos, step) of the C2/C3 fold, as unnest + running sum + string_agg."""
    return f"""
SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY sid) AS BIGINT) AS pos, step FROM (
  SELECT {key}, sid, string_agg(sn, ' ' ORDER BY idx) AS step FROM (
    SELECT {key}, idx, sn, sum(CAST(opens AND idx > first_idx AS INTEGER))
         OVER (PARTITION BY {key} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
    FROM (
      SELECT *, min(idx) OVER (PARTITION BY {key}) AS first_idx,
        (regexp_matches(sn, {q(T.CALCULATION)}) OR {contains_any('lower(sn)', words)}) AS opens
      FROM (
        SELECT {key}, idx, {strip('raw')} AS sn FROM (
          SELECT {key}, unnest(parts) AS raw, generate_subscripts(parts, 1) AS idx
          FROM (SELECT {key}, regexp_split_to_array({text}, '[.!?]+') AS parts FROM {src})
        )
      ) WHERE sn <> ''
    )
  ) GROUP BY {key}, sid
) WHERE length(step) > {min_len}"""


def lines(src: str, key: str, text: str) -> str:
    """(key, li, line) rows of ``text`` split on newlines (1-based li)."""
    return f"""SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) AS li
FROM (SELECT {key}, string_split({text}, chr(10)) AS ls FROM {src})"""


def plan_steps(src: str, key: str, text: str, min_len: int | None = 5, fallback: str | None = "len10") -> str:
    """(key, pos, step_number, description, format) of C5/C6/C7 for one-step-per-line plans.

    Restates the look-ahead patterns line by line (RE2 has no look-ahead): the
    first family with any line match wins; its descriptions are filtered by
    length; the fallback keeps long (or non-'Plan:') lines with bullets removed.
    """
    flt = f"AND length(description) > {min_len}" if min_len is not None else ""
    fam = f"""
    SELECT {key}, li, fam, TRY_CAST(num AS INTEGER) AS step_number, {strip('d')} AS description FROM (
      SELECT {key}, li, 1 AS fam, regexp_extract(line, '(\\d+)\\.\\s*(.*)$', 1) AS num,
             regexp_extract(line, '(\\d+)\\.\\s*(.*)$', 2) AS d FROM l WHERE regexp_matches(line, '\\d+\\.')
      UNION ALL
      SELECT {key}, li, 2, regexp_extract(line, '(\\d+)\\)\\s*(.*)$', 1), regexp_extract(line, '(\\d+)\\)\\s*(.*)$', 2)
        FROM l WHERE regexp_matches(line, '\\d+\\)')
      UNION ALL
      SELECT {key}, li, 3, regexp_extract(line, '(?i)Step\\s+(\\d+):?\\s*(.*)$', 1),
             regexp_extract(line, '(?i)Step\\s+(\\d+):?\\s*(.*)$', 2)
        FROM l WHERE regexp_matches(line, '(?i)Step\\s+\\d+'))"""
    if fallback == "len10":
        fb_keep = "length(sl) > 10"
    else:
        fb_keep = "sl <> '' AND NOT starts_with(sl, 'Plan:')"
    fb = f"""
    SELECT {key}, li, 9 AS fam, CAST(row_number() OVER (PARTITION BY {key} ORDER BY li) AS INTEGER) AS step_number,
      c AS description FROM (
      SELECT {key}, li, regexp_replace(regexp_replace(sl, '^\\d+[\\.\\)]\\s*', ''), '^[-\\*]\\s*', '') AS c
      FROM (SELECT {key}, li, {strip('line')} AS sl FROM l2) WHERE {fb_keep}
    ) WHERE c <> ''"""
    return f"""
SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY li) AS BIGINT) AS pos, step_number, description,
  CASE fam WHEN 1 THEN 'dot' WHEN 2 THEN 'paren' WHEN 3 THEN 'step' ELSE 'fallback' END AS format
FROM (
  WITH l AS ({lines(src, key, text)}),
       l2 AS ({lines(f"(SELECT {key}, {strip(text)} AS t FROM {src})", key, "t")}),
       f AS ({fam}),
       w AS (SELECT {key}, min(fam) AS fam FROM f GROUP BY {key}),
       chosen AS (SELECT f.* FROM f JOIN w USING ({key}, fam) WHERE true {flt})
  SELECT * FROM chosen
  {"" if fallback is None else f"UNION ALL SELECT * FROM ({fb}) WHERE {key} NOT IN (SELECT {key} FROM chosen)"}
)"""


def eval_step_count(src: str, key: str, text: str) -> str:
    """(key, n_eval_steps) of C8: starts = first line beginning with digits, then lines
    beginning with digits + '.'; without starts, non-empty pieces of a split on '.' (at most 6)."""
    return f"""
SELECT s.{key}, CAST(coalesce(nullif(st.n, 0), pc.n) AS BIGINT) AS n_eval_steps FROM {src} s
LEFT JOIN (
  SELECT {key}, count(*) FILTER (WHERE li = first_any OR (li > first_any AND is_num)) AS n FROM (
    SELECT *, min(li) FILTER (WHERE is_any) OVER (PARTITION BY {key}) AS first_any FROM (
      SELECT {key}, li, regexp_matches(line, '^\\s*\\d+\\.') AS is_num, regexp_matches(line, '^\\s*\\d+') AS is_any
      FROM ({lines(src, key, text)})))
  GROUP BY {key}) st USING ({key})
LEFT JOIN (
  SELECT {key}, least(len(list_filter(list_transform(string_split({text}, '.'), lambda x: {strip('x')}), lambda x: x <> '')), 6) AS n
  FROM {src}) pc USING ({key})"""


def tfidf_cosine(src: str, key: str, a: str, b: str) -> str:
    """(key, coverage): two-document TF-IDF cosine (smooth idf, N = 2, L2 norm); 0.5 on empty vocabulary."""
    tok = "'\\b\\w\\w+\\b'"
    return f"""
SELECT s.{key}, CASE WHEN v.{key} IS NULL THEN 0.5 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (sqrt(na) * sqrt(nb)) END AS coverage
FROM {src} s LEFT JOIN (
  SELECT {key}, sum(wa * wb) AS dot, sum(wa * wa) AS na, sum(wb * wb) AS nb FROM (
    SELECT {key}, term, ta * idf AS wa, tb * idf AS wb FROM (
      SELECT {key}, term, CAST(sum(da) AS DOUBLE) AS ta, CAST(sum(db) AS DOUBLE) AS tb,
        CASE WHEN sum(da) > 0 AND sum(db) > 0 THEN 1.0 ELSE ln(1.5) + 1.0 END AS idf
      FROM (
        SELECT {key}, unnest(regexp_extract_all(lower({a}), {tok}, 0)) AS term, 1 AS da, 0 AS db FROM {src}
        UNION ALL
        SELECT {key}, unnest(regexp_extract_all(lower({b}), {tok}, 0)), 0, 1 FROM {src}
      ) GROUP BY {key}, term))
  GROUP BY {key}) v USING ({key})"""


def py_float_text(s: str) -> str:
    """Python str(float(s)) for a plain decimal string (mirror of common.py_float_text)."""
    body = f"regexp_replace({s}, '^[+-]', '')"
    ip = f"regexp_replace(regexp_extract({body}, '^(\\d+)', 1), '^0+(\\d)', '\\1')"
    fp = f"regexp_replace(regexp_extract({body}, '\\.(\\d+)$', 1), '0+$', '')"
    txt = f"({ip} || '.' || CASE WHEN {fp} = '' THEN '0' ELSE {fp} END)"
    return f"(CASE WHEN starts_with({s}, '-') THEN '-' || {txt} ELSE {txt} END)"


def context_used(context: str, execution: str) -> str:
    nums = f"regexp_extract_all({context}, '([+-]?\\d+(?:\\.\\d+)?)', 1)"
    return f"coalesce(len(list_filter({nums}, lambda n: contains({execution}, {py_float_text('n')}))) > 0, false)"


def last_number(t: str) -> str:
    return f"TRY_CAST(regexp_extract_all({t}, '([+-]?\\d+(?:\\.\\d+)?)', 1)[-1] AS DOUBLE)"
