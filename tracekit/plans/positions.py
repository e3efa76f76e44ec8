"""Registered positional queries over the problem table.

Positions come from ``ordinal`` (range partitions + broadcast offsets), never
from an unpartitioned window over the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.functions.common import r6
from tracekit.operators import gates, selection
from tracekit.operators import positional as P
from tracekit.operators.quota import clipped_quota
from tracekit.plans.curation import PROBLEM_OUTCOME, _PLAN_ROWS, _plan_examples
from tracekit.plans.registry import register
from tracekit.plans.sql_fixtures import H, with_fixtures
from tracekit.sources import fixtures as fx

BATCH_SIZE = 50
PLANNER_TARGET = 7500
SAMPLE_SIZE = 10
HEAD_N = 100
VALIDATOR_TARGET, VALIDATOR_WORD = 1200, "units"
PARTS = (("half", 1, 2), ("third", 1, 3), ("quarter", 1, 4), ("rate30", 3, 10))
SPLIT, SPLIT_SEED = {"train": 0.8, "val": 0.1, "test": 0.1}, "split"

_ACC = f"SELECT problem_id, question FROM problems_fx WHERE ({PROBLEM_OUTCOME}) = 'accepted'"
_RANK = "SELECT *, row_number() OVER (ORDER BY problem_id) AS pos, count(*) OVER () AS n FROM acc"


def _accepted(spark, sf):
    acc, _ = gates.apply_gate(fx.problems_fx(spark, sf), gates.problem_rules())
    return acc.select("problem_id", "question")


def _ranked(spark, sf):
    acc = _accepted(spark, sf).select("problem_id")
    return P.ordinal(acc, ["problem_id"], total_col="n")


@register("ordinal", with_fixtures("SELECT problem_id, pos FROM r", "problems_fx", extra={"acc": _ACC, "r": _RANK}))
def ordinal(spark, sf):
    """1-based position of every accepted problem by problem_id."""
    return P.ordinal(_accepted(spark, sf).select("problem_id"), ["problem_id"]).select("problem_id", "pos")


@register("batches", with_fixtures(f"SELECT problem_id, CAST(floor((pos - 1) / {BATCH_SIZE}) AS BIGINT) AS batch FROM r",
                                   "problems_fx", extra={"acc": _ACC, "r": _RANK}))
def batches(spark, sf):
    """Batch index of 50 problems."""
    return P.batches(P.ordinal(_accepted(spark, sf).select("problem_id"), ["problem_id"]), BATCH_SIZE).select("problem_id", "batch")


_QUOTA_SQL = with_fixtures(f"""
SELECT problem_id, batch FROM rows JOIN (
  SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT batch, count(*) AS n FROM rows GROUP BY batch)) USING (batch)
WHERE before < {PLANNER_TARGET}""", "problems_fx", "plans_fx", extra={"pr": _PLAN_ROWS, "rows": f"""
SELECT b.problem_id, CAST(floor((b.pos - 1) / {BATCH_SIZE}) AS BIGINT) AS batch
FROM (SELECT problem_id, row_number() OVER (ORDER BY problem_id) AS pos FROM problems_fx) b
JOIN (SELECT problem_id FROM pr GROUP BY problem_id HAVING count(*) >= 2) g USING (problem_id)"""})


@register("quota_cut", _QUOTA_SQL)
def quota_cut(spark, sf):
    """Problems in batches of 50; a batch yields its valid plan rows; whole batches are
    kept while the rows of the earlier batches are below the planner target."""
    b = P.batches(P.ordinal(fx.problems_fx(spark, sf).select("problem_id"), ["problem_id"]), BATCH_SIZE)
    rows = _plan_examples(spark, sf).where(F.size("steps") >= 2).select("problem_id").join(b, "problem_id")
    return P.quota_cut(rows, "batch", PLANNER_TARGET).select("problem_id", "batch")


@register("head_n", with_fixtures(f"SELECT problem_id, question FROM problems_fx ORDER BY problem_id LIMIT {HEAD_N}", "problems_fx"))
def head_n(spark, sf):
    """H1: the first N problems (a top-k by key: per-task top-N then a merge)."""
    return P.head_n(fx.problems_fx(spark, sf).select("problem_id", "question"), ["problem_id"], HEAD_N)


@register("first_k_per_group", with_fixtures("""SELECT problem_id, pos, step_number, description FROM pr WHERE pos <= 3""",
                                             "plans_fx", extra={"pr": _PLAN_ROWS}))
def first_k_per_group(spark, sf):
    """H2: the first 3 steps of every plan (``slice`` inside the row, no shuffle)."""
    p = _plan_examples(spark, sf).select("problem_id", F.slice("steps", 1, 3).alias("s"))
    return p.select("problem_id", F.posexplode("s").alias("pos", "x")).select(
        "problem_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "x.step_number", "x.description")


@register("strided_sample", with_fixtures(
    f"""SELECT problem_id, pos FROM (SELECT *, greatest(1, n // {SAMPLE_SIZE}) AS step FROM r)
        WHERE (pos - 1) % step = 0 AND (pos - 1) // step < {SAMPLE_SIZE}""", "problems_fx", extra={"acc": _ACC, "r": _RANK}))
def strided_sample(spark, sf):
    """H3: every max(1, n // 10)-th accepted problem, at most 10."""
    r = _ranked(spark, sf)
    return P.strided_sample(r, F.col("n"), SAMPLE_SIZE).select("problem_id", "pos")


@register("prefix_fraction", with_fixtures(
    """SELECT v.part, r.problem_id, r.pos FROM r JOIN (VALUES ('half', 1, 2), ('third', 1, 3), ('quarter', 1, 4), ('rate30', 3, 10))
         v(part, num, den) ON r.pos <= (r.n * v.num) // v.den""",
    "problems_fx", extra={"acc": _ACC, "r": _RANK}))
def prefix_fraction(spark, sf):
    """H4: the first n//2, n//3, n//4 and int(0.3 n) rows, each row once for every part it is in."""
    r = _ranked(spark, sf)
    parts = F.array(*[F.when(F.col("pos") <= P.share(num, den)(F.col("n")), name) for name, num, den in PARTS])
    return r.select(F.explode(F.array_compact(parts)).alias("part"), "problem_id", "pos")


def _split_sql(order: str, cuts: str) -> str:
    return with_fixtures(f"""SELECT problem_id, CASE {cuts} END AS split FROM (
        SELECT problem_id, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () AS n FROM acc)""",
                         "problems_fx", extra={"acc": _ACC})


@register("shuffle_split", _split_sql(f"{H(SPLIT_SEED, 'problem_id')}, problem_id",
                                      "WHEN pos <= floor(n * 0.8) THEN 'train' WHEN pos <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test'"))
def shuffle_split(spark, sf):
    """H7: seeded shuffle (hash order) cut into exact floor sizes 0.8 / 0.1 / rest, by selection of the two cut keys."""
    return selection.shuffle_split(_accepted(spark, sf).select("problem_id"), SPLIT, SPLIT_SEED, "problem_id")


@register("positional_split", _split_sql("problem_id", "WHEN pos <= floor(0.9 * n) THEN 'train' ELSE 'eval'"))
def positional_split(spark, sf):
    """H8: the first floor(0.9 n) rows train, the rest eval."""
    r = _ranked(spark, sf)
    return r.select("problem_id", F.when(F.col("pos") <= F.floor(F.col("n") * 0.9), "train").otherwise("eval").alias("split"))


@register("resume_anti", with_fixtures(
    f"""SELECT problem_id FROM acc WHERE problem_id NOT IN (SELECT problem_id FROM r WHERE pos <= {3 * BATCH_SIZE})""",
    "problems_fx", extra={"acc": _ACC, "r": _RANK}))
def resume_anti(spark, sf):
    """On restart, skip problems already produced (here the first three batches)."""
    acc = _accepted(spark, sf)
    done = P.first_part(acc.select("problem_id"), ["problem_id"], lambda n: F.lit(3 * BATCH_SIZE))
    return acc.join(done, "problem_id", "left_anti").select("problem_id")


# B8, K1 -------------------------------------------------------------------------
def _quota_ctes(valid: str, target: int) -> dict[str, str]:
    """The running quota as a recursion over the batches: one row a processed batch."""
    return {
        "pr": _PLAN_ROWS,
        "pg": """SELECT p.problem_id, q.question, p.plan, s.ns, s.short FROM plans_fx p JOIN problems_fx q USING (problem_id)
          LEFT JOIN (SELECT problem_id, count(*) AS ns, count(*) FILTER (WHERE description IS NULL OR description = ''
                     OR length(description) < 10) AS short FROM pr GROUP BY problem_id) s USING (problem_id)""",
        "gen": f"""SELECT *, row_number() OVER (PARTITION BY batch ORDER BY problem_id) AS place FROM (
          SELECT b.problem_id, CAST(floor((b.pos - 1) / {BATCH_SIZE}) AS BIGINT) AS batch, coalesce({valid}, false) AS valid
          FROM (SELECT problem_id, row_number() OVER (ORDER BY problem_id) AS pos FROM problems_fx) b JOIN pg USING (problem_id) WHERE pg.ns >= 2)""",
        "bt": """SELECT *, row_number() OVER (ORDER BY batch) AS i FROM (
          SELECT batch, count(*) AS size, coalesce(list(place) FILTER (WHERE valid), []) AS places FROM gen GROUP BY batch)""",
        "rec": f"""SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS needed, CAST(0 AS BIGINT) AS generated,
            CAST(0 AS BIGINT) AS valid, CAST(0 AS BIGINT) AS total
          UNION ALL
          SELECT i, batch, needed, least(size, needed), n, total + n FROM (
            SELECT b.i, b.batch, least({BATCH_SIZE}, {target} - r.total) AS needed, b.size, r.total,
              CAST(len(list_filter(b.places, lambda x: x <= least({BATCH_SIZE}, {target} - r.total))) AS BIGINT) AS n
            FROM rec r JOIN bt b ON b.i = r.i + 1 WHERE r.total < {target})""",
    }


_VALID_SQL = "pg.ns BETWEEN 2 AND 8 AND coalesce(pg.short, 0) = 0 AND length(pg.plan) >= 50 AND length(pg.question) >= 20"
_LEDGER_SQL = """SELECT batch, generated, valid, total, round(valid / generated, 6) AS yield FROM rec WHERE i > 0"""
_QUOTA_FIX = ("problems_fx", "plans_fx")


def _quota(spark, sf, valid, target):
    b = P.batches(P.ordinal(fx.problems_fx(spark, sf).select("problem_id"), ["problem_id"]), BATCH_SIZE)
    ex = _plan_examples(spark, sf).where(F.size("steps") >= 2).join(b.select("problem_id", "batch"), "problem_id")
    return clipped_quota(ex, ["problem_id"], valid, target, BATCH_SIZE)


def _yields(batches):
    return batches.select("batch", "generated", "valid", "total", r6(F.col("valid") / F.col("generated")).alias("yield"))


@register("curate_valid", with_fixtures(_LEDGER_SQL, *_QUOTA_FIX, extra=_quota_ctes(_VALID_SQL, PLANNER_TARGET), recursive=True))
def curate_valid(spark, sf):
    """Per processed batch of 50 problems, generated plan examples (>= 2 steps), the B2-valid ones among them, valid rows so far and yield."""
    return _yields(_quota(spark, sf, gates.first_failure(gates.plan_rules()).isNull(), PLANNER_TARGET)[1])


@register("curate_rows", with_fixtures(
    "SELECT g.problem_id, g.batch, CAST(g.place AS INTEGER) AS place, pg.question, pg.plan FROM gen g JOIN rec r USING (batch) JOIN pg USING (problem_id) "
    "WHERE g.valid AND g.place <= r.needed", *_QUOTA_FIX, extra=_quota_ctes(_VALID_SQL, PLANNER_TARGET), recursive=True))
def curate_rows(spark, sf):
    """The valid rows, exactly the planner's target where there are enough."""
    kept = _quota(spark, sf, gates.first_failure(gates.plan_rules()).isNull(), PLANNER_TARGET)[0]
    return kept.select("problem_id", "batch", "place", "question", "plan")


@register("validator_hook", with_fixtures(_LEDGER_SQL, *_QUOTA_FIX, extra=_quota_ctes(
    f"length(pg.question) < 90 AND pg.problem_id % 7 < 3 AND pg.plan LIKE '%{VALIDATOR_WORD}%'", VALIDATOR_TARGET), recursive=True))
def validator_hook(spark, sf):
    """K1: a user's validator in the place of B2's rules, under a quota of its own."""
    def short_and_adding(df):
        return (F.length(df["question"]) < 90) & (df["problem_id"] % 7 < 3) & F.contains(df["plan"], F.lit(VALIDATOR_WORD))
    return _yields(_quota(spark, sf, short_and_adding, VALIDATOR_TARGET)[1])
