"""What grows with the input: joins, exchanges and passes of the plan, completion and critic queries, on own rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracekit.functions import plan_text as PT
from tracekit.operators import positional as P
from tracekit.sources import fixtures as fx

# the reference's patterns, of which plan_text holds faster forms
REFERENCE = (r"(?isd)(\d+)\.\s*(.+?)(?=\n\d+\.|\n[A-Z]|\z)", r"(?isd)(\d+)\)\s*(.+?)(?=\n\d+\)|\n[A-Z]|\z)",
             r"(?isd)Step\s+(\d+):?\s*(.+?)(?=\nStep|\n[A-Z]|\z)")
REFERENCE_EVAL = r"(?msd)^\s*(\d+\.?\s*.*?)(?=^\s*\d+\.|\z)"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Own order lines: 300 problems of 1 to 5 steps, and conversations."""
    path = str(tmp_path_factory.mktemp("own"))
    lines = spark.range(300).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int"))).alias("l_linenumber"))
    lines.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
                 (F.col("l_orderkey") % 40 + F.col("l_linenumber")).cast("double").alias("l_quantity")).repartition(6).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "user", "  What is   2 + 2? "), (1, 2, "assistant", "It is 4\n")], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, n=400):
    r, bits = random.Random(3), ["1.", "2)", "Step 3:", "step 4", "12", "\n", "\n\n", " ", "\t", "Add", "sum é", "a", "Zzz", "- ", ".", "\r\n", "1. ", "x1", "\n9.", "_"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "Step 12", "1.  ", *made])], "id long, plan string")


def test_patterns_match_as_the_reference_does(spark):
    pairs = [(x, y, g) for x, y in zip((*REFERENCE, REFERENCE_EVAL), (*PT.PLAN_PATTERNS, PT.EVAL_STEP)) for g in (1, 2) if g == 1 or x != REFERENCE_EVAL]
    hits = lambda p, g: F.regexp_extract_all("plan", F.lit(p), g)
    same = [hits(x, g).eqNullSafe(hits(y, g)) for x, y, g in pairs]
    assert _texts(spark).where(~F.array_min(F.array(*same))).isEmpty()


def test_a_search_serves_all_modes(spark):
    d = _texts(spark)
    modes = {"strict": "x", "runtime": "y", "c5": "z"}
    both = PT.with_parsed_plans(d, "plan", modes)
    for mode, c in modes.items():
        both = PT.with_plan_steps(both, "plan", f"{c}1", mode=mode)
    assert both.where(~(F.col("x").eqNullSafe(F.col("x1")) & F.col("y").eqNullSafe(F.col("y1")) & F.col("z").eqNullSafe(F.col("z1")))).isEmpty()


@pytest.mark.parametrize("a,b,want", [(None, "ab cd", None), ("ab", None, None), ("", "a", 0.5), ("", "ab", 0.0), ("ab", "AB", 1.0), ("ab cd", "ef", 0.0)])
def test_coverage(spark, a, b, want):
    got = PT.with_tfidf_cosine(spark.createDataFrame([(a, b)], "q string, p string"), "q", "p").first().coverage
    assert got == (want if want is None else pytest.approx(want))


def test_coverage_counts_terms(spark):
    got = PT.with_tfidf_cosine(spark.createDataFrame([("add add line line2", "add line line line zz")], "q string, p string"), "q", "p").first().coverage
    w = PT.IDF_SINGLE ** 2
    assert got == pytest.approx((2 + 3) / ((4 + 1 + w) ** 0.5 * (1 + 9 + w) ** 0.5))


def test_plans_and_questions_need_no_join(spark, sf):
    from tracekit.plans import curation as C
    for df in (C.plan_scores(spark, sf), C.plan_coverage(spark, sf), C.sft_planner(spark, sf)):
        assert "Join" not in _plan(df) and "Exchange" not in _plan(df)


def test_texts_come_from_one_exchange(spark, sf, monkeypatch):
    seen, real = [], fx.read_table
    monkeypatch.setattr(fx, "read_table", lambda *a: seen.append(a[2]) or real(*a))
    built = fx._build_texts(spark, sf)
    assert seen == ["lineitem"] and _plan(built).count("Exchange hashpartitioning") == 1
    t = built.where("problem_id = 7").first()
    assert (t.question, t.answer.split(". ")[1], t.plan.split("\n")[0]) == (
        "A store sells order 7 in 3 lines. What is the sum of units per order?", "Line 2 adds 8 + 9 = 17 units", "Step 1: Calculate line 1 with 8 units to the total")


def test_masked_sequence_looks_at_words_once(spark, sf):
    from tracekit.plans import reports
    m = reports.masked_sequence(spark, sf)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    planner = plan[plan.rindex("plan-"):]
    assert "Join" not in planner and plan.count("md5(") == 2 and "filter(split" not in plan
    r = m.where("key = 'pair-1-1'").first()
    assert (r.n_ids, r.prompt_len, r.attention_mask) == (10, 7, " ".join(["1"] * 10))
    assert r.labels.split(" ") == ["-100"] * 7 + r.input_ids.split(" ")[7:]


def test_requests_meet_the_store_by_problem(spark, sf):
    """Neither the requests' texts nor the stored answers are dealt for their joins."""
    from tracekit.plans import augmentation as A
    for df in (A.varied_plans(spark, sf), A.flawed_copies(spark, sf), A.injected_errors(spark, sf)):
        assert "SortMergeJoin" in _plan(df) and "Exchange hashpartitioning" not in _plan(df)


def test_plan_variations_leave_the_executor_store_unbuilt(spark, tmp_path, sf):
    import os
    from tracekit.plans import augmentation as A
    own = f"{tmp_path}/again"
    os.symlink(sf, own)
    assert A.augment_plans(spark, own).where("source = 'gsm8k_variation'").count() > 0
    assert {n for (_, d, n) in fx._MATERIALIZED if d == own} == {"texts_fx", "parsed_plans", "completions_variation"}


def test_written_stores_are_one_file_a_bucket(spark, sf):
    from tracekit.plans import augmentation as A
    from tracekit.plans import base
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for t in (fx.texts_fx(spark, sf), base.parsed_plans(spark, sf), *[A.completions_fx(spark, sf, k) for k in A._ANSWERS]):
        assert len(t.inputFiles()) <= buckets


def test_what_leads_to_the_keys_is_done_once(spark):
    """The range sampling reads written keys; the cut's first column reaches the rows alone."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, i % 3) for i in range(100)]).map(lambda x: seen.add(1) or x), "g long, id long")
    assert P.last_key(rows, ["g", "id"], P.share(1, 2)) == (49, 1) and seen.value == 100
    cut = P.up_to(rows, ["g", "id"], (4, 1))
    assert "(g#" in _plan(cut) and "<= 4) AND" in _plan(cut) and cut.count() == 5
