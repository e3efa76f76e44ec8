"""Trace tables derived from the driver tables (FIXTURES.md D).

The reference's inputs (a public problem set, teacher completions, attempt
logs) are not shipped, so each record kind is derived deterministically from
the driver's Parquet tables. Text is built by ``concat`` of integers only, so
the same rows come out of Spark and of the DuckDB oracle
(``tracekit.plans.sql_fixtures``). All seeded choices use :func:`hash8`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import os

from tracekit.functions.common import hash8
from tracekit.operators.positional import number_groups, number_within
from tracekit.session import scratch_path
from tracekit.sources.tables import read_table

# Fixed values of the fixture generator.
MODULES = ("planner", "executor", "critic")
ERROR_MESSAGES = ("Rate limit exceeded", "Request timeout after 60s",
                  "Failed to parse response JSON", "Upstream generate failure")
SHORT_DOC_CHARS = 2000


_MATERIALIZED: dict[tuple[str, str, str], str] = {}


def materialized(spark: SparkSession, sf_dir: str, name: str, build, bucket_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a derived table once per session under the shared checkpoint folder, then read it.

    Derived fixtures feed many queries; materialising them (a written table,
    not an in-memory cache) cuts their lineage and lets later scans prune
    columns and push filters into Parquet. Tables are bucketed by their unique
    key (bucket count = shuffle partitions): joins on that key need no shuffle,
    and because the key is unique a hot problem still spreads over all buckets.
    A bucket is one file sorted by its key and ``sort_by``, and scans say so: joins, windows and
    aggregates by step sort nothing.
    """
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    table = _MATERIALIZED.get(key)
    if table is None:
        df = build()
        path = scratch_path(spark, f"fx-{name}")
        table = f"tk_{name}_{abs(hash(key)) % 10**12}"
        if bucket_by:
            n = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
            (df.repartition(n, *bucket_by).write.mode("overwrite").bucketBy(n, *bucket_by).sortBy(*bucket_by, *sort_by)
             .option("compression", "zstd").option("path", path).saveAsTable(table))
        else:
            df.write.mode("overwrite").option("compression", "zstd").option("path", path).saveAsTable(table)
        _MATERIALIZED[key] = table
    return spark.table(table)


_ONCE: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """A small value (a cut key) made once per session."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def by_step(df: DataFrame, step: str = "step_number") -> DataFrame:
    """``df`` dealt by problem and step, as the step tables lie: a join by step then never rests on the problem alone."""
    return df.repartition("problem_id", step)


def s(c) -> Column:
    """Integer column as text."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_suppkey", "l_quantity")
    return li.select(F.col("l_orderkey").alias("problem_id"), "l_linenumber", "l_partkey",
                     "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))


def _build_steps_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.3: one row per step (order line): problem_id, step_number, n_steps, prev, q, run."""
    numbered = number_groups(order_lines(spark, sf_dir), ["problem_id"],
                             ["l_linenumber", "l_partkey", "l_suppkey", "q"], value_col="q",
                             step_col="step_number", count_col="n_steps", run_col="run")
    return numbered.select("problem_id", "step_number", "n_steps",
                           (F.col("run") - F.col("q")).alias("prev"), "q", "run")


def _build_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.1, D.2: problem_id, question, answer (`... #### total`), plan and the ``n`` numbered ``lines`` of every order, from one
    exchange of the order lines.

    A problem's texts are one row, so its lines are numbered where they are gathered.
    """
    agg = gathered_lines(order_lines(spark, sf_dir))
    return agg.select("problem_id", _question().alias("question"), _answer("lines").alias("answer"), _plan("lines").alias("plan"), "n", "lines")


def gathered_lines(lines: DataFrame) -> DataFrame:
    """The order lines of a problem in one row: their number ``n``, the ``total`` and the numbers (``o``, ``q``, ``run``) in order."""
    w = Window.partitionBy("problem_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")
    numbered = lines.select(
        "problem_id", F.row_number().over(w).cast("bigint").alias("o"), "q",
        F.sum(F.coalesce("q", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    # the numbers are gathered and the sentences made of them after that
    return numbered.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"), F.sort_array(F.collect_list(F.struct("o", "q", "run"))).alias("lines"))


def _question() -> Column:
    pid, kind = F.col("problem_id"), F.col("problem_id") % 10
    return (F.when(kind == 9, F.concat(F.lit("Sum order "), s(pid), F.lit("?")))
            .when(pid % 3 == 0, F.concat(F.lit("Order "), s(pid), F.lit(" ships "), s("n"),
                                         F.lit(" lines. How many units are shipped in total?")))
            .when(pid % 3 == 1, F.concat(F.lit("A store sells order "), s(pid), F.lit(" in "), s("n"),
                                         F.lit(" lines. What is the sum of units per order?")))
            .otherwise(F.concat(F.lit("Order "), s(pid), F.lit(" has "), s("n"),
                                F.lit(" lines each week. How many units does it cost to ship?"))))


def _answer(lines: str) -> Column:
    """D.1: one sentence per line, then the total."""
    sentence = lambda x: F.concat(F.lit("Line "), s(x["o"]), F.lit(" adds "), s(x["run"] - x["q"]), F.lit(" + "),
                                  s(x["q"]), F.lit(" = "), s(x["run"]), F.lit(" units."))
    body, kind = F.array_join(F.transform(lines, sentence), " "), F.col("problem_id") % 10
    end = (F.when(kind == 8, F.lit("")).when(kind == 7, F.concat(F.lit(" #### 1,"), F.lpad(s("total"), 3, "0")))
           .otherwise(F.concat(F.lit(" #### "), s("total"))))
    return F.concat(body, end)


def _plan(lines: str) -> Column:
    """D.2: one teacher plan per problem in one of five layouts (problem_id % 5)."""
    pid, fmt = F.col("problem_id"), F.col("problem_id") % 5
    # what stands before a line's number, between it and the verb, and after the line depends on the problem alone
    before = F.when(fmt == 2, F.lit("Step ")).otherwise(F.lit(""))
    mark = F.when(fmt == 0, F.lit(". ")).when(fmt == 1, F.lit(") ")).otherwise(F.lit(": "))
    verb = F.when(pid % 7 == 0, F.lit("Calculate line ")).otherwise(F.lit("Add line "))
    tail = F.when(pid % 11 == 0, F.lit(" and write the running total down before going on with the line after it")).otherwise(F.lit(""))

    def line(x):
        text = F.concat(verb, s(x["o"]), F.lit(" with "), s(x["q"]), F.lit(" units to the total"), tail)
        return (F.when(fmt <= 2, F.concat(before, s(x["o"]), mark, text)).when(fmt == 3, F.concat(F.lit("- "), text))
                .otherwise(F.concat(text, F.lit("."))))

    texts = F.transform(lines, line)
    return F.when(fmt == 4, F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n"))


def _build_attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an attempt's text is made of: the step's numbers and the seeded choices."""
    # what is chosen for a problem is looked up once a step, before its attempts are made
    att = _with_problem_choices(steps_fx(spark, sf_dir)).withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    return _with_attempt_choices(att).select("problem_id", "step_number", "n_steps", "attempt", "q", "run", "wrong", "style", "form", "duration_s")


def _with_choices(att: DataFrame) -> DataFrame:
    """The seeded choices of attempts, beside the numbers of their steps."""
    return _with_attempt_choices(_with_problem_choices(att))


def _with_problem_choices(rows: DataFrame) -> DataFrame:
    # how a problem's answer is given: marker, other phrases, no phrase, only sums, only units
    form, slow = hash8("form", "problem_id") % 12, F.when(hash8("slow", "problem_id") % 20 == 0, 6).otherwise(1)
    return rows.withColumn("form", form.cast("int")).withColumn("slow", slow)


def _with_key_text(att: DataFrame) -> DataFrame:
    """``_key``: the text of an attempt's key, made once for all its choices. An attempt's number is never null."""
    return att.withColumn("_key", F.concat_ws("|", s("problem_id"), s("step_number"), s("attempt")))


def _with_attempt_choices(att: DataFrame) -> DataFrame:
    att, keys = _with_key_text(att), ("_key",)
    wrong = (hash8("wrong", *keys) % 10) < 3
    att = att.withColumn("wrong", wrong).withColumn("shown", _shown("wrong"))
    # how a step is written: carrying a decimal, shortened, checked by subtraction, by a product and a quotient, without numbers
    style = hash8("style", *keys) % 20
    return att.withColumn("style", style.cast("int")).withColumn(
        "duration_s", ((F.lit(5) + hash8("dur", *keys) % 20) * F.col("slow")).cast("bigint")).drop("_key")


def _shown(wrong) -> Column:
    """The sum an attempt shows."""
    return F.col("run") + F.col(wrong).cast("bigint")


def _with_sums(att: DataFrame) -> DataFrame:
    # what follows from two numbers of the row is not written
    return att.withColumn("prev", F.col("run") - F.col("q")).withColumn("shown", _shown("wrong"))


def _attempts(att: DataFrame) -> DataFrame:
    """D.4: three logged executor attempts per step; ~30 % show a wrong sum."""
    return _with_execution(_with_sums(att)).select("problem_id", "step_number", "n_steps", "attempt", "prev", "q", "run", "shown",
                                                   "execution", "wrong", "duration_s")


def steps_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``steps_fx`` as they lie by problem, beside its texts: for what needs all steps of a problem in one place."""
    return steps_of(texts_fx(spark, sf_dir))


def steps_of(texts: DataFrame) -> DataFrame:
    """The steps of rows of ``texts_fx``."""
    lines = texts.select("problem_id", F.col("n").alias("n_steps"), F.explode("lines").alias("x"))
    return lines.select("problem_id", F.col("x.o").alias("step_number"), "n_steps", (F.col("x.run") - F.col("x.q")).alias("prev"), "x.q", "x.run")


def with_first_execution(steps: DataFrame) -> DataFrame:
    """Rows with the columns of ``steps_fx``, and the ``execution`` that ``attempts_fx`` logs for the first attempt at the step."""
    att = _with_choices(steps.withColumn("attempt", F.lit(1).cast("bigint")))
    return _with_execution(att).select(*steps.columns, "execution")


def _with_execution(att: DataFrame) -> DataFrame:
    """Attempts with their ``execution``; the texts of the numbers that it holds several times are made once."""
    made = {"_prev": "prev", "_q": "q", "_shown": "shown"}
    return att.withColumns({c: s(n) for c, n in made.items()}).withColumn("execution", _execution(*made)).drop(*made)


def _execution(prev: str, q: str, shown: str) -> Column:
    """The text of an attempt, from its numbers (as texts) and choices."""
    style, form = F.col("style"), F.col("form")
    said = F.concat(F.lit("We add "), F.col(q), F.lit(" units to "), F.col(prev), F.lit(": "), F.col(prev), F.lit(" + "), F.col(q), F.lit(" = "), F.col(shown))
    twice = s(F.col("q") * 2)
    before = (F.when(style == 0, F.concat(F.lit("Carry over "), F.col(prev), F.lit(".0. ")))
              .when(style == 2, F.concat(F.lit("Check by "), F.col(shown), F.lit(" - "), F.col(q), F.lit(" = "), F.col(prev), F.lit(". ")))
              .when(style == 3, F.concat(F.lit("Two lots: "), F.col(q), F.lit(" × 2 = "), twice, F.lit(", halved "), twice, F.lit(" ÷ 2 = "), F.col(q), F.lit(". ")))
              .otherwise(F.lit("")))
    end = (F.when(form == 0, F.concat(F.lit("\n#### "), F.col(shown))).when(form == 1, F.concat(F.lit("\nAll in all "), F.col(shown), F.lit(" items")))
           .when(form == 4, F.concat(F.lit("\nIt makes $"), F.col(shown))).when(form == 5, F.concat(F.lit("\nFinal answer: "), F.col(shown)))
           .when(form == 6, F.concat(F.lit("\nThe total is "), F.col(shown))).otherwise(F.concat(F.lit("\nThe answer is "), F.col(shown))))
    full = F.concat(before, said, F.lit("\nResult: "), F.col(shown), F.lit(" units so far"),
                    F.when(F.col("step_number") == F.col("n_steps"), end).otherwise(F.lit("")))
    execution = (F.when(form == 2, F.concat(said, F.lit(".")))
                 .when(form == 3, F.concat(F.lit("We put "), F.col(q), F.lit(" items to the "), F.col(prev), F.lit(" items and hold "), F.col(shown), F.lit(" items")))
                 .when(style == 1, F.concat(F.lit("Sum: "), F.col(shown)))
                 .when(style == 4, F.lit("The earlier total is carried on to the next line."))
                 .otherwise(full))
    return execution


def _build_critique_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a critique's text is made of: the attempt's numbers, the verdict and the form."""
    att = _with_key_text(attempts_fx(spark, sf_dir))
    keys = ("problem_id", "step_number", "attempt")
    says_correct = (~F.col("wrong")) != ((hash8("flip", "_key") % 10) == 9)
    structured = (hash8("form", "_key") % 4) != 2
    return att.select(*keys, "q", "run", "wrong", says_correct.alias("says_correct"), structured.alias("structured"))


def _critiques(att: DataFrame) -> DataFrame:
    """D.5: one critic output per attempt; structured unless hash % 4 = 2, verdict flipped at % 10 = 9."""
    att, says_correct, structured = _with_sums(att), F.col("says_correct"), F.col("structured")
    critique = (
        F.when(structured & says_correct,
               F.concat(F.lit("STATUS: CORRECT\nREASONING: The sum "), s("prev"), F.lit(" + "), s("q"),
                        F.lit(" = "), s("shown"), F.lit(" is accurate.")))
        .when(structured,
              F.concat(F.lit("STATUS: INCORRECT\nREASONING: The calculation "), s("prev"), F.lit(" + "), s("q"),
                       F.lit(" should be "), s("run"), F.lit(", not "), s("shown"),
                       F.lit(".\nFEEDBACK: The arithmetic is incorrect. You should recalculate "), s("prev"),
                       F.lit(" + "), s("q"), F.lit(" = "), s("run"), F.lit(" and fix the result.")))
        .when(says_correct, F.lit("Looks right to me, the work is clearly accurate."))
        .otherwise(F.concat(F.lit("There is a mistake here; possibly the total should be "), s("run"), F.lit("."))))
    return att.select("problem_id", "step_number", "attempt", critique.alias("critique"))


def _build_request_log_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.6: teacher request log from ``events``: request = user and hour, attempts by time."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    hour_key = (F.year("ts") * 1000000 + F.month("ts") * 10000 + F.dayofmonth("ts") * 100 + F.hour("ts"))
    ev = ev.withColumn("request_id", F.concat(s("user_id"), F.lit("-"), s(hour_key.cast("bigint"))))
    numbered = number_within(ev, ["request_id"], ["ts", "event_id"], step_col="attempt", count_col="n_attempts")
    ok = F.col("event_type") != "error"
    err = F.element_at(F.array(*[F.lit(m) for m in ERROR_MESSAGES]), (F.col("event_id") % 4 + 1).cast("int"))
    module = F.element_at(F.array(*[F.lit(m) for m in MODULES]), (F.col("user_id") % 3 + 1).cast("int"))
    return numbered.select(
        "request_id", "attempt", "ts", "event_id", ok.alias("ok"),
        F.when(~ok, err).alias("error_text"),
        F.when(ok, F.concat(F.lit("response "), s("event_id"))).alias("response"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        module.alias("module"))


def pairs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.7: each user turn with the assistant turn right after it."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                        F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def variants_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.8: the same prompt answered by two variants; half differ by a suffix."""
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    out_b = F.when(hash8("variant", "item_id") % 2 == 1, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return b.select(F.col("item_id").alias("prompt_id"), F.col("text").alias("output_a"), out_b.alias("output_b"))


def flags_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D.9: document-level error flags: actual = low quality, predicted = short text."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", "source", (F.col("quality") == 0).alias("actual"),
        (F.col("n_chars") < SHORT_DOC_CHARS).alias("predicted"))


def _public(name, build, bucket_by=(), sort_by=()):
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return materialized(spark, sf_dir, name, lambda: build(spark, sf_dir), bucket_by, sort_by)
    get.__name__ = name
    get.__doc__ = build.__doc__
    return get


def _columns(table, *names):
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir).select(*names)
    get.__doc__ = f"{', '.join(names)} of {table.__name__}."
    return get


def _texts(numbers, texts):
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a log is much larger than the numbers it is made of, by which its size would be estimated: it is joined by merge
        return texts(numbers(spark, sf_dir)).hint("merge")
    get.__name__ = numbers.__name__
    get.__doc__ = texts.__doc__
    return get


STEP_KEY = ("problem_id", "step_number")
steps_fx = _public("steps_fx", _build_steps_fx, STEP_KEY)
# questions, answers and plans lie in one table by problem: what reads a plan with its problem needs no join
texts_fx = _public("texts_fx", _build_texts, ("problem_id",))
problems_fx = _columns(texts_fx, "problem_id", "question", "answer")
plans_fx = _columns(texts_fx, "problem_id", "plan")
# attempt logs are bucketed by step: the attempt join, the per-step window and the
# per-step aggregate of W2 all reuse it (a step holds at most max_attempts rows). Written are their
# numbers; the long texts follow from one row's numbers and are made where they are read.
attempts_fx = _texts(_public("attempts_fx", _build_attempt_numbers, STEP_KEY, ("attempt",)), _attempts)
critiques_fx = _texts(_public("critiques_fx", _build_critique_numbers, STEP_KEY, ("attempt",)), _critiques)
request_log_fx = _public("request_log_fx", _build_request_log_fx, ("request_id", "attempt"))
