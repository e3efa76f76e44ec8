"""W0/W8/H invariants: distributed ordinals equal row_number, splits are exact."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracekit.operators import positional as P


def test_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    got = P.ordinal(df, ["k", "id"]).select("id", "pos")
    ref = df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("rpos"))
    assert got.join(ref, "id").where("pos <> rpos").count() == 0


def test_ordinal_small_and_empty(spark):
    assert P.ordinal(spark.range(0), ["id"]).count() == 0
    assert sorted(r.pos for r in P.ordinal(spark.range(3), ["id"]).collect()) == [1, 2, 3]


def test_ordinal_hot_group(spark):
    # one key holds most rows: positions stay exact and contiguous
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("g"), "id")
    pos = [r.pos for r in P.ordinal(df, ["g", "id"]).collect()]
    assert sorted(pos) == list(range(1, 3001))


def test_number_within_skew_safe_equals_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 5).alias("v"))
    a = P.number_within(df, ["g"], ["id"], value_col="v")
    b = P.number_within(df, ["g"], ["id"], value_col="v", skew_safe=False).select(
        "id", F.col("step").alias("s2"), F.col("run").alias("r2"), F.col("n_steps").alias("n2"))
    assert a.join(b, "id").where("step <> s2 OR run <> r2 OR n_steps <> n2").count() == 0


def test_quota_cut_whole_batches(spark):
    df = spark.range(0, 300).withColumn("batch", (F.col("id") / 75).cast("long"))
    assert P.quota_cut(df, "batch", 100).count() == 150


def test_strided_and_prefix(spark):
    o = P.ordinal(spark.range(25), ["id"], total_col="n")
    got = sorted(r.id for r in P.strided_sample(o, F.col("n"), 10).collect())
    assert got == list(range(0, 20, 2))
    o7 = P.ordinal(spark.range(7), ["id"])
    n = P.row_count(o7)
    assert [P.prefix_fraction(o7, n, 1, k).count() for k in (2, 3, 4)] == [3, 2, 1]


def test_number_within_hot_and_small_groups(spark):
    # one group holds two thirds of the rows and spans many buckets; others are tiny
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id") % 50).alias("g"),
                                     F.col("id"), (F.col("id") % 11).alias("v"))
    a = P.number_within(df, ["g"], ["id"], value_col="v")
    b = P.number_within(df, ["g"], ["id"], value_col="v", skew_safe=False).select(
        "id", F.col("step").alias("s2"), F.col("run").alias("r2"), F.col("n_steps").alias("n2"))
    assert a.count() == 3000
    assert a.join(b, "id").where("step <> s2 OR run <> r2 OR n_steps <> n2").count() == 0
    c = P.number_within(df, ["g"], ["id"])
    assert c.join(b, "id").where("step <> s2 OR n_steps <> n2").count() == 0


def test_ordinal_many_ranges_and_tasks(spark):
    # far more ranges than rows in most tasks, and rows dealt over 48 tasks
    df = spark.range(0, 6000, 1, 48).select((F.col("id") * 7919 % 6000).alias("k"), "id")
    got = P.ordinal(df, ["k"], total_col="n", num_partitions=1024)
    assert got.where("pos <> k + 1 OR n <> 6000").count() == 0 and got.count() == 6000


def test_prefix_sums_with_nulls(spark):
    df = spark.range(0, 500).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"))
    got = {r.id: (r.v_cum, r.pos) for r in P.prefix_sums(df, ["id"], ["v"], pos_col="pos").collect()}
    total = 0
    for i in range(500):
        total += i if i % 10 else 0
        assert got[i] == (total, i + 1)


def test_first_part(spark):
    df = spark.range(0, 100).select((F.col("id") % 7).alias("g"), "id", F.lit("wide").alias("text"))
    want = sorted((i % 7, i) for i in range(100))
    got = P.first_part(df, ["g", "id"], P.share(1, 3))
    assert sorted((r.g, r.id) for r in got.collect()) == want[:33] and got.columns == df.columns
    assert P.first_part(df, ["g", "id"], lambda n: F.lit(1000)).count() == 100
    assert P.first_part(df, ["g", "id"], lambda n: F.lit(0)).count() == 0
    assert P.first_part(df.where("id < 0"), ["g", "id"], P.share(1, 1)).count() == 0
