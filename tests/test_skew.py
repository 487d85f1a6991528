"""Hot keys: a third or more of the rows under one key."""

import pytest
from pyspark.sql import functions as F

from whence import annotate_keys, expand, group
from whence.functions.aggregates import count, sum_
from whence.operators.evaluate import delete_tokens
from whence.operators.frame import grid
from whence.operators.subquery import scalar_compare, semi_join

N = 120_000


@pytest.fixture
def tight(spark):
    """Let AQE treat small partitions as skewed, and never broadcast."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(tight):
    df = tight.range(0, N, 1, 12).select(
        F.col("id").alias("l"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), F.lit(1).alias("v")
    )
    return annotate_keys(df, "L", ["l"])


def final_plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()  # the adaptive plan is final after running
    return plan.toString()


def test_semi_join_splits_a_hot_key(hot, tight):
    keys = annotate_keys(tight.range(3000).withColumnRenamed("id", "j"), "K", ["j"])
    f = semi_join(hot, keys, [("k", "j")], "E")
    assert "skew" in final_plan(f.df).lower()
    assert f.df.count() == N // 2 + sum(1 for i in range(1, N, 2) if i % 5000 < 3000)


def test_scalar_compare_splits_a_hot_key(hot):
    f = scalar_compare(hot, "v", "<=", hot.prefixed("i_"), count(), "S", [("k", "i_k")])
    assert "skew" in final_plan(f.df).lower()
    assert f.df.count() == N


def test_windowed_count_is_a_join(hot):
    f = hot.count_over(["k"], "n")
    plan = final_plan(f.df)
    assert "Window" not in plan and "skew" in plan.lower()
    assert f.df.filter("k = 0").agg(F.max("n"), F.min("n")).first() == (N // 2, N // 2)


def test_group_aggregates_before_the_shuffle_and_never_collects(hot):
    g = group(hot, ["k"], "G", {"n": count(), "s": sum_("v")})
    plan = g.how()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan
    for df in (g.how(), g.circuit(), g.tensor("s"), expand(g).terms, expand(g).lineage(), expand(g).posbool()):
        assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
    # the derivations themselves are a narrow projection
    assert "Exchange" not in g.gate("G").derivations._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_shown_term_by_term(hot):
    rows = expand(group(hot, ["k"], "G", {"n": count()})).texts()
    assert rows.filter("out = 'G[0]'").count() == N // 2 and rows.count() == N
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_join_with_a_grouped_side_splits_a_hot_key(hot):
    g = group(hot.prefixed("g_"), ["g_k"], "G", {"n": count()})
    f = hot.join(g, [("k", "g_k")])
    assert "skew" in final_plan(f.df).lower()
    assert f.df.count() == N


def test_refold_splits_a_hot_gate(hot, tight):
    g = group(hot.prefixed("g_"), ["g_k"], "G", {"n": count()})
    f = hot.join(g, [("k", "g_k")])
    deleted = tight.createDataFrame([("L0",), ("L1",)], "token string")
    after = delete_tokens(f, deleted)
    assert "skew" in final_plan(after.df).lower()
    assert after.df.filter("k = 0").agg(F.min("n"), F.max("n"), F.count("*")).first() == (N // 2 - 1, N // 2 - 1, N // 2 - 1)


def test_deletion_grows_by_one_step_a_gate(tight):
    frame = annotate_keys(tight.range(20).selectExpr("id as l", "id % 5 as k"), "L", ["l"])
    deleted = tight.createDataFrame([("L0",)], "token string")
    scans = []
    for i in range(4):
        frame = group(frame, ["k"], f"G{i}", {"n": count()}).select("k")
        scans.append(delete_tokens(frame, deleted).df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
    assert scans[-1] - scans[-2] <= scans[1] - scans[0] + 1


def test_no_cross_product_is_planned(hot, tight):
    few = annotate_keys(tight.range(3).withColumnRenamed("id", "t"), "T", ["t"])
    for f in (hot.cross_join(few), hot.theta_join(few, F.expr("k < t"))):
        plan = f.df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_top_per_group_prunes_before_the_shuffle(hot):
    f = hot.top_per_group(["v"], ["l desc"], 3)  # one constant key: a limit does the same
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "Limit" in plan
    assert sorted(r["l"] for r in f.df.collect()) == [N - 3, N - 2, N - 1]
    plan = hot.top_per_group(["k"], ["l desc"], 3).df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_ties_are_ranked_by_value_and_split(hot, tight):
    """Half of the rows tie at the first rank of one key."""
    rows = hot.with_columns(half=F.when(F.col("k") == 0, 7).otherwise(F.col("k")), g=F.col("l") % 2)
    f = rows.top_per_group(["g"], ["half desc"], 4)
    assert "skew" in final_plan(f.df).lower()
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy(F.desc("half"))
    want = rows.df.withColumn("rank", F.rank().over(w)).filter("rank <= 4").select("l", "g", "rank")
    got = f.df.select("l", "g", "rank")
    assert got.count() >= N // 2 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("partitions", [200, 2000])
def test_grid_copies_no_side_more_than_the_root_of_the_partitions(tight, partitions):
    for left, right in ((10**9, 10), (10, 10**9), (10**6, 10**6), (0, 0), (5000, 1000)):
        tall, wide = grid(partitions, F.lit(float(left)), F.lit(float(right)))
        a, b = tight.range(1).select(tall, wide).first()
        assert 1 <= a <= partitions**0.5 and 1 <= b <= partitions**0.5  # copies of right and left rows
    before = tight.conf.get("spark.sql.shuffle.partitions")
    tight.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        big = annotate_keys(tight.range(3000).withColumnRenamed("id", "a"), "A", ["a"])
        few = annotate_keys(tight.range(30).withColumnRenamed("id", "b"), "B", ["b"])
        for one, other in ((big, few), (few, big), (few, few.prefixed("x_"))):
            x, y = one.columns[0], other.columns[0]
            f = one.theta_join(other, F.expr(f"({x} + {y}) % 7 = 3"))
            assert f.df.count() == one.df.crossJoin(other.df.select(y)).filter(f"({x} + {y}) % 7 = 3").count()
    finally:
        tight.conf.set("spark.sql.shuffle.partitions", before)


def test_ordered_theta_join_prunes_ranges(tight):
    a = annotate_keys(tight.range(2000).selectExpr("id as a", "case when id % 3 = 0 then 500 else id end as x"), "A", ["a"])
    b = annotate_keys(tight.range(50).selectExpr("id as b", "id * 40 as y"), "B", ["b"])
    for op in ("<", "<=", ">", ">=", "=", "<>"):
        f = a.theta_join(b, order=("x", op, "y"))
        want = a.df.crossJoin(b.df.select("y")).filter(f"x {op} y").count()
        assert f.df.count() == want
