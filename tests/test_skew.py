"""One key holding a third of all rows: plans cut it down before the shuffle,
and results stay whole (nothing dropped, capped or sampled)."""
import re

from pyspark.sql import functions as F

from tenura.operators import aggregates as A
from tenura.operators.windows import latest_row, top_n_per_key

N = 30000


def _skewed(spark):
    # key 'HOT' holds N/3 rows, the rest spread over N/3 other keys (two rows each)
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), (F.col("id") % (N // 3)).cast("string")))
         .alias("k"),
        F.col("id").alias("v"),
        F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("code")).repartition(8)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _before_first_exchange(plan, node):
    # the physical plan prints parents first; a node below the first Exchange runs map-side
    lines = plan.split("\n")
    ex = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
    return any(node in l for l in lines[ex[0] + 1:]) if ex else False


def test_latest_row_hot_key_limited_map_side(spark):
    df = _skewed(spark)
    out = latest_row(df, ["k"], [F.col("v").desc()])
    assert _before_first_exchange(_plan(out), "WindowGroupLimit")
    got = dict((r["k"], r["v"]) for r in out.collect())
    assert got["HOT"] == max(i for i in range(N) if i % 3 == 0)
    assert len(got) == 1 + (N // 3)


def test_top_n_hot_key_limited_map_side(spark):
    out = top_n_per_key(_skewed(spark), ["k"], [F.col("v").asc()], 5)
    assert _before_first_exchange(_plan(out), "WindowGroupLimit")
    hot = sorted(r["v"] for r in out.where("k = 'HOT'").collect())
    assert hot == [0, 3, 6, 9, 12]


def test_counts_and_sets_partially_aggregated(spark):
    df = _skewed(spark)
    out = df.groupBy("k").agg(A.n_rows().alias("n"), A.n_distinct("code").alias("codes"),
                              A.list_distinct("code").alias("code_list"), F.max("v").alias("mx"))
    plan = _plan(out)
    # partial aggregates (count, distinct codes, the code set) run before the key shuffle
    assert len(re.findall(r"(Object)?HashAggregate\(keys=\[k", plan)) >= 2
    hot = out.where("k = 'HOT'").first()
    assert hot["n"] == N // 3 and hot["codes"] == 5 and hot["code_list"] == "t0, t1, t2, t3, t4"
    assert out.count() == 1 + (N // 3)


def test_preview_bounded_per_hot_key(spark):
    out = A.preview(_skewed(spark), "k", "v", n=8)
    assert _before_first_exchange(_plan(out), "WindowGroupLimit")
    hot = out.where("k = 'HOT'").first()["preview"]
    assert hot.split(" | ") == [str(i) for i in range(0, N, 3)][:8]
