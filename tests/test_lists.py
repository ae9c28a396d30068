"""List-building aggregates: order, nulls, and one shuffle of the lists."""
from tenura.operators import aggregates as A

ROWS = [("a", 3, "Z", "x"), ("a", 1, None, "y"), ("a", 1, "B", None), ("a", 1, "B", "w"), ("a", None, "C", "v"), ("b", None, None, None)]


def _groups(spark):
    df = spark.createDataFrame(ROWS, "k string, id long, o string, v string").repartition(3)
    return df.groupBy("k").agg(A.n_distinct_listed("id").alias("n"), A.list_ordered("v", "o", "id").alias("l"),
                               A.list_distinct("o").alias("s"))


def test_lists_and_their_distinct_count(spark):
    # a null name first, then by name and id; a null id counts for nothing, a group without values is null
    got = {r.k: (r.n, r.l, r.s) for r in _groups(spark).collect()}
    assert got == {"a": (2, "y | w | v | x", "B, C, Z"), "b": (0, None, None)}
    assert dict(_groups(spark).dtypes)["n"] == "bigint"


def test_lists_beside_a_distinct_count_are_shuffled_once(spark):
    from tenura.plans import gold as G
    from tenura.sources.adapters import RegistryTables
    plan = _groups(spark)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2 and "ArraySort" not in plan and "array_sort" not in plan
    plan = G.title_360(RegistryTables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.split("\n") if "collect_list" in x and "keys=[ttl_title_no" in x and ", id" in x.split("functions")[0]]
