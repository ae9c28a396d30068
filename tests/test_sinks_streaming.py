import json

from pyspark.sql import functions as F

from tenura.plans import layout as K
from tenura.plans import quality as D
from tenura.streaming.manifest_stream import run_manifest_stream


def test_write_table_overwrite_then_append(spark, tmp_path):
    df = spark.range(10)
    p = str(tmp_path / "t")
    K.write_table(df, p, "overwrite")
    K.write_table(df, p, "append")
    assert spark.read.parquet(p).count() == 20
    K.write_table(df, p, "overwrite")
    assert spark.read.parquet(p).count() == 10


def test_cluster_and_sized_write(spark, tmp_path):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    p = str(tmp_path / "c")
    K.cluster_write(df, ["k"], p, n_files=4)
    parts = spark.read.parquet(p).withColumn("f", F.input_file_name())
    ranges = parts.groupBy("f").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))          # disjoint key ranges per file
    q = str(tmp_path / "s")
    K.sized_write(df, q, rows_per_file=100)
    files = spark.read.parquet(q).groupBy(F.input_file_name()).count().collect()
    assert max(r[1] for r in files) <= 100 and sum(r[1] for r in files) == 1000


def test_refresh_reads_newest_committed_version(spark, tmp_path):
    root = str(tmp_path / "m")
    v1 = K.refresh(spark, spark.range(5), root, "dim_title_search")
    assert K.read_current(spark, root, "dim_title_search").count() == 5
    v2 = K.refresh(spark, spark.range(7), root, "dim_title_search", keys=["id"])
    assert v1 != v2 and K.read_current(spark, root, "dim_title_search").count() == 7
    # a version still being written (no commit marker yet) is not visible
    half = tmp_path / "m" / "dim_title_search" / "v-999999999999999-zzzz"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"not yet")
    assert K.read_current(spark, root, "dim_title_search").count() == 7
    # older committed versions beyond `keep` are pruned after a successful refresh
    K.refresh(spark, spark.range(9), root, "dim_title_search", keep=2)
    assert not (tmp_path / "m" / "dim_title_search" / v1.rsplit("/", 1)[1]).exists()
    assert K.read_current(spark, root, "dim_title_search").count() == 9


def test_export_csv_has_header(spark, tmp_path):
    p = str(tmp_path / "csv")
    K.export_csv(spark.createDataFrame([(1, "a")], "id int, v string"), p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["id", "v"] and back.count() == 1


def test_assert_empty_raises_inside_the_job(spark):
    missing = spark.createDataFrame([("statute",)], "table_name string")
    import pytest
    with pytest.raises(Exception, match="Missing required tables: statute"):
        D.assert_empty(missing, "Missing required tables: ").collect()
    assert D.assert_empty(missing.where("false"), "x").first()[0] == "ok"
    many = spark.range(1000).selectExpr("lpad(cast(id as string), 4, '0') as k")
    with pytest.raises(Exception, match="dupes: 0000, 0001, 0002, ..."):
        D.assert_empty(many, "dupes: ", show=3).collect()


def test_manifest_stream_is_incremental_and_idempotent(spark, tmp_path):
    landing, control, ckpt = tmp_path / "landing", str(tmp_path / "control"), str(tmp_path / "ckpt")
    landing.mkdir()

    def snap(name, rows):
        (landing / name).write_text("\n".join(json.dumps(r) for r in rows))

    snap("s1.json", [{"relative_path": "stage/registry-x-title.dbf", "size": 1, "md5": "a",
                      "last_modified": "2024-01-01T00:00:00", "snapshot_at": "2024-01-01T00:00:00"},
                     {"relative_path": "stage/registry-x-estate.dbf", "size": 2, "md5": None,
                      "last_modified": "2024-01-01T00:00:00", "snapshot_at": "2024-01-01T00:00:00"}])
    run_manifest_stream(spark, str(landing), control, ckpt)
    assert spark.read.parquet(control).count() == 2
    # a later snapshot repeats one file (same md5, NULL md5 = '') and adds one new file
    snap("s2.json", [{"relative_path": "stage/registry-x-estate.dbf", "size": 2, "md5": "",
                      "last_modified": "2024-01-02T00:00:00", "snapshot_at": "2024-01-02T00:00:00"},
                     {"relative_path": "stage/registry-x-title.dbf", "size": 3, "md5": "b",
                      "last_modified": "2024-01-02T00:00:00", "snapshot_at": "2024-01-02T00:00:00"}])
    run_manifest_stream(spark, str(landing), control, ckpt)
    run_manifest_stream(spark, str(landing), control, ckpt)          # nothing new: no change
    c = spark.read.parquet(control)
    assert c.count() == 3
    assert {r.source_entity for r in c.collect()} == {"title.dbf", "estate.dbf"}
    # replay: a fresh checkpoint re-processes every snapshot (as after a lost offset
    # commit); the anti-join against the control table keeps the sink unchanged
    run_manifest_stream(spark, str(landing), control, str(tmp_path / "ckpt-replay"))
    assert spark.read.parquet(control).count() == 3


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    import uuid
    a, b = f"t_a_{uuid.uuid4().hex[:8]}", f"t_b_{uuid.uuid4().hex[:8]}"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        K.bucketed_table(spark.range(1000).selectExpr("id as k", "id * 2 as v"), a, ["k"], 8, path=str(tmp_path / a))
        K.bucketed_table(spark.range(500).selectExpr("id as k", "id * 3 as w"), b, ["k"], 8, path=str(tmp_path / b))
        j = spark.table(a).join(spark.table(b), "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and j.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE IF EXISTS {a}")
        spark.sql(f"DROP TABLE IF EXISTS {b}")
