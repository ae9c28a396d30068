"""Silver -> gold build: products materialised as committed versions, checks fail fast."""
import pytest

from tenura.plans import build as B
from tenura.plans.layout import read_current

SMALL = "/root/testdata/sf0.001"


def test_build_materialises_and_checks(spark, tmp_path):
    from tenura.sources.adapters import RegistryTables
    t = RegistryTables(spark, SMALL)
    root = str(tmp_path / "gold")
    versions = B.build(spark, t, root)
    assert sorted(versions) == sorted(B.gold_products(t))
    assert read_current(spark, root, "dim_title").count() == t.title.count()
    assert read_current(spark, root, "title_360").count() == t.title.count()
    searched = read_current(spark, root, "title_search_table")
    assert searched.count() == t.title.count() and "appellations_norm" in searched.columns
    assert read_current(spark, root, "address_search_table").where("title_no IS NULL").count() == 0
    # a product with a repeated title fails its check inside the job
    bad = {"dim_title": t.title.select("title_no").unionByName(t.title.select("title_no").limit(1))}
    with pytest.raises(Exception, match="duplicate title_no"):
        B.build(spark, t, str(tmp_path / "bad"), products=bad)


def test_silver_from_extracts_feeds_every_gold_product(spark, tmp_path):
    """Text extracts, conformed by their specs, have every column that gold reads: same rows as from the views."""
    from tenura.plans import gold as G
    from tenura.sources.adapters import ConformedTables, RegistryTables
    t = RegistryTables(spark, SMALL)
    c = ConformedTables(t)
    for build in (lambda s: G.dim_title(s.title, s.land_district), lambda s: G.dim_appellation(s.appellation),
                  lambda s: G.fact_title_instrument(s.title_instrument_title, s.title_instrument, s.transaction_type),
                  lambda s: G.dim_address(s.address_point, s.address_component, s.title_parcel_association)):
        a, b = build(t), build(c)
        assert a.columns == b.columns
        text = lambda d: d.select([d[x].cast("string") for x in d.columns])
        assert text(a).exceptAll(text(b)).count() == 0 and text(b).exceptAll(text(a)).count() == 0


def test_an_empty_table_is_present_and_an_absent_one_is_missing(spark):
    from tenura.plans import quality as D
    there = {"title": spark.range(3), "estate": spark.range(0)}
    present = D.present_tables(there)
    assert {r.table_name: r.has_rows for r in present.collect()} == {"title": True, "estate": False}
    assert [r.table_name for r in D.require_tables(spark, ["title", "estate", "parcel"], present).collect()] == ["parcel"]


def test_files_of_about_the_bytes_asked_for(spark, tmp_path):
    from pyspark.sql import functions as F
    from tenura.plans.layout import byte_sized_write
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    out = tmp_path / "sized"
    n = byte_sized_write(df, str(out), 2_000_000, scratch=str(tmp_path / "scratch"))
    sizes = [p.stat().st_size for p in out.glob("*.parquet")]
    assert len(sizes) == n > 3 and all(0.7 * 2_000_000 < x < 1.4 * 2_000_000 for x in sizes)
    assert spark.read.parquet(str(out)).count() == 200_000
    assert byte_sized_write(df.limit(0), str(tmp_path / "none"), 2_000_000, scratch=str(tmp_path / "scratch0")) == 1
