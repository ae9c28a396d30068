"""The stages in order on the small tables: columns kept, decisions in effect."""
import brute
import corpus_pipeline as P
from conftest import SCHEMA, SF

from tenura.llm import decontaminate, linededup, minhash, mixing


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_copies", "benchmark_leaks", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        assert 0 < n <= before and docs.select("doc_id").distinct().count() == n
        assert docs.columns == (cols if k < 4 else [*cols, "copies"])
        before = n
    assert docs.filter("copies < 1 or copies > 3").isEmpty()
    left = decontaminate.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.filter("contaminated").isEmpty()


def test_run_against_brute_force(spark, hard, benchmark_items, tmp_path):
    """run()'s rows: brute force over what the language stage keeps, then the mix of exactly those rows."""
    rows = [r for r in hard if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = {r.doc_id for r in P.language(spark, docs, str(tmp_path)).collect()}
    words = {r[0]: brute.WORD.findall(r[1] or "") for r in rows}
    prose = {r[0] for r in rows if r[0] < 5000 and r[2] and len(words[r[0]]) >= 20}
    assert len(prose & known) >= 0.97 * len(prose) and not known & {5000, 5001, 5002, 5020}

    kept = [r for r in rows if r[0] in known]
    text = brute.boilerplate([(r[0], r[1], r[3]) for r in kept], linededup.MIN_SITES)
    kept = [(d, text[d], lang, s, n if text[d] == t else len(text[d])) for d, t, lang, s, n in kept]
    first = {d for d, _, c in brute.near_duplicates([r[:2] for r in kept], minhash.SHINGLE, minhash.PERCENT) if d == c}
    kept = [r for r in kept if r[0] in first]
    items = [tuple(r) for r in benchmark_items.select("item_id", "text").collect()]
    leaks = {x[0] for x in brute.contamination([r[:2] for r in kept], items, decontaminate.WINDOW) if x[5]}
    kept = [r for r in kept if r[0] not in leaks]
    assert leaks and len(first) < len(known)

    got = {tuple(r) for r in P.run(spark, str(tmp_path)).collect()}
    want = {tuple(r) for r in mixing.mixed_documents(spark.createDataFrame(kept, SCHEMA)).collect()}
    assert got == want and got


def test_stages_on_empty_tables_and_clashing_columns(spark, hard_df, benchmark_items, tmp_path):
    benchmark_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = hard_df
    extra = ("did", "uid", "row", "c_did", "a", "b", "v", "key", "rest", "n", "line", "hit", "size", "src", "score")
    for c in extra:
        clash = clash.selectExpr("*", f"1 as {c}")
    for name, stage in P.STAGES:
        none = stage(spark, hard_df.limit(0), str(tmp_path))
        assert none.collect() == [] and none.columns[:5] == hard_df.columns, name
        plain, wide = stage(spark, hard_df, str(tmp_path)), stage(spark, clash, str(tmp_path))
        assert [c for c in wide.columns if c not in extra] == plain.columns, name
        key = lambda r: str(r)
        assert sorted(plain.collect(), key=key) == sorted(wide.select(plain.columns).collect(), key=key), name
