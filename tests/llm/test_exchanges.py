"""How often the texts are shuffled."""
import re

from tenura.llm import repeats
from tenura.llm.suffix import dedup_bytes


def test_contexts_and_digest_share_the_exchange_of_the_texts(spark):
    # blocks of one anchor that differ, so contexts are fetched
    head, tail = "the quick brown fox jumps over the lazy dog " * 4, "pack my box with five dozen liquor jugs " * 4
    docs = spark.createDataFrame([(i, f"{i * 7919} {head}{i} {tail}{i * 31}") for i in range(60)], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_bytes(docs, texts=False)
        assert sum(r.n_removed for r in out.collect()) > 0
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert re.search(r"ReusedExchange \[did#\d+L, (uid#\d+L, )?text#\d+\]", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_anchors_of_very_many_blocks_share_that_exchange(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_ROWS", 8)
    head, tail = "the quick brown fox jumps over the lazy dog " * 4, "pack my box with five dozen liquor jugs " * 4
    docs = spark.createDataFrame([(i, f"{i * 7919} {head}{i} {tail}{i * 31}") for i in range(60)], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_bytes(docs, texts=False)
        rows = {r.doc_id: tuple(r) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # narrow contexts, wide contexts and digest: one exchange of the texts, used again twice
        assert len(re.findall(r"ReusedExchange \[did#\d+L, (?:uid#\d+L, )?text#\d+\]", plan)) == 2
        monkeypatch.undo()
        assert rows == {r.doc_id: tuple(r) for r in dedup_bytes(docs, texts=False).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
