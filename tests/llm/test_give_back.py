"""Workers give freed memory back before the near copies' first stage."""
import numpy as np
import pyarrow as pa

from tenura.llm import minhash, textops


def _resident():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS:")).split()[1]) / 1024


def test_freed_vectors_leave_the_process():
    # as a language model's vectors: small pieces, one in a thousand outlives the rest
    kept = [np.ones(64) for _ in range(400_000)]
    full = _resident()
    kept = kept[::1000]
    freed = _resident()
    textops.give_back()
    assert full - _resident() > 100 and freed - _resident() >= -1


def test_sketch_gives_back_first(monkeypatch):
    calls = []
    monkeypatch.setattr(textops, "give_back", lambda: calls.append(1))
    one = pa.RecordBatch.from_pydict({"did": [1], "uid": [0], "text": ["a b c d"]})
    out, = minhash._sketch(4)(iter([one]))
    assert calls and out.column("n_shingles").to_pylist() == [1]


def test_the_driver_keeps_nothing_of_a_language_model(spark):
    from pyspark.sql import functions as F

    from tenura.llm import langid
    from tenura.session import ship_package

    ship_package(spark)
    letters = F.translate(F.sha2(F.concat_ws("-", "id", "k"), 256), "0123456789", "ghijklmnop")
    docs = (spark.range(3000).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
            .groupBy("id").agg(F.concat_ws(" ", F.collect_list(F.substring(letters, 1, 10))).alias("text"))
            .select(F.col("id").alias("doc_id"), "text", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang")))
    out = langid.known_language(docs)
    held = _resident()
    textops.give_back()
    assert held - _resident() < 20
    assert out.limit(1).count() == 1
