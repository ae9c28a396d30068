import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, lang="en", source="src0"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tenura.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def hard(spark, documents, benchmark_items):
    """The documents plus nulls, empties, copies, near copies, shared passages and a long text; unique ids."""
    base = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in benchmark_items.collect()]
    text = next(r[1] for r in base if r[1] and len(r[1].split()) > 400)
    w = text.split()
    near = " ".join(x if i % 60 else "changed" for i, x in enumerate(w))
    near2 = " ".join(x if i % 45 else "other" for i, x in enumerate(w))
    passage = " ".join(f"p{i}" for i in range(90))
    extra = [row(5000, None), row(5001, ""), row(5002, " \n\t "), row(5003, "one"), row(5004, "one"), row(5005, "A b C"),
             row(5006, "a B c"), row(5007, text), row(5008, text, source=None), row(5009, near), row(5010, near2, None),
             row(5011, "x " + passage + " y"), row(5012, "z " + passage), row(5013, passage + " q " + passage),
             row(5014, "word " * 3000), row(5015, "Ünïcode ß ß ß " * 40), row(5016, items[0] + " tail words here"),
             row(5017, "lead " + items[1].upper() + " " + items[0]), row(5018, "\n".join(w[:300])),
             row(5019, " ".join(w * 20)), row(None, text), row(5020, "12 34 56 !!"), row(5021, "ab" * 400)]
    return base + extra


@pytest.fixture(scope="session")
def hard_df(spark, hard):
    return spark.createDataFrame(hard, SCHEMA).repartition(5)
