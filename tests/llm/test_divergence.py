"""Source divergence against a brute-force count."""
import re
from collections import Counter, defaultdict

import pytest
from brute import LOWER
from conftest import SCHEMA, row

from tenura.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, min_docs, top):
    docs = [((lang or ""), (source or ""), Counter(TERM.findall((text or "").translate(LOWER)))) for _, text, lang, source, *_ in docs]
    seen, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        seen[lang].update(c.keys())
        groups[lang, source].update(c)
        langs[lang].update(c)
    out = []
    for (lang, source), c in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = share(c), share(langs[lang])
        found = {"pair": [], "term": [(p[t] - q[t], t) for t in kept if c[t] and p[t] > q[t]]}
        for (other_lang, other), d in groups.items():
            if other_lang == lang and other != source:
                o = share(d)
                found["pair"].append((sum(abs(p[t] - o[t]) for t in kept), other))
        for part, rows in found.items():
            rows.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, v, r) for r, (v, item) in enumerate(rows, 1) if part == "pair" or r <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_divergence(hard, hard_df, monkeypatch, small):
    if small:                     # every cut: blocks, runs, tiles, pieces
        for name, v in (("BLOCK_BYTES", 20_000), ("RUN_ROWS", 7), ("TILE", 3), ("TERMS", 4), ("SALTS", 2)):
            monkeypatch.setattr(divergence, name, v)
    docs = [*hard, row(7000, "a-b a.b a,a dog dog. (dog) dog-dog", "xx", "s1"), row(7001, "dog, b", "xx", "s2"),
            row(7001, "dog, b", "xx", "s2"), row(7002, "lonely", None, None), row(7003, None, "yy", "s1"), row(7004, "q", "yy", "s2")]
    df = hard_df.sparkSession.createDataFrame(docs, SCHEMA).repartition(4)
    want = brute(docs, 3, 20)
    assert got(divergence.divergence(df, min_docs=3, top=20)) == want
    assert {r[:3] for r in want} >= {("xx", "s1", "term"), ("yy", "s1", "pair"), ("xx", "s2", "pair")}


def test_a_document_with_several_chunks_of_a_term_counts_once(spark):
    docs = [row(i, "dog, dog. (dog) Dog", "en", f"s{i % 2}") for i in range(4)] + [row(9, "cat", "en", "s0")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert {r.term for r in divergence.kept_terms(df, 5).collect()} == set()
    (r,) = divergence.kept_terms(df, 4).collect()
    assert r.term == "dog" and sorted(r.occs) == [8, 8]


def test_divergence_of_an_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(divergence.divergence(empty)) == []
    docs = [row(i, "dog dog cat", "en", f"s{i % 3}") for i in range(9)]
    df = spark.createDataFrame(docs, SCHEMA)
    more = df.selectExpr("*", "1 as sid", "2 as term", "'x' as chunk", "3 as idx", "4 as n", "5 as v", "6 as all", "7 as item",
                         "8 as rank", "9 as value", "'z' as part")
    assert got(divergence.divergence(more, 3)) == brute(docs, 3, 50)
