"""SimHash against all pairs compared."""
import random

import numpy as np
import pytest
import xxhash
from brute import LOWER, WORD
from conftest import SCHEMA, row

from tenura.llm import simhash


def brute_fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, radius=4):
    """[(did, hex, component)]; a null id is last."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    f = [(key(d), brute_fingerprint(t)) for d, t in docs]
    nodes = sorted({x for _, x in f})
    up = list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    of = {x: find(i) for i, x in enumerate(nodes)}
    least = {}
    for d, x in f:
        least[of[x]] = min(d, least.get(of[x], d))
    null = lambda d: None if d == (1 << 63) - 1 else d
    return sorted(((null(d), f"{x:016x}", null(least[of[x]])) for d, x in f), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_simhash(hard, hard_df):
    assert got(simhash.simhash_report(hard_df)) == brute([r[:2] for r in hard])


def test_fingerprint_of_long_and_short_texts(monkeypatch):
    text = "Ünïcode A b C d " * 500 + "x" * 5000
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == brute_fingerprint("one TWO")


def components(nodes, radius):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("cell,radius", [(4096, 4), (8, 4), (3, 3)])
def test_links_in_hot_buckets(spark, monkeypatch, cell, radius):
    """Walks of a few bits around a few centres: chains that no hub covers, in buckets of many cells."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "TASKS", 16)
    rnd = random.Random(5)
    nodes = set()
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(40):
            for b in rnd.sample(range(20), rnd.choice([1, 2, 4, 5, 9])):
                x ^= 1 << b
            nodes.add(x - (1 << 64) if x >> 63 else x)
    nodes = sorted(nodes | {0, -1})
    df = spark.createDataFrame([(x, rnd.randint(1, 3)) for x in nodes], "fp long, w long")
    groups = {}
    for r in simhash.linked(df, radius).collect():
        groups.setdefault(r.comp, set()).add(r.v)
    linked = {frozenset(g) for g in groups.values()}
    assert linked == {g for g in components(nodes, radius) if len(g) > 1}
    assert len(linked) > 3


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 128, dtype=np.uint64)
    fp[5] = fp[70] ^ np.uint64(0b1011)
    fp[6] = fp[70] ^ np.uint64(0b11011)
    fp[7] = fp[70] ^ np.uint64(0b111011)
    for radius in (0, 1, 2, 3, 4, 5, 6, 31, 40):
        q = np.repeat(fp, 2)
        w = np.tile([0, 1], 128)
        left, mask = simhash.within(simhash.bit_planes(fp), q, w, radius)
        found = {(int(t) // 2, int(w[t]) * 64 + k) for t, m in zip(left, mask, strict=True) for k in range(64) if int(m) >> k & 1}
        want = {(i, j) for i in range(128) for j in range(128) if int(fp[i] ^ fp[j]).bit_count() <= radius}
        assert found == want


def test_cells_repeat_members_of_the_largest_component_once(spark):
    """12,000 members of one component and one other: about one row each."""
    from tenura.llm.cells import deal
    at = spark.range(12_001).selectExpr("1 as key", "id as v", "if(id = 12000, 1, 0) as comp")
    dealt = deal(at, ["key"], "v", 1024)
    assert dealt.count() < 12_100
    cells = {}
    for r in dealt.select("v", "c0", "c1").collect():
        cells.setdefault((r.c0, r.c1), []).append(r.v)
    assert sum(len(c) - 1 for c in cells.values() if 12_000 in c) == 12_000 and max(map(len, cells.values())) < 1_300


def test_simhash_of_an_empty_table_and_clashing_columns(spark):
    assert got(simhash.simhash_report(spark.createDataFrame([], SCHEMA))) == []
    docs = [row(i, t) for i, t in enumerate(["a b c d e", "A b c d E", None, "", "z", None])]
    df = spark.createDataFrame([*docs, docs[0]], SCHEMA).selectExpr("*", "1 as fp", "2 as did", "3 as comp", "4 as w")
    assert got(simhash.simhash_report(df)) == brute([r[:2] for r in [*docs, docs[0]]])
