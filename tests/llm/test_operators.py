"""Each operator against a brute-force version on a small hard fixture."""
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import SCHEMA, row

from tenura.llm import (decontaminate, langid, linededup, minhash, mixing, quality, rules, substring, suffix,
                        urlcascade)


def rows_of(df, *cols):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(hard, hard_df, benchmark_items):
    items = [tuple(r) for r in benchmark_items.select("item_id", "text").collect()]
    got = rows_of(decontaminate.contamination_report(hard_df, benchmark_items), *CONTAMINATION)
    assert got == ordered(brute.contamination([r[:2] for r in hard], items))
    assert sum(r[5] for r in got) > 2


def test_contamination_in_blocks_and_short_items(spark, hard, hard_df, benchmark_items):
    items = [tuple(r) for r in benchmark_items.select("item_id", "text").collect()]
    items += [(900, "12 34"), (901, None), (902, " !! "), (None, "one"), (0, "Ünïcode")]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(hard_df, df, block_bytes=20_000, keep=["doc_id"])
    got = {(r.row.doc_id, r.hit.n_words, frozenset(r.hit.items)) for r in found.collect()}
    one = decontaminate.find_contamination(hard_df, df, keep=["doc_id"])
    assert got == {(r.row.doc_id, r.hit.n_words, frozenset(r.hit.items)) for r in one.collect()}
    assert rows_of(decontaminate.contamination_report(hard_df, df), *CONTAMINATION) == ordered(
        brute.contamination([r[:2] for r in hard], items))


def test_contamination_offsets(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = "Vorspann: Ä!! " + item.upper().replace(" ", ", ") + " -- end"
    docs = spark.createDataFrame([row(1, text)], SCHEMA)
    (r,) = decontaminate.find_contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    a, b = decontaminate.original_span(text, min(s.first for s in r.hit.spans), max(s.end for s in r.hit.spans))
    assert text.encode()[a:b].decode() == item.upper().replace(" ", ", ")


def test_bytes_dedup(hard, hard_df):
    got = rows_of(suffix.suffix_report(hard_df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == ordered(brute.bytes_dedup([r[:2] for r in hard]))


def test_bytes_dedup_doubled_in_spark(hard, hard_df, monkeypatch):
    from tenura.llm import repeats
    monkeypatch.setattr(repeats, "GROUP_ROWS", 1)
    got = rows_of(suffix.suffix_report(hard_df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == ordered(brute.bytes_dedup([r[:2] for r in hard]))


@pytest.mark.parametrize("group_rows", [1, 4096])
def test_words_dedup(hard, hard_df, monkeypatch, group_rows):
    from tenura.llm import repeats
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    got = rows_of(substring.substring_report(hard_df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.words_dedup([r[:2] for r in hard]))
    assert sum(r[2] for r in got) > 1000


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([row(1, "a " + passage), row(2, "b  " + passage + "\nc")], SCHEMA)
    got = {r.doc_id: r.kept_text for r in substring.dedup_substrings(docs).collect()}
    assert got == {1: "a " + passage, 2: "b c"}


def test_near_duplicates(hard, hard_df):
    rows = [r[:2] for r in hard if r[0] is not None]
    got = rows_of(minhash.near_duplicate_report(hard_df.filter("doc_id is not null")),
                  "doc_id", "n_shingles", "component_id", "kept")
    assert got == ordered((d, n, c, c == d) for d, n, c in brute.near_duplicates(rows))


def test_near_duplicate_chains_beyond_the_least(spark):
    """a-b-c-... where only neighbours are similar, in many shared buckets."""
    docs, words = [], [f"w{i}" for i in range(400)]
    for i in range(60):
        docs.append(row(100 - i, " ".join(words)))
        words = words[12:] + [f"n{i}_{j}" for j in range(12)]
    other = " ".join(f"w{i}" for i in range(150))
    docs += [row(1000 + i, other + " " + " ".join(f"u{i}_{j}" for j in range(250))) for i in range(80)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = rows_of(minhash.near_duplicate_report(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == ordered((d, n, c, c == d) for d, n, c in brute.near_duplicates([r[:2] for r in docs]))


def test_cells_look_at_a_pair_whose_low_bytes_agree_in_an_earlier_band():
    import numpy as np
    import pyarrow as pa
    sig = np.random.default_rng(3).integers(0, 1 << 32, minhash.BANDS * minhash.ROWS, dtype=np.uint32)
    other = sig.copy()
    other[:minhash.ROWS] ^= 1 << 20        # band 0: low bytes agree, minima differ
    keys = [minhash._band_keys(x[None])[0] for x in (sig, other)]
    assert keys[0][0] != keys[1][0] and (keys[0][1:] == keys[1][1:]).all()
    words = np.arange(100, dtype=np.uint32).tobytes()

    def pairs(band):
        cell = pa.RecordBatch.from_pydict({
            "key": [int(keys[0].view(np.int64)[band])] * 2, "band": pa.array([band] * 2, pa.int32()), "c0": [0, 0], "c1": [0, 0],
            "i": [0, 0], "v": [1, 2], "comp": [1, 2], "sig": [(x & 255).astype(np.uint8).tobytes() for x in (sig, other)],
            "set": [words] * 2, "keys": [x.tobytes() for x in keys]})
        return [(r["a"], r["b"]) for out in minhash._cells(80)(iter([cell])) for r in out.to_pylist()]

    assert pairs(1) == [(1, 2)] and pairs(2) == []


def test_compact_sets_carry_the_keys_of_the_buckets(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(40))) for i in range(20)], "v long, text string")
    sketch = docs.selectExpr("v as did", "0L as uid", "text").mapInArrow(
        minhash._sketch(4), "did long, uid long, n_shingles long, s1 long, s2 long, sig binary")
    want = {}
    for r in sketch.selectExpr("did as v", "sig").mapInArrow(minhash._bands, "key long, v long, band int").collect():
        want.setdefault(r.v, {})[r.band] = r.key
    import numpy as np
    got = docs.mapInArrow(minhash._compact(4), "v long, sig binary, set binary, keys binary").collect()
    assert {r.v: dict(enumerate(np.frombuffer(r["keys"], np.int64).tolist())) for r in got} == want


def test_one_of_each_with_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([row(3, t), row(3, t), row(3, "something else entirely here now"), row(4, t.upper()),
                                  row(5, None), row(5, None), row(None, t), row(6, "")], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in minhash.one_of_each(docs).collect())
    assert got == Counter([(3, t), (3, "something else entirely here now"), (5, None), (6, "")])


def test_line_dedup(spark, hard):
    line, rare = "Copyright notice of the network", "Seen on a few sites only"
    docs = [r for r in hard if r[0] is not None]
    docs += [row(7000 + i, f"start {i}\n {line} \nend {i}\n{line}", source=f"s{i % 14}") for i in range(40)]
    docs += [row(7100 + i, f"{rare}\nend b {i}", source=f"s{i % 9}") for i in range(30)]
    docs += [row(7200 + i, f"end c {i}\nexactly ten sites", source=f"s{i % 10}") for i in range(30)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r.text for r in linededup.without_boilerplate(df).collect()}
    assert got == brute.boilerplate([(r[0], r[1], r[3]) for r in docs], linededup.MIN_SITES)
    assert rare in got[7129] and line in got[7000] and line not in got[7001]
    report = {r.doc_id: r for r in linededup.line_report(df).collect()}
    assert report[7001].n_removed == 2 and report[7001].n_lines == 4 and report[5000].n_lines == 0


def test_mix(hard, hard_df):
    out = mixing.mix_report(hard_df).collect()
    assert len(out) == len(hard)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_report(hard_df.repartition(3)).collect()))   # reruns agree
    size, weight = defaultdict(int), {}
    for r in hard:
        size[r[3]] += len(brute.WORD.findall(r[1] or ""))
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    total, target, fixed = sum(size.values()), {}, {}
    while True:
        free = [s for s in size if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    target = {s: fixed.get(s, level * weight[s]) for s in size}
    source = {r[0]: r[3] for r in hard}
    taken, largest = Counter(), Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_pivotal_expectation():
    rows = [(i, (i, 0), 10 + i % 7, 0.3) for i in range(40)]
    total = Counter()
    for seed in range(300):
        for r in mixing.settle(rows, 0, True, seed):
            assert r[3] in (0.0, 1.0)
            total[r[0]] += r[3]
    assert all(0.15 < total[i] / 300 < 0.45 for i in range(40))


def test_mixed_documents(hard_df):
    got = mixing.mixed_documents(hard_df)
    assert set(got.columns) == {*hard_df.columns, "copies"}
    want = {r.doc_id: r.copies for r in mixing.mix_report(hard_df).collect() if r.copies}
    assert {r.doc_id: r.copies for r in got.collect()} == want


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rule_statistics(hard, hard_df, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = rules.quality_report(hard_df, labels)
    assert rows_of(out, "doc_id", *STATS) == ordered((r[0], *brute.text_stats(r[1])) for r in hard)
    assert all(not (r.base_failed and r.kept) for r in out.collect())


def test_decision_list_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    stats = rules.text_stats(docs).persist()
    even = labels.filter("doc_id % 2 = 0").selectExpr("doc_id", "quality as label")
    learned = rules.learn(stats, even)
    assert learned and all(len(r.conditions) <= rules.MAX_CONDITIONS for r in learned)
    odd = stats.join(labels.filter("doc_id % 2 = 1"), "doc_id").withColumn("said", rules.decision(learned))
    rows = odd.select("quality", "said").collect()
    assert sum(r.quality == r.said for r in rows) / len(rows) > 0.93
    assert rules.learn(stats, even.limit(0)) == []


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_report(docs).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    held = [r for r in out if r.held_out and lang[r.doc_id][0]]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, hard_df):
    got = {r.doc_id: r for r in langid.language_report(hard_df).collect()}
    for i in (5000, 5001, 5002, 5020):
        assert got[i].lang_pred == "und" and got[i].score == 0
    empty = hard_df.limit(0)
    assert langid.language_report(empty).collect() == []
    none = langid.language_report(hard_df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_every_labelled_language_and_sampled_word_is_known(spark):
    """Many long documents of one language, one short one of each of two others, one in its own script."""
    import random
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows, k = [], 0

    def add(lang, text):
        nonlocal k
        while zlib.crc32(str(k).encode()) % 4 == 2:          # held out
            k += 1
        rows.append(row(k, text, lang))
        k += 1
    for _ in range(80):
        words = [word() for _ in range(1000)]
        add("aa", " ".join(words + words))
    add("zz", "zuxy vuzzy ruxt")
    add("gr", "αβγδ εζηθ")
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["aa", "gr", "zz"]
    trained = {w for r in rows for w in langid.words_of(r[1])}
    assert len(trained) > 70_000 and all(model.words.get(w) is not None for w in trained)
    assert model.predict("αβγδ")[0] == "gr" and model.predict("αβγδ")[1] >= langid.MIN_SCORE
    assert model.predict("vuzzy zuxy")[0] == "zz" and model.predict(rows[3][1])[0] == "aa"


def test_language_model_is_shipped_without_python_strings(spark):
    import pickle
    rows = [row(k, t, lang) for k, (t, lang) in enumerate([("the house and the dog", "en"), ("la maison et le chien", "fr")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert all(t.at is None for t in (model.words, *model.grams.values()))
    sent = pickle.loads(pickle.dumps(model))
    for text, lang in (("the dog", "en"), ("le chien", "fr"), ("houses", "en")):
        assert sent.predict(text) == model.predict(text) and sent.predict(text)[0] == lang


def test_language_backs_off():
    import numpy as np
    m = langid.Model(["a", "b"], {"known": np.array([1.0, -1.0])},
                     {5: {" neul": np.array([-2.0, 2.0])}, 1: {"x": np.array([3.0, -3.0])}})
    assert m.predict("known")[0] == "a" and m.predict("neuling")[0] == "b" and m.predict("zx")[0] == "a"


def test_url_rules(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    pages += [(9000 + i, u) for i, u in enumerate([
        None, "", "nothing", "http://COM/", "http://com", "http://a.com?x=/", "http://example.com/en/1",
        "ftp://WWW.Example.com/en/", "http://www.example.com/en", "http://b.www.example.com/en/x#y", "http://notexample.com/en/",
        "x://a.net/es/#q", "x://a.net/es", "x://net/fr/a?b", "x://.net/fr/", "http://a.com/x://b.net/es/", "://net/es/\n1",
        "http://"])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = rows_of(urlcascade.url_report(spark, df), "page_id", "host", "path", "rule", "verdict")
    want = []
    for i, u in pages:
        h, p, r, v = brute.judge(u, urlcascade.RULES)
        want.append((i, h, p, r, v or "allow"))
    assert got == ordered(want)


def test_cascade_is_exact(spark):
    universe = spark.range(30_000).selectExpr("concat('k', id) as full")
    listed = spark.range(0, 30_000, 97).selectExpr("concat('k', id) as full").union(
        spark.createDataFrame([("absent",)], "full string"))
    c = urlcascade.Cascade.build(listed, universe, 1, bits_per_key=3)
    assert len(c.levels) > 2
    got = {r.full for r in universe.filter(c.contains(universe["full"])).collect()}
    assert got == {f"k{i}" for i in range(0, 30_000, 97)}


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.filter("doc_id % 3 > 0")
    out = {r.doc_id: r for r in quality.quality_report(docs, train).collect()}
    test = [r for r in labels.filter("doc_id % 3 = 0").collect() if r.doc_id in out]
    right = sum((out[r.doc_id].quality >= 0.5) == bool(r.quality) for r in test) / len(test)
    toxic = [r for r in test if r.toxic]
    clean = [r for r in test if not r.toxic]
    assert right > 0.98
    assert sum(out[r.doc_id].toxic >= 0.5 for r in toxic) / len(toxic) > 0.75
    assert sum(out[r.doc_id].toxic >= 0.5 for r in clean) / len(clean) < 0.02
    assert out


def test_quality_edges(hard_df):
    got = {r.doc_id: r for r in quality.quality_report(hard_df, None).collect()}
    assert got[5000].quality == 0 and got[5001].quality == 0 and not got[5000].kept
    assert quality.quality_report(hard_df.limit(0), None).collect() == []


def test_em_finds_the_good_labellers():
    import numpy as np
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.75
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((len(y), 5)) < accuracy, y[:, None], ~y[:, None]) * 2 - 1
    patterns, counts = np.unique(quality.pattern(votes), return_counts=True)
    prior, table = quality.em(patterns, counts.astype(float), 5)
    assert abs(prior - 0.75) < 0.03
    assert np.abs(table[:, 1, 2] - accuracy).max() < 0.04


@pytest.mark.parametrize("name", ["decontaminate", "suffix", "substring", "minhash", "linededup", "mixing", "rules"])
def test_empty_and_clashing_columns(spark, hard_df, benchmark_items, name):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ops = {"decontaminate": lambda d: decontaminate.contamination_report(d, benchmark_items),
           "suffix": suffix.suffix_report, "substring": substring.substring_report,
           "minhash": minhash.near_duplicate_report, "linededup": linededup.line_report, "mixing": mixing.mix_report,
           "rules": lambda d: rules.quality_report(d, labels)}
    assert ops[name](hard_df.limit(0)).collect() == []
    few = hard_df.filter("doc_id >= 5000 or doc_id is null")
    clash = few
    for c in ("did", "uid", "row", "a", "b", "v", "key", "hits", "hit", "size", "rest", "comp", "n", "line"):
        clash = clash.selectExpr("*", f"1 as {c}")
    a, b = ops[name](few), ops[name](clash)
    key = lambda r: str(r)
    if name != "mixing":
        assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    else:
        assert b.count() == few.count()


def doubled(n):
    """Two words of n letters built by x, y -> xy, yx; polynomials modulo 2**64 cannot tell them apart from 1,024 on."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [64, 512, 1024, 4096])
def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark, n):
    x, y = doubled(n)
    tail = " ".join(f"w{i}" for i in range(49))
    docs = [row(1, f"{x} {tail}"), row(2, f"{y} {tail}"), row(3, f"{y}  {tail}\n")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = rows_of(substring.substring_report(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.words_dedup([r[:2] for r in docs])) and [r[2] for r in got] == [0, 0, 50]
    alone = [row(1, x), row(2, y), row(3, f" {y.upper()}")]
    got = rows_of(minhash.near_duplicate_report(spark.createDataFrame(alone, SCHEMA)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False)]
    bytes_docs = spark.createDataFrame([row(1, x * 2), row(2, y * 2)], SCHEMA)
    got = rows_of(suffix.suffix_report(bytes_docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == ordered(brute.bytes_dedup([(1, x * 2), (2, y * 2)]))


def test_span_hashes_modulo_a_prime():
    import numpy as np

    from tenura.llm import textops as T
    p, rng = (1 << 61) - 1, np.random.default_rng(2)
    a, b = (np.concatenate((rng.integers(0, p, 500, dtype=np.uint64), np.array([0, 1, p - 1, p - 1], np.uint64))) for _ in range(2))
    assert T.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    v = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    spans = T.Spans()
    s = spans.sums(v)
    want, at = 0, 1
    for i, x in enumerate(v.tolist(), 1):
        want, at = (want + x % p * at) % p, at * T._BASE % p
        assert int(s[i]) == want
    twice = np.concatenate((v, v[:7], v))
    s = spans.sums(twice)
    assert spans.hashes(s, np.array([0, 5, 3000]), np.array([3000, 9, 3007])).tolist() == spans.hashes(
        s, np.array([3007, 3012, 0]), np.array([6007, 3016, 7])).tolist()


def test_a_passage_that_one_text_repeats_very_often(spark, monkeypatch):
    """By rows, such a seed is compared through a shuffle of window digests."""
    from tenura.llm import repeats
    passage = [f"p{i}" for i in range(60)]
    docs = [row(1, " ".join(" ".join(passage) + f" x{i}" for i in range(300))), row(2, "q " + " ".join(passage[:55]) + " r"),
            row(3, " ".join(passage[3:]) + " x7 " + " ".join(passage))]
    df = spark.createDataFrame(docs, SCHEMA)
    for rows in (4096, 100):
        monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
        got = rows_of(substring.substring_report(df), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == ordered(brute.words_dedup([r[:2] for r in docs]))


def test_near_duplicates_of_long_documents(spark):
    """Half hashes of 32 bits collide by chance in sets this long; only the full sets decide."""
    import random
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(60_000)]

    def changed(words, share, seed):
        r = random.Random(seed)
        w = list(words)
        for i in r.sample(range(len(w)), int(len(w) * share)):
            w[i] = f"n{r.randrange(10**9)}"
        return " ".join(w)
    docs = [row(10, " ".join(base)), row(11, changed(base, 0.027, 1)), row(12, changed(base, 0.0285, 2)), row(13, changed(base, 0.05, 3))]
    df = spark.createDataFrame(docs, SCHEMA)
    got = rows_of(minhash.near_duplicate_report(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == ordered((d, n, c, c == d) for d, n, c in brute.near_duplicates([r[:2] for r in docs]))


@pytest.mark.parametrize("text", ["½", "② ①", "Ⅷ", "12 ¾ 5²", "", None, " \n", "!?"])
def test_texts_without_a_letter_are_und(text):
    model = langid.Model(["en", "fr"], {"the": np.array([1.0, -1.0])}, {})
    assert model.predict(text) == ("und", 0.0)


def test_scripts_that_were_never_seen_have_no_score(spark):
    docs = [row(i, t, lang) for i, (t, lang) in enumerate([("the house and the dog", "en"), ("la maison et le chien", "fr"),
                                                           ("das haus und der hund", "de")] * 20)]
    docs += [row(900, "学 校 は 大 き い です " * 12, None), row(901, "дом и собака " * 40, None), row(902, "the dog", None)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in langid.language_report(df).collect()}
    assert got[900].score == got[901].score == 0.0 and got[900].lang_pred in ("de", "en", "fr")
    assert got[902].lang_pred == "en" and got[902].score > 0.5
    kept = {r.doc_id for r in langid.known_language(df).collect()}
    assert kept == set(range(60)) | {902}


def test_quality_sample_takes_repeated_rows_once(spark, hard):
    """A row that holds most of the table is one row of the sample, with its number as weight."""
    long_text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000))
    rows = hard + [row(5003, "one")] * 400 + [row(7000, long_text)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6).select("doc_id", "text", quality.text_uid("text").alias("uid"))
    docs = docs.filter("text is not null")
    toxic = spark.createDataFrame([(5003, 1), (5004, 0), (9999, 1), (5003, None), (None, 1)], "doc_id long, toxic int")
    chosen = quality.training_labels(spark, toxic, 10 ** 6)
    assert rows_of(chosen, "doc_id", "toxic") == [(5003, 1), (5004, 0), (9999, 1)]
    got = quality.training_features(docs, chosen, 1, 10 ** 6).collect()
    want = Counter((r[0], r[1]) for r in rows if r[1] is not None)
    assert len(got) == len(want) and sorted(r.weight for r in got) == sorted(want.values())
    by_id = {r.doc_id: r for r in got}
    assert by_id[5003].weight == 401 and by_id[5003].toxic == 1 and by_id[5004].toxic == 0
    assert max(len(r.bucket) for r in got) == len(by_id[7000].bucket) == quality.FEATURES
    assert abs(sum(by_id[7000]["count"]) - 4 * 6000) < 1e-3
    few = quality.training_features(docs, chosen, len(rows), 20).collect()
    assert len(few) < 80 and all(r.for_quality or r.toxic is not None for r in few)


def test_quality_of_repeated_rows_is_as_of_weights():
    rng = np.random.default_rng(3)
    row_, col = np.repeat(np.arange(40), 5), rng.integers(0, 30, 200)
    val, y, times = rng.random(200), rng.random(40), rng.integers(1, 4, 40)
    at = np.repeat(np.arange(40), times)
    w, b = quality.logistic(row_, col, val, y, times.astype(float), 1e-6)
    many = np.concatenate([np.flatnonzero(row_ == i) for i in at])
    w2, b2 = quality.logistic(np.repeat(np.arange(len(at)), 5), col[many], val[many], y[at], np.ones(len(at)), 1e-6)
    assert np.abs(w - w2).max() < 1e-9 and abs(b - b2) < 1e-9


@pytest.mark.parametrize("name", ["quality", "langid"])
def test_empty_repeated_and_clashing_columns(spark, hard_df, name):
    labels = spark.createDataFrame([(5007, 1, 0), (None, 1, 1), (5008, None, None)], "doc_id long, quality int, toxic int")
    op = {"quality": lambda d: quality.quality_report(d, labels), "langid": langid.language_report}[name]
    assert op(hard_df.limit(0)).collect() == []
    few = hard_df.filter("doc_id >= 5000 or doc_id is null")
    clash = few
    for c in ("uid", "row", "toxic", "weight", "n", "count", "for_quality", "kind", "item", "score"):
        clash = clash.selectExpr("*", f"1 as `{c}`")
    once, twice = op(few).collect(), op(clash.unionByName(clash)).collect()
    assert len(twice) == 2 * len(once)
    of = lambda rows: Counter(str(r.doc_id) for r in rows)
    assert of(twice) == Counter({k: 2 * n for k, n in of(once).items()})
    if name == "langid":
        said = {r.doc_id: r.lang_pred for r in once}
        assert all(said[r.doc_id] == r.lang_pred for r in twice)


def test_url_filter_empty_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None), (None, "ftp://www.example.com/en/q"), (1, "http://a.com/x")],
                                  "page_id long, url string")
    assert urlcascade.url_report(spark, pages.limit(0)).collect() == []
    clash = pages
    for c in ("row", "host", "path", "keys", "full", "hit", "rule", "verdict"):
        clash = clash.selectExpr("*", f"1 as {c}")
    key = lambda r: str(r)
    got = sorted(urlcascade.url_report(spark, clash).collect(), key=key)
    assert got == sorted(urlcascade.url_report(spark, pages).collect(), key=key) and len(got) == 4
