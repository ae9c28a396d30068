"""Operator 2, quality classifier from weak labels.

Nine heuristic labellers vote bad (-1), nothing (0) or good (1) on every document.  The
votes overlap, and nobody knows which labeller is right how often: expectation-maximisation
estimates, from the counts of all vote patterns of the corpus (at most 3**9, counted in
Spark), each labeller's vote probabilities given the hidden class.  The posterior of a
document's pattern is its soft label.  A logistic scorer over hashed features (letter runs,
their first bytes, beginnings and endings of words by character class, repeated neighbours) is trained on a
bounded sample of documents with these soft labels, and a second head on labelled toxic
documents (also bounded).  Every document is then scored.

The sample: about ``sample`` distinct documents (id and text), chosen by hash, for the first head;
the texts of about ``sample`` labelled ids, at most about twice ``sample`` distinct ones, for the
second.  Repeated rows are one document with a weight, so an id or text that holds a third of
the rows is one row of the sample.  A training document brings at most ``FEATURES`` distinct
buckets (the first by a hash, their counts scaled up); scoring reads all of them.

Defined results: a null or wordless text has quality 0; repeated rows are scored each for
itself; without documents the result is empty; without toxic labels the toxic score is 0;
null labels are ignored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import textops as T
from tenura.llm.frames import cut_lineage, text_uid

LABELLERS = ("symbols", "bars", "capitals", "repeats", "lines", "word_length", "stops", "variety", "prose")
SAMPLE = 12_000
FEATURES = 4_096
BUCKETS = 1 << 20
STEPS = 100
CHUNK = 1 << 18

_VALUES = T.byte_values(lower=True)
_IS_WORD = T.blank_separated()
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
# character classes: letters a / A, digits 0, everything else as it is
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97
_CLASS_VALUES = T.byte_values()[_CLASS]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>{}[]=_~^+\\/@")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags)))
    return c[off[1:]] - c[off[:-1]]


def describe(buf: np.ndarray, off: np.ndarray, powers: T.Powers):
    """Word counts, votes (rows x labellers) and hashed features of the texts of a chunk.

    Features are (row, bucket) pairs with repeats: four or five a word."""
    starts, ends, first = T.word_spans(buf, off, _IS_WORD)
    n = np.diff(first)
    values = T.prefix_sums(_VALUES[buf], powers)
    h = T.span_hashes(values, starts, ends, powers)
    row = np.repeat(np.arange(len(n)), n)
    l0, l1, l_first = T.word_spans(buf, off, _IS_LETTER)
    l_row, letters = np.repeat(np.arange(len(n)), np.diff(l_first)), T.span_hashes(values, l0, l1, powers)
    stem = T.mix(T.span_hashes(values, l0, np.minimum(l1, l0 + 6), powers) ^ np.uint64(0xD6E8FEB86659FD93))
    cls = T.prefix_sums(_CLASS_VALUES[buf], powers)
    tail = T.span_hashes(cls, np.maximum(starts, ends - 4), ends, powers)
    head = T.span_hashes(cls, starts, np.minimum(ends, starts + 2), powers)
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    words = np.maximum(n, 1)
    chars = np.maximum(np.bincount(row, weights=ends - starts, minlength=len(n)), 1)
    symbols = _per_row(_SYMBOL[buf], off) / words
    bars = _per_row(buf == 124, off) / words
    capitals = _per_row(_UPPER[buf], off) / chars
    repeats = np.bincount(row, weights=twin, minlength=len(n)) / words
    lines = _per_row(buf == 10, off) + 1
    # stops that end a word
    stops = np.bincount(row, weights=_END[buf[ends - 1]] if len(ends) else None, minlength=len(n)) / words
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    variety = np.bincount(row[order], weights=fresh, minlength=len(n)) / words

    def vote(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    prose = (symbols < 0.03) & (capitals < 0.3) & (repeats < 0.05) & (stops > 0.02)
    votes = np.stack([
        vote(symbols > 0.15, symbols < 0), vote(bars > 0.08, bars < 0), vote(capitals > 0.4, capitals < 0),
        vote(repeats > 0.08, repeats < 0), vote((lines > 4) & (words / lines < 4), lines < 0),
        vote((n > 4) & ((chars / words < 2.5) | (chars / words > 12)), n < 0),
        vote((n > 20) & (stops < 0.02), (stops > 0.04) & (stops < 0.35)),
        vote((n > 30) & (variety < np.minimum(0.5, 12 / np.sqrt(words))), variety > 0.6),
        vote(n < 0, prose)], axis=1).astype(np.int8)
    mask = np.uint64(BUCKETS - 1)
    salt = np.uint64(0x2545F4914F6CDD1D)
    feats = [(l_row, (letters & mask).astype(np.int64)),
             (l_row, (stem & mask).astype(np.int64)), (row, (T.mix(tail + salt) & mask).astype(np.int64)),
             (row, (T.mix(head ^ salt) & mask).astype(np.int64)), (row[twin], np.full(int(twin.sum()), 7, np.int64))]
    return n, votes, np.concatenate([f[0] for f in feats]), np.concatenate([f[1] for f in feats])


def pattern(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = T.Powers()
    counts = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
    for batch in batches:
        for _, _, buf, off in T.chunks(batch.column("text"), CHUNK):
            n, votes, _, _ = describe(buf, off, powers)
            counts += np.bincount(pattern(votes[n > 0]), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pattern", "n"])


def em(patterns: np.ndarray, counts: np.ndarray, labellers: int, steps: int = 200):
    """(prior of good, votes[labeller, class, vote]) with votes -1, 0, 1 at 0, 1, 2.

    Starts from labellers that are right more often than not, which names the classes."""
    vote = patterns[:, None] // 3 ** np.arange(labellers) % 3
    table = np.tile(np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]), (labellers, 1, 1))
    prior = 0.8
    for _ in range(steps):
        good = _posterior(vote, prior, table)
        weight = np.stack([counts * (1 - good), counts * good])
        new = np.zeros_like(table)
        for v in range(3):
            new[:, :, v] = ((vote == v).T @ weight.T)
        table = (new + 1.0) / (new.sum(axis=2, keepdims=True) + 3.0)
        prior = float(np.clip(weight[1].sum() / max(1, counts.sum()), 0.01, 0.99))
    return prior, table


def _posterior(vote: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    j = np.arange(vote.shape[1])
    logs = [np.log(p) + np.log(table[j, c, vote]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


SAMPLED = ("doc_id long, uid long, weight long, n long, pattern long, toxic int, for_quality boolean, "
           "bucket array<int>, count array<double>")


def _sampled(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 9
    types = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in SAMPLED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of the partition once: its distinct buckets, counts, pattern and toxic label.

    Its further rows leave as one row without features at the end, which carries their number."""
    powers = T.Powers()
    again: dict[tuple, int] = {}
    for batch in batches:
        ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), strict=True))
        fresh = []
        for i, doc in enumerate(ids):
            if doc in again:
                again[doc] += 1
            else:
                again[doc] = 0
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        ids = [ids[i] for i in fresh]
        toxic, for_quality = batch.column("toxic").to_pylist(), batch.column("for_quality").to_pylist()
        for lo, hi, buf, off in T.chunks(batch.column("text"), CHUNK):
            n, votes, row, bucket = describe(buf, off, powers)
            key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
            at = np.searchsorted(key, np.arange(len(n) + 1) * BUCKETS)
            kinds = pattern(votes)
            rows = []
            for i in range(hi - lo):
                b, c = key[at[i]:at[i + 1]] % BUCKETS, count[at[i]:at[i + 1]].astype(float)
                if len(b) > FEATURES:
                    use = np.sort(np.argsort(T.mix(b.astype(np.uint64)), kind="stable")[:FEATURES])
                    b, c = b[use], c[use] * (c.sum() / c[use].sum())
                rows.append((*ids[lo + i], 1, int(n[i]), int(kinds[i]), toxic[lo + i], for_quality[lo + i],
                             b.astype(np.int32), c))
            yield _sampled(rows)
    yield _sampled([(*doc, more, *[None] * 6) for doc, more in again.items() if more])


def logistic(x_row, x_col, x_val, y, weight, l2: float, steps: int = STEPS, rate: float = 0.5):
    """Weights and bias of a logistic model over weighted sparse rows, by AdaGrad on full gradients."""
    rows, total = len(y), weight.sum()
    w, b = np.zeros(BUCKETS), 0.0
    gw, gb = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(x_row, weights=x_val * w[x_col], minlength=rows) + b
        err = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(x_col, weights=x_val * err[x_row], minlength=BUCKETS) / total + l2 * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        g = err.sum() / total
        gb += g * g
        b -= rate * g / np.sqrt(gb)
    return w, b


def telling(x_row, x_col, y, weight, least: int = 8, deviations: float = 5.0) -> np.ndarray:
    """Buckets whose rows are positive far more often than all rows; the rest is noise to a rare class."""
    n = np.bincount(x_col, weights=weight[x_row], minlength=BUCKETS)
    k = np.bincount(x_col, weights=(weight * y)[x_row], minlength=BUCKETS)
    p = (weight * y).sum() / weight.sum()
    return (n >= least) & (k - n * p > deviations * np.sqrt(n * p * (1 - p)))


def _train(prior: float, table: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf[pdf["n"] > 0].sort_values(["doc_id", "uid"], kind="stable")
        for head in ("quality", "toxic"):
            part = pdf[pdf["for_quality"]] if head == "quality" else pdf[pdf["toxic"].notna()]
            if not len(part):
                continue
            if head == "quality":
                vote = part["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
                y = _posterior(vote, prior, table)
            else:
                y = part["toxic"].to_numpy(dtype=float)
                if not y.any():
                    continue
            lengths, weight = part["bucket"].map(len).to_numpy(), part["weight"].to_numpy(dtype=float)
            row = np.repeat(np.arange(len(part)), lengths)
            col = np.concatenate(part["bucket"].to_list()).astype(np.int64)
            if head == "quality":      # shares of the words
                val = np.concatenate(part["count"].to_list()) / part["n"].to_numpy()[row]
                w, b = logistic(row, col, val, y, weight, 1e-6)
            else:                      # presence of telling buckets
                use = telling(row, col, y, weight)[col]
                w, b = logistic(row[use], col[use], np.ones(int(use.sum())), y, weight, 1e-5)
            out.append(pd.DataFrame({"head": [head], "weights": [w.astype(np.float32).tobytes()], "bias": [float(b)]}))
        return pd.concat(out) if out else pd.DataFrame({"head": [], "weights": [], "bias": []})
    return run


def _share(*of: str) -> Column:
    """A number in [0, 1) by hash; the first argument names the draw."""
    return F.pmod(F.xxhash64(F.lit(of[0]), *of[1:]), F.lit(1 << 20)) / float(1 << 20)


def training_labels(spark: SparkSession, labels: DataFrame | None, sample: int) -> DataFrame:
    """(doc_id, toxic) of about ``sample`` labelled ids; a label seen twice with two values is toxic."""
    if labels is None:
        return spark.createDataFrame([], "doc_id long, toxic int")
    toxic = labels.filter("doc_id is not null and toxic is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return toxic.filter(_share("toxic", "doc_id") < float(sample) / max(1, toxic.count()))


def training_features(rows: DataFrame, chosen: DataFrame, total: int, sample: int) -> DataFrame:
    """The sampled documents, each once with its weight: columns of SAMPLED.

    rows: doc_id, uid, text; chosen: a bounded set of labelled ids, broadcast, so no text moves but the drawn ones."""
    chosen = F.broadcast(cut_lineage(chosen))
    labelled = rows.select("doc_id").join(chosen, "doc_id", "left_semi").count()
    drawn = (rows.join(chosen, "doc_id", "left")
             .withColumn("toxic", F.when(_share("texts", "doc_id", "uid") < 2.0 * sample / max(1, labelled), F.col("toxic")))
             .withColumn("for_quality", _share("quality", "doc_id", "uid") < float(sample) / max(1, total))
             .filter("for_quality or toxic is not null"))
    feats = drawn.select("doc_id", "uid", "text", "toxic", "for_quality").mapInArrow(_sample_features, SAMPLED)
    of = ["n", "pattern", "toxic", "for_quality", "bucket", "count"]
    one = F.first(F.when(F.col("n").isNotNull(), F.struct(*of)), ignorenulls=True).alias("one")
    return feats.groupBy("doc_id", "uid").agg(F.sum("weight").alias("weight"), one).select(
        "doc_id", "uid", "weight", "one.*")


def fit(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE):
    """(prior, labeller table, {head: (weights, bias)})."""
    counts = (docs.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern")
              .agg(F.sum("n").alias("n")).orderBy("pattern").collect())     # at most 3**9 rows
    prior, table = em(np.array([r.pattern for r in counts], dtype=np.int64),
                      np.array([r.n for r in counts], dtype=float), len(LABELLERS)) if counts else (0.5, None)
    if not counts:
        return prior, table, {}
    total = sum(r.n for r in counts)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_uid("text").alias("uid")).filter(F.col("text").isNotNull())
    got = training_features(rows, training_labels(spark, labels, sample), total, sample)
    # one bounded group: about 3 * sample documents of at most FEATURES counts
    got = (got.groupBy(F.lit("all"))
           .applyInPandas(_train(prior, table), "head string, weights binary, bias double").collect())
    return prior, table, {r.head: (np.frombuffer(r.weights, dtype=np.float32), r.bias) for r in got}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = T.Powers()
        prior, table, heads = shared.value
        for batch in batches:
            for lo, hi, buf, off in T.chunks(batch.column("text"), CHUNK):
                n, votes, row, bucket = describe(buf, off, powers)
                vote = pattern(votes)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
                weak = _posterior(vote, prior, table)
                quality, toxic = weak.copy(), np.zeros(len(n))
                if "quality" in heads:
                    w, b = heads["quality"]
                    quality = np.bincount(row, weights=w[bucket], minlength=len(n)) / np.maximum(n, 1) + b
                    quality = 1 / (1 + np.exp(-np.clip(quality, -50, 50)))
                if "toxic" in heads:
                    w, b = heads["toxic"]
                    key = np.unique(row * BUCKETS + bucket)
                    toxic = np.bincount(key // BUCKETS, weights=w[key % BUCKETS], minlength=len(n)) + b
                    toxic = 1 / (1 + np.exp(-np.clip(toxic, -50, 50)))
                none = n == 0
                quality[none], weak[none], toxic[none] = 0.0, 0.0, 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(weak),
                     pa.array(quality), pa.array(toxic)], names=["doc_id", "n_words", "weak_label", "quality", "toxic"])
    return run


def classify(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, weak_label (posterior), quality and toxic scores of every row."""
    model = fit(docs, labels, sample)
    if model[1] is None:
        model = (0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), {})
    shared = docs.sparkSession.sparkContext.broadcast(model)      # two heads of BUCKETS floats: 8 MB
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _score(shared), "doc_id long, n_words long, weak_label double, quality double, toxic double")


def quality_report(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    out = classify(docs, labels)
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
