"""Operator 9, language identification: words first, then shorter and shorter n-grams.

Model, counted over the training texts: for each known word its log frequency per
language, and the same for character n-grams (of words with a blank at both ends).
A text is scored word by word: a known word adds its log frequencies; an unknown word
falls back to its n-grams of the longest order of which any is known, adding their mean;
an order without a known n-gram is passed over for the next shorter one.  The language
of the largest sum wins (ties: the first by code point); ``score`` is its posterior at
a flat prior, times the share of the words of which a word or n-gram is known: a text in a
script that was never seen has a language, as every text with a letter, and the score 0.

The model is fitted on a bounded sample: at most about ``sample`` documents a language,
chosen by a hash of the id (rate = sample / labelled documents of the language).  It keeps
every word and n-gram of the sample, so the broadcast grows with the vocabulary of the
sampled documents and the number of languages, not with the table.  A language is known
when a sampled text of it has a word.  Words are runs of letters, lower-cased, so texts without a letter are ``und`` with score 0.

Defined results: a null or empty text is ``und``; null languages never train; with no
training rows everything is ``und``; repeated rows are judged (and counted) each for
itself; a null id trains as if its remainder were not 2; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tenura.llm import textops as T
from tenura.llm.frames import cut_lineage, text_uid

SAMPLE = 4000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")          # letters, and numbers like the vulgar fractions that go below
CACHE = 60_000             # vectors kept ready, of each table
FLUSH = 200_000            # words that a task counts before it sends them on
BROADCAST_LANGS = 10_000
MIN_SCORE = 0.5


def words_of(text: str) -> list[str]:
    """Runs of letters (categories L*), lower-cased."""
    found = WORD.findall(text.lower())
    if "".join(found).isalpha() or not found:
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams_of(word: str, order: int) -> list[str]:
    """n-grams of the word with a blank at both ends; none of blanks only."""
    if order == 1:
        return list(word)
    w = f" {word} "
    return [w] if len(w) <= order else [w[i:i + order] for i in range(len(w) - order + 1)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, item, n): word and n-gram counts of a partition; kind 0 is the word."""
    counts: dict[str, Counter] = {}

    def flush():
        rows = []
        for lang, c in counts.items():
            rows += [(lang, 0, w, n) for w, n in c.items()]
            grams: dict[int, Counter] = {o: Counter() for o in ORDERS}
            for w, n in c.items():
                for o in ORDERS:
                    for g in grams_of(w, o):
                        grams[o][g] += n
            rows += [(lang, o, g, n) for o, gc in grams.items() for g, n in gc.items()]
        counts.clear()
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.int64())], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield flush()
    yield flush()


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): the bounded training sample; held-out ids never enter."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    per = cut_lineage(rows.groupBy("lang").count())
    if per.count() <= BROADCAST_LANGS:
        per = F.broadcast(per)
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", text_uid("text")), F.lit(1 << 20)) / float(1 << 20)
    return (rows.join(per, "lang").filter(draw < F.lit(float(sample)) / F.col("count")).select("lang", "text"))


class Table:
    """Log frequency per language of the entries of one kind, add-half smoothed; only seen pairs are stored.

    The entries stay an Arrow array until the first is asked for, so the driver, which only ships the
    table, never holds them as Python strings."""

    def __init__(self, items: pa.ChunkedArray, lang: np.ndarray, n: np.ndarray, n_langs: int) -> None:
        coded = items.combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.items, self.at = coded.dictionary, None
        kinds = len(self.items)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=kinds))))
        size = np.bincount(lang, weights=n, minlength=n_langs) + 0.5 * kinds
        self.lang = lang[order]
        logs = np.log((n[order] + 0.5) / size[self.lang])
        self.unseen = np.log(0.5 / size) if kinds else size
        # vectors are relative to the languages' mean
        more = np.bincount(code[order], weights=logs - self.unseen[self.lang], minlength=kinds)
        self.mean = (self.unseen.sum() + more) / max(1, n_langs)
        self.logs = logs - self.mean[code[order]]
        self.made: dict[str, np.ndarray] = {}

    def get(self, item: str) -> np.ndarray | None:
        v = self.made.get(item)
        if v is None:
            if self.at is None:
                self.at, self.items = {x: i for i, x in enumerate(self.items.to_pylist())}, None
            i = self.at.get(item)
            if i is None:
                return None
            v, seen = self.unseen - self.mean[i], slice(self.begin[i], self.begin[i + 1])
            v[self.lang[seen]] = self.logs[seen]
            if len(self.made) >= CACHE:
                self.made.clear()
            self.made[item] = v
        return v


class Model:
    """Score vectors per known word and n-gram; picklable."""

    def __init__(self, langs: list[str], words: Table | dict[str, np.ndarray],
                 grams: dict[int, Table | dict[str, np.ndarray]]) -> None:
        self.langs, self.words, self.grams, self.cache = langs, words, grams, {}

    def vector(self, word: str) -> np.ndarray | None:
        v = self.words.get(word)
        if v is not None:
            return v
        v = self.cache.get(word, False)
        if v is False:
            v = None
            for o in ORDERS:
                table = self.grams.get(o, {})
                known = [x for x in map(table.get, grams_of(word, o)) if x is not None]
                if known:
                    v = sum(known[1:], known[0]) / len(known)
                    break
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        if not counts:
            return UNKNOWN, 0.0
        vectors, times = [], []
        for w, n in counts.items():
            v = self.vector(w)
            if v is not None:
                vectors.append(v)
                times.append(n)
        if not vectors:
            return self.langs[0], 0.0
        total = np.asarray(times, dtype=float) @ np.asarray(vectors)
        k = int(np.argmax(total))
        return self.langs[k], float(1.0 / np.exp(total - total[k]).sum()) * sum(times) / sum(counts.values())


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, lang, text.  Counts in Spark; the entries of the sample come to the driver."""
    got = (training_rows(docs, sample).mapInArrow(_count, "lang string, kind int, item string, n long")
           .groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(got.column("lang").unique().to_pylist())
    lang = pc.index_in(got.column("lang"), pa.array(langs, pa.string())).to_numpy()
    kind, n = got.column("kind").to_numpy(), got.column("n").to_numpy()

    def table(k: int) -> Table:
        of = np.flatnonzero(kind == k)
        return Table(got.column("item").take(of), lang[of], n[of], len(langs))

    return Model(langs, table(0), {o: table(o) for o in ORDERS})


def _predict(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row = batch.column("row")
            got = [model.predict(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [row, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=["row", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """(row, lang_pred, score): ``row`` holds the named columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(_predict(shared, "text"), StructType([
        packed.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def _learn_and_identify(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The model is the driver's only until it is broadcast; what it took goes back to the system."""
    out = identify(docs, fit(docs), columns)
    T.give_back()
    return out


def language_report(docs: DataFrame) -> DataFrame:
    out = _learn_and_identify(docs, ["doc_id"])
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those of no recognisable language (``und`` or a score below ``min_score``)."""
    out = _learn_and_identify(docs, docs.columns)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
