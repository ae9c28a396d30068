"""Operator 8, substring dedup by seed and extend.

Seeds are winnowed anchors: of the 25-word hashes in every 50-word window the smallest,
so any shared run of 50 words shares a seed at the same place.  Documents are joined on
seeds.  A seed whose whole block (the windows that chose it, extended to both sides)
equals an earlier document's block (by the BLAKE2b digest of its words) is settled at once;
where blocks of one seed differ, their texts are brought together and extended from the
seed word by word to both sides, comparing the words themselves, so a maximal repeat ends
exactly where it ends in the text.  Words covered by a repeat of 50 words or more go;
windows are judged on the input.

A seed in a third of all documents stays spread: counts and earliest occurrences are
aggregated before the shuffle, joins are equi-joins that AQE can split, and a seed with
more than GROUP_ROWS blocks to compare is compared through an ordinary shuffle of its
window digests instead of in one task.

Defined results: a null or empty text has no words; texts under 50 words lose nothing;
rows of equal doc_id never count as earlier to each other; a null doc_id is later than
any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm import repeats as R
from tenura.llm import textops as T
from tenura.llm.frames import cut_lineage, keyed, written

WIDTH = 50
GRAM = 25


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (class so far, next word)."""
    return np.unique(before * (int(word.max(initial=0)) + 1) + word, return_inverse=True)[1]


def extend(units, a, did, uid, ws, n, ctx, powers):
    """Windows (row, number) whose words also start in a smaller document of the same seed.

    Rows begin as classes of equal seed words and are extended word by word to the left and to the
    right: rows of one class after i words agree on all of them.  Words are compared by their bytes.
    A window is repeated where an earlier document agrees with it as far to either side."""
    buf = np.frombuffer(b"".join(ctx.to_pylist()), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(x) for x in ctx.to_pylist()]))).astype(np.int64)
    h, first, starts, ends = units.cut(buf, off, powers)
    raw, at = T.joined_words(buf, starts, ends, T.blank_separated())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    # the seed is where the row's windows have their anchor
    grams = powers.hashes(powers.sums(h), np.arange(len(h) - units.gram + 1), np.arange(units.gram, len(h) + 1))
    begin, stop = first[:-1], first[1:]
    seed = T.window_anchors(grams, units.width - units.gram + 1)[begin]
    same = np.unique(a, return_inverse=True)[1]
    for i in range(units.gram):
        same = _classes(same, code[seed + i])
    most = units.width - units.gram
    left = np.full((most + 1, len(n)), -1)
    right = left.copy()
    left[0] = right[0] = same
    for i in range(1, most + 1):
        for side, ok, word in ((left, seed - i >= begin, seed - i), (right, seed + units.gram + i <= stop, seed + units.gram + i - 1)):
            rows = np.flatnonzero(ok)
            side[i, rows] = _classes(side[i - 1, rows], code[word[rows]])
    row = np.repeat(np.arange(len(n)), n)
    win = T.expand(np.zeros(len(n), dtype=np.int64), n.astype(np.int64))
    i = seed[row] - begin[row] - win                                   # words of the window before the seed
    l, r = left[i, row], right[most - i, row]
    order = np.lexsort((did[row], r, l, i))
    d, new = did[row][order], np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in (i, l, r):
        new[1:] |= c[order][1:] != c[order][:-1]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = np.zeros(len(row), dtype=bool)
    hit[order] = d > least
    return row[hit], win[hit]


def _window_digests(units, n, ctx, powers):
    row, win, at, _ = R.windows_in(units, ctx, n, powers)
    buf = np.frombuffer(b"".join(ctx.to_pylist()), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(x) for x in ctx.to_pylist()]))).astype(np.int64)
    starts, ends, _ = T.word_spans(buf, off, T.blank_separated())
    return row, win, units.digests(buf, starts, ends, at, np.full(len(at), units.width))


def _window_rows(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = T.Spans()
        for batch in batches:
            if not batch.num_rows:
                continue
            a, did, uid, ws, n = (batch.column(c).to_numpy() for c in ("a", "did", "uid", "ws", "n"))
            row, win, wh = _window_digests(units, n, batch.column("ctx"), powers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[row]), pa.array(wh.view(np.int64)), pa.array(did[row]), pa.array(uid[row]),
                 pa.array((ws[row] + win).astype(np.int32))], names=["a", "wh", "did", "uid", "ws"])
    return run


def repeated_windows(docs: DataFrame, units: R.Units = R.Units(True, WIDTH, GRAM)) -> DataFrame:
    """(did, uid, ws, n): n windows from word ws on also start in a smaller document."""
    shared = R.shared_blocks(docs, units)
    classes = R.block_classes(shared)
    mixed = R.classes_per_anchor(classes)
    settled = shared.join(classes.drop("n"), ["a", "span"]).filter("did > c_did").select("did", "uid", "ws", "n")
    # the earliest block of each kind speaks for its kind, and stands for its document
    open_ = written(classes.join(mixed.select("a"), "a").select("a", "span", F.col("c_did").alias("did"))
                    .join(shared, ["a", "span", "did"]).select("a", "did", "uid", "ws", "n"))
    # by rows, not kinds: one text may repeat a passage any number of times
    wide = cut_lineage(open_.groupBy("a").count().filter(F.col("count") > R.GROUP_ROWS)
                       .select("a", F.lit(True).alias("wide")))
    ctx = cut_lineage(R.contexts(docs, open_, units).join(wide, "a", "left"))
    hits = R.grouped_windows(ctx.filter("wide is null").drop("wide"), units, extend)
    many = ctx.filter("wide").drop("wide").mapInArrow(_window_rows(units), "a long, wh long, did long, uid long, ws int")
    first = many.groupBy("a", "wh").agg(F.min("did").alias("d0"), F.max("did").alias("d1")).filter("d0 < d1")
    far = many.join(first, ["a", "wh"]).filter("did > d0").select("did", "uid", "ws", F.lit(1).alias("n"))
    return settled.unionByName(hits).unionByName(far)


def _digest(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = T.blank_separated()
        for batch in batches:
            if not batch.num_rows:
                continue
            total, removed, shas, kept_texts = [], [], [], []
            hits = batch.column("hits")
            for lo, hi, buf, off in T.chunks(batch.column("text"), R.CHUNK):
                starts, ends, first = T.word_spans(buf, off, is_word)
                raw = buf.tobytes()
                for r in range(hi - lo):
                    i, j = first[r], first[r + 1]
                    kept = np.ones(j - i, dtype=bool)
                    h = hits[lo + r]
                    if h.is_valid and len(h):
                        ws, n = (h.values.field(c).to_numpy().astype(np.int64) for c in ("ws", "n"))
                        kept = ~T.covered(j - i, ws, n + width - 1)
                    words = [raw[x:y] for x, y in zip(starts[i:j][kept].tolist(), ends[i:j][kept].tolist(), strict=True)]
                    text = b" ".join(words)
                    total.append(int(j - i))
                    removed.append(int(j - i - len(words)))
                    shas.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept_texts.append(text.decode("utf-8", "replace"))
            cols = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                cols.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and (``texts``) the kept text."""
    rows, documents = keyed(docs)
    hits = repeated_windows(documents, R.Units(True, width, gram))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return R.covered_units(rows, hits, _digest(width, texts), schema)


def substring_report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, texts=False)
