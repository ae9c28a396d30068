"""Windows that occur more than once, found through content-chosen anchors.

Shared by the two substring operators.  A text is a row of units (bytes or words).
Every window of ``width`` units chooses its smallest ``gram``-unit hash as its anchor
(winnowing), so equal windows choose equal anchors at equal offsets, and a window can
repeat only if its anchor does.  Consecutive windows with one anchor form a *block*;
one row per block travels, not one per window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm import textops as T
from tenura.llm.frames import NO_ID, cut_lineage, written

BLOCK_SCHEMA = "did long, uid long, a long, span long, ws int, n int"
CONTEXT_SCHEMA = "a long, did long, uid long, ws int, n int, ctx binary"
HIT_SCHEMA = "did long, uid long, ws int, n int"
GROUP_ROWS = 4096          # blocks of one anchor that one task compares at once
CHUNK = 1 << 18


@dataclass(frozen=True)
class Units:
    """What a text is cut into, and the window and gram lengths in these units."""

    words: bool
    width: int
    gram: int

    def cut(self, buf: np.ndarray, off: np.ndarray, powers: T.Spans):
        """(unit hashes, first unit of each row, byte starts, byte ends)."""
        if not self.words:
            return _VALUES[buf], off, None, None
        starts, ends, first = T.word_spans(buf, off, _IS_WORD)
        return powers.hashes(powers.sums(_VALUES[buf]), starts, ends), first, starts, ends

    def digests(self, buf: np.ndarray, starts, ends, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64 bits of the BLAKE2b of the runs of ``size`` units from unit ``begin`` on: of the bytes, or of
        the words with one blank behind each."""
        if self.words:
            raw, at = T.joined_words(buf, starts, ends, _IS_WORD)
            begin, end = at[begin], at[begin + size]
        else:
            raw, end = buf.tobytes(), begin + size
        digest = b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest()
                           for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(digest, dtype=np.uint64)


_VALUES = T.byte_values()
_IS_WORD = T.blank_separated()


def blocks_of(units: Units, buf: np.ndarray, off: np.ndarray, powers: T.Spans):
    """(row, first window, number of windows, anchor hash, block digest) of a chunk of texts."""
    h, first, starts, ends = units.cut(buf, off, powers)
    s = powers.sums(h)
    n, w, k = len(h), units.width, units.gram
    if n < w:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    at = np.arange(n - k + 1)
    grams = powers.hashes(s, at, at + k)
    anchor = T.window_anchors(grams, w - k + 1)
    # windows that lie in one text
    row = np.searchsorted(first, np.arange(len(anchor)), side="right") - 1
    ok = np.arange(len(anchor)) + w <= first[row + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    a, r = anchor[at], row[at]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])))
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate((begin, [len(at)])))
    ws, r, a = at[begin], r[begin], a[begin]
    # the digest of what the block holds; equal blocks have their anchor at the same place
    span = units.digests(buf, starts, ends, ws, count - 1 + w)
    return r, ws - first[r], count, grams[a], span


def _blocks(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = T.Spans()
        for batch in batches:
            did, uid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "uid"))
            for lo, _, buf, off in T.chunks(batch.column("text"), CHUNK):
                r, ws, n, a, span = blocks_of(units, buf, off, powers)
                if len(r):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(did[lo + r]), pa.array(uid[lo + r]), pa.array(a.view(np.int64)),
                         pa.array(span.view(np.int64)), pa.array(ws.astype(np.int32)),
                         pa.array(n.astype(np.int32))], names=["did", "uid", "a", "span", "ws", "n"])
    return run


def shared_blocks(docs: DataFrame, units: Units) -> DataFrame:
    """Blocks whose anchor occurs again anywhere."""
    rows = docs.mapInArrow(_blocks(units), BLOCK_SCHEMA)
    # cut, so that the join below is one of two plain exchanges, which AQE can split at hot anchors
    again = cut_lineage(rows.groupBy("a").count().filter("count > 1").select("a"))
    return written(rows.join(again, "a"))


def block_classes(shared: DataFrame) -> DataFrame:
    """(a, span, n, k, c_did, c_uid, c_ws): the earliest occurrence of each kind of block, of k in all."""
    return written(shared.groupBy("a", "span").agg(F.min(F.struct("did", "uid", "ws", "n")).alias("c"),
                                                       F.count(F.lit(1)).alias("k"))
                       .select("a", "span", F.col("c.n").alias("n"), "k", F.col("c.did").alias("c_did"), F.col("c.uid").alias("c_uid"),
                               F.col("c.ws").alias("c_ws")))


def classes_per_anchor(classes: DataFrame) -> DataFrame:
    """(a, kinds): anchors that stand in more than one kind of block."""
    return cut_lineage(classes.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))


def _contexts(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = T.Spans()
        for batch in batches:
            did, uid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "uid"))
            todo = batch.column("todo")
            ends = np.asarray(todo.offsets) - todo.offsets[0].as_py()
            values = todo.flatten()
            a, ws, n = (values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "ws", "n"))
            for lo, hi, buf, off in T.chunks(batch.column("text"), CHUNK):
                pick = slice(ends[lo], ends[hi])
                r = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                _, first, starts, stops = units.cut(buf, off, powers)
                u0 = first[r] + ws[pick]
                u1 = u0 + n[pick] + units.width - 1
                b0, b1 = (starts[u0], stops[u1 - 1]) if units.words else (u0, u1)
                raw = buf.tobytes()
                if len(r):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[pick]), pa.array(did[lo + r]), pa.array(uid[lo + r]), pa.array(ws[pick]),
                         pa.array(n[pick]),
                         pa.array([raw[i:j] for i, j in zip(b0.tolist(), b1.tolist(), strict=True)], pa.binary())],
                        names=["a", "did", "uid", "ws", "n", "ctx"])
    return run


def contexts(docs: DataFrame, chosen: DataFrame, units: Units) -> DataFrame:
    """The text of each chosen block (a, did, uid, ws, n), fetched from its document."""
    per_doc = chosen.groupBy("did", "uid").agg(F.collect_list(F.struct("a", "ws", "n")).alias("todo"))
    return docs.join(per_doc, ["did", "uid"]).mapInArrow(_contexts(units), CONTEXT_SCHEMA)


def windows_in(units: Units, ctx: pa.Array, n: np.ndarray, powers: T.Spans):
    """For each window of the contexts: its row and its number in the block, its first unit, and the
    hashes of all units."""
    buf = np.frombuffer(b"".join(ctx.to_pylist()), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(x) for x in ctx.to_pylist()]))).astype(np.int64)
    h, first, _, _ = units.cut(buf, off, powers)
    row = np.repeat(np.arange(len(n)), n)
    at = T.expand(first[:-1], n.astype(np.int64))
    return row, at - first[row], at, h


def grouped_windows(rows: DataFrame, units: Units, judge: Callable) -> DataFrame:
    """Compare the contexts of each anchor inside the task that holds them.

    Rows are dealt and sorted by anchor; a task works on whole anchors in chunks.
    Callers route anchors of more than GROUP_ROWS rows elsewhere.
    ``judge(units, a, did, uid, ws, n, ctx, powers)`` returns (row, window) of hits.
    """
    def work(parts: list[pa.RecordBatch], powers) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        a, did, uid, ws, n = (t.column(c).to_numpy() for c in ("a", "did", "uid", "ws", "n"))
        row, win = judge(units, a, did, uid, ws, n, t.column("ctx").combine_chunks(), powers)
        # neighbouring windows of a row as one range
        if len(row):
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (win[1:] != win[:-1] + 1)))
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate((begin, [len(row)])))
            row, win = row[begin], win[begin]
        else:
            count = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(did[row]), pa.array(uid[row]), pa.array((ws[row] + win).astype(np.int32)),
             pa.array(count.astype(np.int32))], names=["did", "uid", "ws", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = T.Spans(), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").to_numpy()
            cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
            lo = 0
            if held and held[-1].column("a")[-1].as_py() != a[0] and size > CHUNK:
                yield work(held, powers)
                held, size = [], 0
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in batch.column("ctx").to_pylist()])))
            for c in cuts.tolist():
                if size + sizes[c] - sizes[lo] > CHUNK:
                    held.append(batch.slice(lo, c - lo))
                    yield work(held, powers)
                    held, size, lo = [], 0, c
            held.append(batch.slice(lo))
            size += int(sizes[-1] - sizes[lo])
        if held:
            yield work(held, powers)

    return rows.repartition("a").sortWithinPartitions("a", "did", "uid", "ws").mapInArrow(run, HIT_SCHEMA)


def covered_units(docs: DataFrame, hits: DataFrame, digest: Callable, schema: str) -> DataFrame:
    """docs (did, uid, text) with the windows ``hits`` of each and their doc_id, passed to ``digest``.

    Nothing is added to docs before the join, so its exchange can be the one of ``contexts``."""
    per_doc = hits.groupBy("did", "uid").agg(F.collect_list(F.struct("ws", "n")).alias("hits"))
    return (docs.join(per_doc, ["did", "uid"], "left")
            .withColumn("doc_id", F.nullif(F.col("did"), F.lit(NO_ID))).mapInArrow(digest, schema))
