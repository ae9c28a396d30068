"""Operator 4, suffix-array dedup: byte windows that start earlier elsewhere.

A full suffix order is not needed, only the ranks of positions by their first
``width`` bytes, and prefix doubling finds them: positions get a rank by a short prefix,
and the ranks of a prefix twice as long come from sorting pairs (rank at p, rank at
p + h).  Positions whose rank is unique can have no copy and leave.

Ranking every byte position would shuffle some 30 bytes per byte of text and round, so
the ranks start sparse: round 0 ranks only the sampled positions (anchors, one in 43
bytes, chosen so that every window has one) by their 16-byte gram and drops the unique
ones; round 1 reranks the rest by the pair (gram rank, block rank), which settles every
block that equals an earlier one.  Only where blocks of one anchor differ are single
byte positions ranked, by doubling from 25 over 50 to 100 bytes.

Anchors with more than GROUP_ROWS different blocks are doubled block by block, to hashes,
and Spark sorts their windows by (anchor, rank); the others are sorted by Spark into one
task per anchor range and doubled there.  Counts and earliest occurrences aggregate before the shuffle; no group
is collected.

Defined results: a null text has no bytes; matches never cross documents; earlier means
smaller (doc_id, start), with a null doc_id later than any and rows of equal doc_id and
other text ordered by a text hash; repeated equal rows count as one document; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm import repeats as R
from tenura.llm import textops as T
from tenura.llm.frames import keyed

WIDTH = 100
GRAM = 16
DOUBLINGS = 2          # 25 -> 50 -> 100


def _rank(*columns) -> np.ndarray:
    """Dense rank of the rows of the columns, by sorting."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def double(units, a, did, uid, ws, n, ctx, powers):
    """Windows (row, number) that are not the first of their rank within their anchor."""
    row, win, at, h = R.windows_in(units, ctx, n, powers)
    s = powers.sums(h)
    step = units.width >> DOUBLINGS
    lengths = np.diff(np.concatenate(([0], np.cumsum(n + units.width - 1))))
    first = np.cumsum(lengths) - lengths
    # rank of the short prefix at every position that a window needs
    count = n.astype(np.int64) + units.width - step
    pos = T.expand(first, count)
    own = np.repeat(np.arange(len(n)), count)
    base = np.concatenate(([0], np.cumsum(count)))[:-1]
    rank = _rank(a[own], powers.hashes(s, pos, pos + step))
    length = step
    while length < units.width:
        # positions that still have `length` bytes after them inside the block
        more = count - length
        left = T.expand(base, more)
        own = np.repeat(np.arange(len(n)), more)
        rank = _rank(rank[left], rank[left + length])
        count, base = more, np.concatenate(([0], np.cumsum(more)))[:-1]
        length *= 2
    # count is now n: one rank per window; all but the first of a rank are repeats
    order = np.lexsort((ws[row] + win, uid[row], did[row], rank))
    r = rank[order]
    hit = np.zeros(len(row), dtype=bool)
    hit[order[1:]] = r[1:] == r[:-1]
    return row[hit], win[hit]


def _window_ranks(units):
    """Window rows (a, did, uid, at, r): the rank of a window is the pair of the ranks of its halves,
    from ``width >> DOUBLINGS`` bytes on, hashed; both halves lie in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, step = T.Spans(), units.width >> DOUBLINGS
        for batch in batches:
            if not batch.num_rows:
                continue
            a, did, uid, ws, n = (batch.column(c).to_numpy() for c in ("a", "did", "uid", "ws", "n"))
            _, _, _, h = R.windows_in(units, batch.column("ctx"), n, powers)
            s = powers.sums(h)
            count = n.astype(np.int64) + units.width - step
            pos = T.expand(np.cumsum(count + step - 1) - (count + step - 1), count)
            rank = powers.hashes(s, pos, pos + step)
            length = step
            while length < units.width:
                more = count - length
                left = T.expand(np.cumsum(count) - count, more)
                rank = T.mix(rank[left] * np.uint64(0x9E3779B97F4A7C15) + rank[left + length])
                count = more
                length *= 2
            own = np.repeat(np.arange(len(n)), n)
            at = T.expand(ws.astype(np.int64), n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[own]), pa.array(did[own]), pa.array(uid[own]), pa.array(at.astype(np.int32)),
                 pa.array(rank.view(np.int64))], names=["a", "did", "uid", "at", "r"])
    return run


def doubled_in_spark(ctx: DataFrame, units: R.Units) -> DataFrame:
    """The same ranks as ``double`` for anchors with very many blocks: Spark sorts the windows by rank."""
    rows = ctx.mapInArrow(_window_ranks(units), "a long, did long, uid long, at int, r long")
    nth = F.row_number().over(Window.partitionBy("a", "r").orderBy("did", "uid", "at"))
    return (rows.withColumn("nth", nth).filter("nth > 1")
            .select("did", "uid", F.col("at").alias("ws"), F.lit(1).alias("n")))


def repeated_windows(docs: DataFrame, units: R.Units = R.Units(False, WIDTH, GRAM)) -> DataFrame:
    """(did, uid, ws, n): n windows from byte ws on also start earlier."""
    shared = R.shared_blocks(docs, units)
    classes = R.block_classes(shared)
    mixed = R.classes_per_anchor(classes)
    first = "did = c_did and uid = c_uid and ws = c_ws"
    # a block that is alone in its class is its first
    settled = (shared.join(classes.filter("k > 1").drop("n", "k"), ["a", "span"]).filter(f"not ({first})")
               .select("did", "uid", "ws", "n"))

    def contexts(kinds: str) -> DataFrame:
        # the earliest block of each kind speaks for its kind; not cut: all contexts and the caller's
        # join share one exchange of the texts
        open_ = (classes.join(mixed.filter(kinds).select("a"), "a")
                 .selectExpr("a", "c_did as did", "c_uid as uid", "c_ws as ws", "n"))
        return R.contexts(docs, open_, units)

    wide = f"kinds > {R.GROUP_ROWS}"
    hits = settled.unionByName(R.grouped_windows(contexts(f"not {wide}"), units, double))
    if mixed.filter(wide).isEmpty():
        return hits
    return hits.unionByName(doubled_in_spark(contexts(wide), units))


def _digest(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            hits = batch.column("hits")
            for lo, hi, buf, off in T.chunks(batch.column("text"), R.CHUNK):
                for r in range(hi - lo):
                    raw, h, spans = buf[off[r]:off[r + 1]], hits[lo + r], 0
                    kept = raw
                    if h.is_valid and len(h):
                        ws, n = (h.values.field(c).to_numpy().astype(np.int64) for c in ("ws", "n"))
                        gone = T.covered(len(raw), ws, n + width - 1)
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = raw[~gone]
                    kept = kept.tobytes()
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(len(raw) - len(kept))
                    out["n_spans"].append(spans)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        out["kept"].append(kept)
            cols = [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")),
                    pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                cols.append(pa.array(out["kept"], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``texts``) the kept bytes."""
    rows, documents = keyed(docs)
    hits = repeated_windows(documents, R.Units(False, width, gram))
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
              + (", kept binary" if texts else ""))
    return R.covered_units(rows, hits, _digest(width, texts), schema)


def suffix_report(docs: DataFrame) -> DataFrame:
    return dedup_bytes(docs, texts=False)
