"""Operator 7, MinHash near-dedup.

A document is its set of distinct ``shingle``-word shingles (A-Z lower-cased; fewer words:
the whole sequence).  Documents of equal word sequences (by the BLAKE2b digest of the
words) become one node.  Every set has BANDS * ROWS universal hash minima; nodes that
share a band of ROWS minima meet in a bucket.  In a bucket each node is paired with the
least one; pairs that pass the signature estimate are confirmed on the full shingle sets,
the shingles themselves and not their hashes, and components come from alternating
large-star and small-star.

Buckets that still hold several components are not closed: every pair of different
components in them is estimated, in cells of at most two blocks of CELL nodes that are
sorted together (``cells.deal``); a pair is estimated from its minima, then counted on half
hashes of its sets, and only pairs that pass leave the task for the confirmation on the
full sets.  No pair is dropped for the size of its bucket.  The members of a bucket's
largest component are shipped once for each block of nodes outside it, so the rows grow
with the bucket unless very many of its nodes stay apart.  With 32 bands of 4 a pair at
similarity 0.8 shares no band with probability 5e-8.

Defined results: a null or wordless text has an empty set and links with nothing; a null
doc_id is later than any and a component of null ids has a null component_id; rows of
equal doc_id and text are one document, of equal doc_id and other text two; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm import textops as T
from tenura.llm.cells import deal
from tenura.llm.components import components
from tenura.llm.frames import NO_ID, cut_lineage, ids_are_unique, keys, written

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 4
MARGIN = 0.2           # 5.6 standard errors of a 128-minima estimate at 0.8
CELL = 1024            # nodes of a block; a cell compares two blocks
BROADCAST_ROWS = 200_000   # 24 bytes each

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MUL, _ADD = (_SEEDS[0] << np.uint64(1)) | np.uint64(1), _SEEDS[1]
_VALUES = T.byte_values(lower=True)
_IS_WORD = T.blank_separated()


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int, powers: T.Spans) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    starts, ends, first = T.word_spans(buf, off, _IS_WORD)
    h = powers.hashes(powers.sums(_VALUES[buf]), starts, ends)
    s = powers.sums(h)
    at = np.arange(max(0, len(h) - k + 1))
    grams = powers.hashes(s, at, at + k)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= k:
            g = np.sort(grams[i:j - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif j > i:
            out.append(powers.hashes(s, np.array([i]), np.array([j])))
        else:
            out.append(grams[:0])
    return out


def shingles(text: str | None, k: int) -> set[bytes]:
    """The shingles themselves."""
    words = (text or "").encode().lower().split()      # bytes: A-Z and ASCII blanks only
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


def _digest(text: str | None) -> bytes:
    """128 bits of the BLAKE2b of the word sequence."""
    return hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS) upper halves of the universal hash minima; sets are not empty."""
    flat = np.concatenate(sets)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    sig = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    t = np.empty_like(flat)
    for i in range(BANDS * ROWS):
        np.multiply(flat, _MUL[i], out=t)
        t += _ADD[i]
        sig[:, i] = np.minimum.reduceat(t, begin) >> np.uint64(32)
    return sig


def _band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sig), BANDS), dtype=np.uint64)
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        x = T.mix(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return T.mix(x + np.arange(BANDS, dtype=np.uint64))


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.give_back()
        powers = T.Spans()
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, buf, off in T.chunks(batch.column("text"), 1 << 18):
                sets = shingle_sets(buf, off, shingle, powers)
                n = np.array([len(x) for x in sets])
                some = np.flatnonzero(n)
                sig = np.zeros((len(sets), BANDS * ROWS), dtype=np.uint32)
                if len(some):
                    sig[some] = signatures([sets[i] for i in some])
                d = np.frombuffer(b"".join(map(_digest, batch.column("text").slice(lo, hi - lo).to_pylist())),
                                  dtype=np.int64).reshape(-1, 2)
                raw = sig.tobytes()
                w = BANDS * ROWS * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(lo, hi - lo), batch.column("uid").slice(lo, hi - lo),
                     pa.array(n.astype(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()),
                     pa.array([raw[i * w:i * w + w] for i in range(len(sets))], pa.binary())],
                    names=["did", "uid", "n_shingles", "d1", "d2", "sig"])
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _signature_matrix(batch.column("sig"))
        keys_ = _band_keys(sig).view(np.int64)
        v = batch.column("v").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys_.reshape(-1)), pa.array(np.repeat(v, BANDS)),
                                           pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(v)))],
                                          names=["key", "v", "band"])


def _signature_matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint32).reshape(len(col), BANDS * ROWS)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signature_matrix(batch.column("sig_a")) == _signature_matrix(batch.column("sig_b"))).mean(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= percent / 100 - MARGIN))
    return run


def _compact(shingle: int):
    """(v, sig, set, keys): low bytes of the minima, low halves of the shingle hashes, full band keys.

    The first two only ever make two sets look more alike than they are, so a pair refused
    on them is no link; a pair that passes is confirmed on the full sets.  The band keys are
    whole: they tell in which buckets a pair meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = T.Spans()
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, buf, off in T.chunks(batch.column("text"), 1 << 18):
                sets = shingle_sets(buf, off, shingle, powers)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("v").slice(lo, hi - lo),
                     pa.array([x.tobytes() for x in (sig & 255).astype(np.uint8)], pa.binary()),
                     pa.array([np.sort(x.astype(np.uint32)).tobytes() for x in sets], pa.binary()),
                     pa.array([x.tobytes() for x in _band_keys(sig)], pa.binary())],
                    names=["v", "sig", "set", "keys"])
    return run


def _cells(percent: int):
    """Pairs of different components of one cell (rows of one key, c0, c1) that pass the estimate.

    Only pairs that pass leave; a cell holds at most about two blocks of CELL rows."""
    need = (percent / 100 - MARGIN) * BANDS * ROWS

    def compare(cell: pa.Table) -> pa.RecordBatch | None:
        v, comp, i = (cell.column(c).to_numpy().copy() for c in ("v", "comp", "i"))
        if (comp == comp[0]).all():
            return None
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), dtype=np.uint8).reshape(len(v), BANDS * ROWS)
        bands = np.frombuffer(b"".join(cell.column("keys").to_pylist()), dtype=np.uint64).reshape(len(v), BANDS)
        sets = [np.frombuffer(x, dtype=np.uint32) for x in cell.column("set").to_pylist()]
        n, band = np.array([len(x) for x in sets]), cell.column("band")[0].as_py()
        across = cell.column("c0")[0].as_py() != cell.column("c1")[0].as_py()
        a, b = [], []
        for r in range(len(v) - 1):
            ok = comp[r + 1:] != comp[r]
            if across:
                ok &= i[r + 1:] != i[r]
            m = n[r + 1:]
            ok &= 100 * np.minimum(m, n[r]) >= percent * np.maximum(m, n[r])
            at = np.flatnonzero(ok) + r + 1
            if not len(at):
                continue
            at = at[(sig[at] == sig[r]).sum(axis=1) >= need]
            # a pair is looked at in the first band that it shares, by the keys that made the buckets
            at = at[(bands[at] == bands[r]).argmax(axis=1) == band]
            if not len(at):
                continue
            flat = np.concatenate([sets[k] for k in at])
            place = np.minimum(np.searchsorted(sets[r], flat), n[r] - 1)
            begin = np.concatenate(([0], np.cumsum(n[at])[:-1]))
            both = np.minimum(np.add.reduceat((sets[r][place] == flat).astype(np.int64), begin), np.minimum(n[at], n[r]))
            link = 100 * both >= percent * (n[at] + n[r] - both)
            a.append(np.full(int(link.sum()), v[r]))
            b.append(v[at[link]])
            # links that collisions of half hashes could not have made join the components here; with
            # `chance` expected collisions, more than `spare` have a probability below 1e-12
            chance = n[at] * (float(n[r]) / (1 << 32))
            both -= np.where(chance < 1e-4, 2, 12 + np.ceil(10 * chance)).astype(np.int64)
            for k in at[100 * both >= percent * (n[at] + n[r] - both)]:
                if comp[k] != comp[r]:
                    comp[comp == comp[k]] = comp[r]
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def name(batch, k):
            return tuple(batch.column(c)[k].as_py() for c in ("key", "c0", "c1"))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "c0", "c1")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and name(held[0], 0) != name(part, 0):
                    out = compare(pa.Table.from_batches(held).combine_chunks())
                    held = []
                    if out is not None:
                        yield out
                held.append(part)
        if held:
            out = compare(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out
    return run


def _confirm(shingle: int, percent: int):
    """Pairs whose full sets reach the similarity, by hashes and then by the shingles themselves;
    neighbouring rows of one ``a`` share its sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, hashed, real = T.Spans(), None, None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            keep = []
            for lo, _, buf, off in T.chunks(text_b, 1 << 18):
                for r, set_b in enumerate(shingle_sets(buf, off, shingle, powers), start=lo):
                    if a[r] != last:
                        last, real = a[r], None
                        (_, _, b0, o0), = T.chunks(text_a.slice(r, 1))
                        hashed, = shingle_sets(b0, o0, shingle, powers)
                    both = len(np.intersect1d(hashed, set_b, assume_unique=True))
                    ok = 100 * both >= percent * (len(hashed) + len(set_b) - both)
                    if ok:
                        real = shingles(text_a[r].as_py(), shingle) if real is None else real
                        other = shingles(text_b[r].as_py(), shingle)
                        both = len(real & other)
                        ok = 100 * both >= percent * (len(real) + len(other) - both)
                    keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(did, uid, n_shingles, c_did, c_uid): per row the least document of its component."""
    unique = ids_are_unique(docs)
    did, uid = keys(docs, unique=unique)
    rows = docs.select(did, uid, F.col("text").cast("string").alias("text"))
    sketched = written(rows.mapInArrow(
        _sketch(shingle), "did long, uid long, n_shingles long, d1 long, d2 long, sig binary"))
    # one node per distinct word sequence, named by its least document
    node = F.col("did") if unique else F.xxhash64("did", "uid")
    sets = ["d1", "d2", "n_shingles"]
    least = F.min(F.struct("did", "uid")).alias("m")
    nodes = (sketched.filter("n_shingles > 0").groupBy(*sets).agg(least, F.first("sig").alias("sig"))
             .select(*sets, F.col("m.did").alias("did"), F.col("m.uid").alias("uid"), "sig"))
    nodes = written(nodes.withColumn("v", node))
    comp = _link(rows, nodes.select("v", "did", "uid", "sig"), shingle, percent)
    labelled = (nodes.drop("sig").join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v")))
    if unique:
        labelled = labelled.withColumn("c_did", F.col("comp")).withColumn("c_uid", F.lit(0).cast("long"))
    else:
        names = labelled.groupBy("comp").agg(least).select("comp", F.col("m.did").alias("c_did"),
                                                           F.col("m.uid").alias("c_uid"))
        labelled = labelled.join(names, "comp")
    labelled = labelled.select(*sets, "c_did", "c_uid")
    return (sketched.drop("sig").join(labelled, sets, "left")
            .select("did", "uid", "n_shingles", F.coalesce("c_did", "did").alias("c_did"),
                    F.coalesce("c_uid", "uid").alias("c_uid")))


def _link(rows: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(v, comp) of the nodes that have a link."""
    band = nodes.select("v", "sig").mapInArrow(_bands, "key long, v long, band int")
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("m")).filter("k > 1")
    buckets = written(band.join(shared, "key"))          # nodes that meet others
    stars = cut_lineage(_pairs(buckets.select(F.col("m").alias("a"), F.col("v").alias("b"))))
    edges = _verified(stars, rows, nodes, shingle, percent)
    comp = components(edges)
    # buckets that still hold several components: all pairs of different ones are estimated
    at = written(buckets.join(comp, "v", "left").select("key", "band", "v", F.coalesce("comp", "v").alias("comp")))
    cells = written(deal(at, ["key"], "v", CELL))
    active = nodes.select("v", "did", "uid").join(cells.select("v").distinct(), "v")
    compact = _texts(rows, active).mapInArrow(_compact(shingle), "v long, sig binary, set binary, keys binary")
    cells = cells.join(compact, "v")
    more = (cells.repartition("key", "c0", "c1").sortWithinPartitions("key", "c0", "c1")
            .mapInArrow(_cells(percent), "a long, b long"))
    more = _pairs(more).join(stars, ["a", "b"], "left_anti")
    extra = _verified(cut_lineage(more), rows, nodes, shingle, percent, estimated=True)
    if extra.isEmpty():
        return comp
    # components so far stand as stars
    known = comp.filter("v <> comp").select(F.col("comp").alias("a"), F.col("v").alias("b"))
    return components(known.unionByName(extra))


def _texts(rows: DataFrame, who: DataFrame) -> DataFrame:
    """(v, text) of the nodes ``who``; these are broadcast only when counted below a bound."""
    who = cut_lineage(who)
    if who.count() <= BROADCAST_ROWS:
        who = F.broadcast(who)
    return rows.join(who, ["did", "uid"]).select("v", "text")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int,
              estimated: bool = False) -> DataFrame:
    """Signature estimate first, then the full sets of what is left."""
    near = pairs
    if not estimated:
        sig = nodes.select("v", "sig")
        near = cut_lineage(pairs.join(sig.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a")
                           .join(sig.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
                           .select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate(percent), "a long, b long"))
    needed = near.select(F.col("a").alias("v")).unionByName(near.select(F.col("b").alias("v"))).distinct()
    who = nodes.select("v", "did", "uid").join(needed, "v")
    texts = written(_texts(rows, who))
    both = (near.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))
    return cut_lineage(both.mapInArrow(_confirm(shingle, percent), "a long, b long"))


def near_duplicate_report(docs: DataFrame, shingle: int = 4, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    out = near_duplicates(docs.select("doc_id", "text"), shingle, percent)
    null = F.lit(NO_ID)
    return out.select(F.nullif("did", null).alias("doc_id"), "n_shingles",
                      F.nullif("c_did", null).alias("component_id"), (F.col("did") == F.col("c_did")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component (the least id); columns as they were."""
    unique = ids_are_unique(docs)
    did, uid = keys(docs, unique=unique)
    keep = (near_duplicates(docs, shingle, percent).filter("did = c_did and uid = c_uid").select("did", "uid"))
    full = docs.select(did, uid, F.struct("*").alias("row"))
    if not unique:
        full, keep = full.dropDuplicates(["did", "uid"]), keep.distinct()
    return full.join(keep, ["did", "uid"], "left_semi").select("row.*")
