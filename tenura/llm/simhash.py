"""Operator 12, SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of the
document's ``shingle``-word shingles, repeats included.  Fingerprints link at ``radius`` or
fewer differing bits.

Equal fingerprints are one node.  The 64 bits are cut into radius + 2 blocks: two nodes in
reach agree on at least two whole blocks, so they meet in a bucket of one of the
(radius + 2 over 2) tables keyed by two blocks.  In a bucket each node is compared with the
node of most documents; components of these links come from alternating large-star and
small-star.  Buckets that still hold several components go to bounded cells
(``cells.deal``), where all nodes outside the largest component are compared with all
others, bit-sliced: a word of plane b holds bit b of 64 nodes, the planes of the
difference to a node are added to carry-save counters, and words all of whose 64 distances
exceed the radius are abandoned after every few planes.  A cell emits one link for each
pair of components that it finds linked.

Defined results: a null or wordless text has the fingerprint 0, which is linked like any
other; a null doc_id is later than any and a component of null ids has a null
component_id; rows of equal id each get a row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.cells import deal
from tenura.llm.components import components
from tenura.llm.frames import NO_ID, cut_lineage, written
from tenura.llm.textops import expand

SHINGLE = 4
RADIUS = 4
SEED = 42
CELL = 4096                # nodes of a block of a cell
TASKS = 1 << 18            # words of 64 distances that are counted at once
PLANES = 8                 # planes between two looks at what can be abandoned
PIECE = 1 << 16            # shingles whose bits are added up at once

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()     # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.fromiter((_hash(joined[a:b]) for a, b in spans), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, PIECE):
        part = hashes[i:i + PIECE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > n)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(f.view(np.int64))], names=["did", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(did, fp) of every row: the id (a null last) and the fingerprint as a signed long."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
                       F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "did long, fp long")


def _tables(radius: int) -> list[int]:
    """Bit masks: every two of radius + 2 blocks of the 64 bits."""
    n = radius + 2
    cut = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(cut[i], cut[i + 1])) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit k of word w of plane b is bit b of node 64 w + k; len(fp) is a multiple of 64."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").astype(np.uint64).reshape(64, -1)


def within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For tasks (fingerprint, word of 64 nodes): (tasks left, mask of the nodes within ``radius``)."""
    depth = max(1, radius.bit_length())
    left = np.arange(len(query))
    count = np.zeros((depth, len(query)), dtype=np.uint64)
    over = np.zeros(len(query), dtype=np.uint64)
    for b in range(64):
        flip = np.where((query >> np.uint64(b)) & np.uint64(1), _ALL, np.uint64(0))
        carry = planes[b][word] ^ flip
        for level in range(depth):
            count[level], carry = count[level] ^ carry, count[level] & carry
        over |= carry
        if b % PLANES == PLANES - 1:
            full = over | _above(count, radius)
            alive = full != _ALL
            if not alive.all():
                left, query, word, over = left[alive], query[alive], word[alive], over[alive]
                count = count[:, alive]
            if not len(left):
                break
    return left, ~(over | _above(count, radius))


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose binary counter exceeds ``radius``."""
    above = np.zeros(count.shape[1], dtype=np.uint64)
    equal = np.full(count.shape[1], _ALL, dtype=np.uint64)
    for level in range(count.shape[0] - 1, -1, -1):
        if radius >> level & 1:
            equal &= count[level]
        else:
            above |= equal & count[level]
            equal &= ~count[level]
    return above


def _compare(cell: np.ndarray, fp: np.ndarray, comp: np.ndarray, first: np.ndarray, radius: int):
    """Links (a, b) of different components within the cells of one run; one for each pair of
    components that is found linked at a time.

    cell numbers the cells, sorted; ``first``: member of block c0, whose nodes are the queries."""
    order = np.lexsort((comp, first, cell))
    cell, fp, comp, first = cell[order], fp[order], comp[order], first[order]
    at = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
    size = np.diff(np.concatenate((at, [len(cell)])))
    # each cell begins at a word of its own
    words = -(-size // 64)
    base = np.concatenate(([0], np.cumsum(words)))
    place = np.repeat(base[:-1] * 64 - at, size) + np.arange(len(cell))
    node = np.full(base[-1] * 64, -1)
    node[place] = np.arange(len(cell))
    wide = np.zeros(len(node), dtype=np.uint64)
    wide[place] = fp
    planes = bit_planes(wide)
    ncell = np.repeat(np.arange(len(size)), size)
    queries = np.flatnonzero(first)
    nw = words[ncell[queries]]
    done = np.concatenate(([0], np.cumsum(nw)))
    # component names in small numbers, joined as links are found
    _, label = np.unique(comp, return_inverse=True)
    lanes = node.reshape(-1, 64)
    at = 0
    while at < len(queries):
        end = max(at + 1, int(np.searchsorted(done, done[at] + TASKS, side="right")) - 1)
        q = np.repeat(queries[at:end], nw[at:end])
        w = expand(base[ncell[queries[at:end]]], nw[at:end])
        own = np.where(lanes >= 0, label[lanes], -1)
        # words whose nodes are all of the query's component need no look
        lo = np.where(lanes >= 0, own, label.max() + 1).min(axis=1)
        hi = own.max(axis=1)
        keep = ~((lo[w] == label[q]) & (hi[w] == label[q]))
        q, w = q[keep], w[keep]
        at = end
        if not len(q):
            continue
        left, mask = within(planes, fp[q], w, radius)
        q, w = q[left], w[left]
        near = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        task, lane = np.nonzero(near & (lanes[w] >= 0))
        a, b = q[task], lanes[w[task], lane]
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        pair = np.sort(np.stack((label[a], label[b])), axis=0)
        _, one = np.unique(pair[0].astype(np.int64) * len(label) + pair[1], return_index=True)
        yield fp[a[one]], fp[b[one]]
        label = _joined(label, pair[:, one])


def _joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels after the components of ``pairs`` are joined."""
    up = np.arange(label.max() + 1)
    for x, y in pairs.T.tolist():
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up = up[up]
    return up[label]


def _cells(radius: int):
    """Rows sorted by (t, key, c0, c1), whole cells at a time."""
    names = ["t", "key", "c0", "c1"]

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        cols = [t.column(c).to_numpy() for c in names]
        cell = np.concatenate(([0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols], axis=0))))
        fp = t.column("fp").to_numpy().view(np.uint64)
        first = t.column("i").to_numpy() == cols[2]
        for a, b in _compare(cell, fp, t.column("comp").to_numpy(), first, radius):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= 2 * CELL:
                end = [held[-1].column(c)[-1].as_py() for c in names]
                same = np.all([batch.column(c).to_numpy() == v for c, v in zip(names, end, strict=True)], axis=0)
                cut = batch.num_rows if same.all() else int(same.argmin())
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    continue
                yield from links(held)
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from links(held)
    return run


def linked(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (fp, w): distinct fingerprints and their numbers of documents -> (v, comp) of the linked ones."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
                       for t, m in enumerate(_tables(radius))])
    rows = nodes.select("fp", "w", F.explode(tables).alias("x")).select("x.t", "x.key", "fp", "w")
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("k"), F.max_by("fp", "w").alias("hub")).filter("k > 1")
    buckets = written(rows.drop("w").join(shared.drop("k"), ["t", "key"]))
    stars = (buckets.filter((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= radius))
             .select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct())
    comp = cut_lineage(components(stars))
    at = (buckets.join(comp.withColumnRenamed("v", "fp"), "fp", "left")
          .select("t", "key", "fp", F.coalesce("comp", "fp").alias("comp")))
    cells = deal(written(at), ["t", "key"], "fp", CELL)
    more = (cells.repartition("t", "key", "c0", "c1").sortWithinPartitions("t", "key", "c0", "c1")
            .select("t", "key", "c0", "c1", "i", "fp", "comp").mapInArrow(_cells(radius), "a long, b long"))
    more = cut_lineage(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if more.isEmpty():
        return comp
    known = comp.filter("v <> comp").select(F.col("comp").alias("a"), F.col("v").alias("b"))
    return components(known.unionByName(more))


def similar(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(did, fp, c_did): per row the least id of its component."""
    of = written(fingerprints(docs, shingle))
    nodes = cut_lineage(of.groupBy("fp").agg(F.count(F.lit(1)).alias("w"), F.min("did").alias("least")))
    comp = linked(nodes.select("fp", "w"), radius)
    named = nodes.join(comp.withColumnRenamed("v", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("c_did"))
    return of.join(named.select("fp", "comp").join(least, "comp").select("fp", "c_did"), "fp").select("did", "fp", "c_did")


def simhash_report(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    null = F.lit(NO_ID)
    return similar(docs, shingle, radius).select(
        F.nullif("did", null).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("c_did", null).alias("component_id"))
