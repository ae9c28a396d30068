"""Operator 11, source divergence audit by chunk factorization.

A task counts the blank-separated chunks of its documents, and sends for each (language,
chunk) of a block of documents its occurrences by source and its documents.  All rows of a
chunk meet after one shuffle, so each globally distinct chunk is tokenized once and its
terms are joined back to its counts; a second shuffle by (language, term) adds up
occurrences and distinct documents over the chunks that hold a term.

Documents of a term are counted to decide ``min_docs`` only.  A row carries the documents
themselves while they are fewer, and a mark afterwards: the union of such sets decides the
threshold exactly and no row grows with a common word.  Occurrences are whole.

The smoothed shares p = 1 + floor(10**9 (count + 5) / (N + 5 V)) are exact integers.  The
distance of two sources is summed over terms in cells of two tiles of sources, salted by
term, so neither a common term nor a large language is one task, and no pair is emitted
per term.

Defined results: null text, language and source are ''; every row is a document, repeated
rows included; a language without a kept term has pairs of value 0 and no term rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm import textops as T
from tenura.llm.frames import cut_lineage, written

MIN_DOCS = 30
SCALE = 1_000_000_000
ADD = 5                    # smoothing
TOP = 50
BLOCK_BYTES = 16 << 20     # text of a block of documents that one task counts at once
TILE = 128                 # sources of a tile; a cell compares two tiles
SALTS = 32
TERMS = 256                # terms of a dense piece of a cell
RUN_ROWS = 50_000          # rows that are merged at once

_BLANK = T.blank_separated()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# bytes of a term of [^\x00-\x40\x5B-\x60\x7B-\x7F]+
_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

_COUNTED = "lang string, {} string, sids array<long>, occs array<long>, docs array<long>, many boolean"


def _words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a chunk of rows as one string array, and the row of each word."""
    starts, ends, first = T.word_spans(buf, off, inside)
    ends -= starts
    at = np.zeros(len(ends) + 1, dtype=np.int64)
    np.cumsum(ends, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(buf[inside[buf]]))
    return words, np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(first))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _counted(lang, word, word_name, entries, in_docs, many) -> pa.RecordBatch:
    """Rows of _COUNTED from ``entries`` (row, sid, occurrences) and ``in_docs`` (row, document), both
    sorted; a row that is marked ``many`` leaves its documents out."""
    n = len(word)
    row, sid, occ = entries
    ends = np.searchsorted(row, np.arange(n + 1))
    keep = ~many[in_docs[0]]
    doc_row, doc = in_docs[0][keep], in_docs[1][keep]
    return pa.RecordBatch.from_arrays(
        [lang.cast(pa.string()), word.cast(pa.string()), _lists(sid, ends), _lists(occ, ends),
         _lists(doc, np.searchsorted(doc_row, np.arange(n + 1))), pa.array(many)],
        names=["lang", word_name, "sids", "occs", "docs", "many"])


def _add_up(key: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``count`` for each distinct (key, value), sorted."""
    order = np.lexsort((value, key))
    key, value, count = key[order], value[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])))) if len(key) else key
    return key[at], value[at], np.add.reduceat(count, at) if len(at) else count


def _count_chunks(min_docs: int):
    """Documents (lang, sid, text) -> counted chunks of each block of documents."""
    def block(held: list[pa.RecordBatch], first_doc: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        sid_of = table.column("sid").to_numpy()
        n = table.num_rows
        # documents are numbered by source, so that what is sorted by document is sorted by source
        by_sid = np.argsort(sid_of, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[by_sid] = np.arange(n)
        words, docs = [], []
        for lo, _, buf, off in T.chunks(table.column("text"), 1 << 30):
            w, d = _words(_LOWER[buf], off, _BLANK)
            words.append(w)
            docs.append(d + lo)
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        del words
        chunks, code = coded.dictionary, coded.indices.to_numpy()
        doc = docs[0] if len(docs) == 1 else np.concatenate(docs)
        if not len(code):
            return
        # one sort, in place: by (language, chunk, document); equal ones are a chunk's count in a document
        joined = langs.indices.to_numpy()[doc].astype(np.int64)
        joined *= len(chunks)
        joined += code
        joined *= n
        joined += place[doc]
        del coded, code, doc, docs
        joined.sort()
        at = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1])))
        occ = np.diff(np.concatenate((at, [len(joined)])))
        joined = joined[at]
        place, joined = joined % n, joined // n
        new = np.concatenate(([True], joined[1:] != joined[:-1]))
        key, names = np.cumsum(new) - 1, joined[new]
        sid = sid_of[by_sid][place]
        many = np.bincount(key) >= min_docs
        runs = np.flatnonzero(np.concatenate(([True], new[1:] | (sid[1:] != sid[:-1]))))
        out = _counted(langs.dictionary.take(pa.array(names // len(chunks))), chunks.take(pa.array(names % len(chunks))),
                       "chunk", (key[runs], sid[runs], np.add.reduceat(occ, runs)), (key, by_sid[place] + first_doc), many)
        yield from pa.Table.from_batches([out]).to_batches(max_chunksize=RUN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document is named by its partition and place; a repeated task gives the same names
        seen, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for lo, hi, buf, _ in T.chunks(batch.column("text"), BLOCK_BYTES):
                if held and size + len(buf) > BLOCK_BYTES:
                    yield from block(held, seen)
                    seen += sum(b.num_rows for b in held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(buf)
        if held:
            yield from block(held, seen)
    return run


def _merged(table: pa.Table, name: str, min_docs: int) -> pa.RecordBatch:
    """Rows sorted by (lang, name) -> one row for each, with sums, unions and marks."""
    lang, word = (table.column(c).combine_chunks() for c in ("lang", name))
    lc, wc = (x.dictionary_encode().indices.to_numpy() for x in (lang, word))
    new = np.concatenate(([True], (lc[1:] != lc[:-1]) | (wc[1:] != wc[:-1])))
    row, at = np.cumsum(new) - 1, np.flatnonzero(new)
    sids, occs, docs = (table.column(c).combine_chunks() for c in ("sids", "occs", "docs"))
    ekey, sid, occ = _add_up(row[pc.list_parent_indices(sids).to_numpy()], sids.flatten().to_numpy(),
                             occs.flatten().to_numpy())
    dkey, doc, _ = _add_up(row[pc.list_parent_indices(docs).to_numpy()], docs.flatten().to_numpy(),
                           np.ones(len(docs.flatten()), dtype=np.int64))
    many = np.bincount(dkey, minlength=len(at)) >= min_docs
    many[row[table.column("many").to_numpy()]] = True
    take = pa.array(at)
    return _counted(lang.take(take), word.take(take), name, (ekey, sid, occ), (dkey, doc), many)


def _whole_keys(batches: Iterator[pa.RecordBatch], names: list[str], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches -> one row for each key, in batches; a long key is added up as it comes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= RUN_ROWS:
            last = [held[-1].column(c)[-1].as_py() for c in names]
            same = np.ones(batch.num_rows, dtype=bool)
            for c, v in zip(names, last, strict=True):
                same &= pc.equal(batch.column(c), v).to_numpy(zero_copy_only=False)
            cut = int(same.argmin()) if not same.all() else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            done = _merged(pa.Table.from_batches(held).combine_chunks(), names[0], min_docs)
            if cut == batch.num_rows:                    # the last key goes on
                held, rows = [done], 0
                continue
            yield done
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield _merged(pa.Table.from_batches(held).combine_chunks(), names[0], min_docs)


def _terms_of_chunks(min_docs: int):
    """Rows sorted by (chunk, lang) -> counted terms; a chunk is tokenized once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _whole_keys(batches, ["chunk"], min_docs):
            coded = m.column("chunk").dictionary_encode()
            (_, _, buf, off), = T.chunks(coded.dictionary, 1 << 40)
            words, of = _words(buf, off, _TERM)
            if not len(words):
                continue
            terms = words.dictionary_encode()
            # (chunk, term) with the times that the term is in the chunk
            ck, tm, times = _add_up(of, terms.indices.to_numpy().astype(np.int64), np.ones(len(of), dtype=np.int64))
            first = np.searchsorted(ck, np.arange(len(coded.dictionary) + 1))
            code = coded.indices.to_numpy()
            n = first[code + 1] - first[code]
            at = T.expand(first[code], n)                     # of each row, its terms
            row = np.repeat(np.arange(len(code)), n)
            take = pa.array(row)
            occs = m.column("occs").take(take)
            occ = occs.flatten().to_numpy() * times[at][pc.list_parent_indices(occs).to_numpy()]
            yield from pa.Table.from_arrays(
                [m.column("lang").take(take), terms.dictionary.take(pa.array(tm[at])).cast(pa.string()),
                 m.column("sids").take(take), pa.ListArray.from_arrays(_offsets(occs), pa.array(occ)),
                 m.column("docs").take(take), m.column("many").take(take)],
                names=["lang", "term", "sids", "occs", "docs", "many"]).to_batches(max_chunksize=RUN_ROWS)
    return run


def _offsets(lists: pa.Array) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32))


def _kept_terms(min_docs: int):
    """Rows sorted by (term, lang) -> the terms in at least min_docs documents, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _whole_keys(batches, ["term", "lang"], min_docs):
            yield m.filter(m.column("many")).select(["lang", "term", "sids", "occs"])
    return run


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, sids, occs): the terms in at least ``min_docs`` documents of their language,
    with occurrences by source (sid: 64-bit hash of the source, see ``_groups``)."""
    rows = docs.select(_text("lang"), F.xxhash64(_text("source")).alias("sid"), _text("text"))
    chunks = rows.mapInArrow(_count_chunks(min_docs), _COUNTED.format("chunk"))
    terms = (chunks.repartition("chunk").sortWithinPartitions("chunk", "lang")
             .mapInArrow(_terms_of_chunks(min_docs), _COUNTED.format("term")))
    return (terms.repartition("term", "lang").sortWithinPartitions("term", "lang")
            .mapInArrow(_kept_terms(min_docs), "lang string, term string, sids array<long>, occs array<long>"))


def _groups(docs: DataFrame) -> DataFrame:
    """(lang, source, sid) of every occurring group."""
    groups = cut_lineage(docs.select(_text("lang"), _text("source")).distinct()
                         .withColumn("sid", F.xxhash64("source")))
    if not groups.groupBy("lang", "sid").count().filter("count > 1").isEmpty():
        raise ValueError("two sources of a language have the same 64-bit hash")
    return groups


def _share(count: str, total: str, terms: str) -> str:
    """p of a count; exact, for totals beyond 10**18 / SCALE too."""
    return (f"cast(1 + (cast({count} + {ADD} as decimal(19,0)) * cast({SCALE} as decimal(10,0))) "
            f"div ({total} + {ADD} * {terms}) as long)")


def _distances():
    """Cells sorted by (lang, salt, a, b, term): the first rows (term null) list the sources of the
    two tiles with their p of a count of 0 and the number of terms; the others hold p by source."""
    def cell(head: pa.Table, pieces: Iterator[pa.Table]):
        g0 = head.slice(0, 1).to_pylist()[0]
        idx = np.concatenate(head.column("idx").to_pylist() or [[]]).astype(np.int64)
        zero = np.concatenate(head.column("ps").to_pylist() or [[]]).astype(np.int64)
        order = np.argsort(idx)
        idx, zero = idx[order], zero[order]
        left, right = idx // TILE == g0["a"], idx // TILE == g0["b"]
        zl, zr = zero[left], zero[right]
        base = np.abs(zl[:, None] - zr[None, :])
        d = base * (g0["v"] if g0["salt"] == 0 else 0)
        for t in pieces:
            col, val = t.column("idx").combine_chunks(), t.column("ps").combine_chunks()
            m = np.tile(zero, (t.num_rows, 1))
            m[pc.list_parent_indices(col).to_numpy(), np.searchsorted(idx, col.flatten().to_numpy())] = (
                val.flatten().to_numpy())
            ml, mr = m[:, left], m[:, right]
            for i in range(len(zl)):
                d[i] += np.abs(mr - ml[:, i:i + 1]).sum(axis=0)
            d -= t.num_rows * base
        n = len(zr)
        return pa.RecordBatch.from_arrays(
            [pa.array([g0["lang"]] * d.size, pa.string()), pa.array(np.repeat(idx[left], n)),
             pa.array(np.tile(idx[right], len(zl))), pa.array(d.reshape(-1))], names=["lang", "g", "q", "d"])

    names = ["lang", "salt", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # streams the rows: a cell holds its sources and TERMS terms at a time
        def pieces():
            for batch in batches:
                for lo in range(0, batch.num_rows, TERMS):
                    part = batch.slice(lo, TERMS)
                    code = [part.column(c).dictionary_encode().indices.to_numpy() for c in names]
                    head = part.column("term").is_null().to_numpy(zero_copy_only=False)
                    cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (*code, head)], axis=0)) + 1
                    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), part.num_rows], strict=True):
                        p = part.slice(i, j - i)
                        yield tuple(p.column(c)[0].as_py() for c in names), bool(head[i]), pa.Table.from_batches([p])

        stream = pieces()
        item = next(stream, None)
        while item is not None:
            key, heads = item[0], []
            while item is not None and item[0] == key and item[1]:
                heads.append(item[2])
                item = next(stream, None)

            def rest(key=key):
                nonlocal item
                while item is not None and item[0] == key and not item[1]:
                    yield item[2]
                    item = next(stream, None)
            yield cell(pa.concat_tables(heads), rest())
    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), see the module text."""
    groups = _groups(docs)
    kept = written(kept_terms(docs, min_docs))
    entries = kept.select("lang", "term", F.aggregate("occs", F.lit(0).cast("long"), lambda x, y: x + y).alias("all"),
                          F.explode(F.arrays_zip("sids", "occs")).alias("e")).select(
        "lang", "term", "all", F.col("e.sids").alias("sid"), F.col("e.occs").alias("occ"))
    of_group = entries.groupBy("lang", "sid").agg(F.sum("occ").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate(
        "occs", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n_lang"))
    # idx: place of the source in its language; one row per group
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    stats = cut_lineage(groups.join(of_group, ["lang", "sid"], "left").join(of_lang, "lang", "left")
                        .fillna(0, ["n", "v", "n_lang"]).withColumn("idx", place))
    shares = (entries.join(stats, ["lang", "sid"])
              .withColumn("p", F.expr(_share("occ", "n", "v")))
              .withColumn("q", F.expr(_share("`all`", "n_lang", "v"))))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
             .withColumn("part", F.lit("term")))

    tiles = stats.groupBy("lang").agg((F.max("idx") / TILE).cast("long").alias("last"))
    tile = (F.col("idx") / TILE).cast("long")
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    pair = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    zero = F.when(F.col("v") > 0, F.expr(_share("0", "n", "greatest(v, 1)"))).otherwise(F.lit(0).cast("long"))
    own = ["lang", "salt", "a", "b", "v", "term", "idx", "ps"]
    heads = (stats.withColumn("tile", tile).join(tiles, "lang")
             .select("lang", "v", "tile", partner, F.array("idx").alias("idx"), F.array(zero).alias("ps"))
             .select("lang", "v", *pair, "idx", "ps", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
             .withColumn("term", F.lit(None).cast("string")).select(*own))
    by_tile = (shares.groupBy("lang", "term", tile.alias("tile"))
               .agg(F.collect_list(F.struct("idx", "p")).alias("e")))      # at most TILE entries
    spread = (by_tile.join(tiles, "lang").select("lang", "term", "tile", partner, "e")
              .select("lang", "term", *pair, "e", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")))
    # a term with entries in both tiles of a cell is one row there
    cells = (spread.groupBy("lang", "salt", "a", "b", "term").agg(F.flatten(F.collect_list("e")).alias("e"))
             .select("lang", "salt", "a", "b", F.lit(0).cast("long").alias("v"), "term", F.col("e.idx").alias("idx"),
                     F.col("e.p").alias("ps")))
    sums = (heads.unionByName(cells).repartition("lang", "salt", "a", "b")
            .sortWithinPartitions("lang", "salt", "a", "b", "term")        # the null term first
            .mapInArrow(_distances(), "lang string, g long, q long, d long")
            .groupBy("lang", "g", "q").agg(F.sum("d").alias("value")))
    # tiles of one cell: both directions are there within a tile, one direction across two
    across = F.expr(f"g div {TILE} <> q div {TILE}")
    both = sums.unionByName(sums.filter(across).select("lang", F.col("q").alias("g"), F.col("g").alias("q"), "value"))
    names = stats.select("lang", "idx", "source")
    pairs = (both.filter("g <> q")
             .join(names.withColumnRenamed("idx", "g"), ["lang", "g"])
             .join(names.select("lang", F.col("idx").alias("q"), F.col("source").alias("item")), ["lang", "q"])
             .withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair")))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*cols).unionByName(terms.select(*cols))
