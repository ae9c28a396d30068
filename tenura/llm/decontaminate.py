"""Operator 1, benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows of ``window`` words
(an item of fewer words is one window).  All windows go into one automaton; each
document is normalised the same way and scanned once.  The automaton reports end
offsets in the normalised text, which are mapped to word numbers and, through the
word spans, to byte offsets of the original text.

Defined results: a null or empty text has no words and is clean; a null or wordless
item never matches; a null item_id is written as an empty string; equal items with
different ids all count; repeated documents are judged each for itself; an empty
benchmark leaves every document clean; other columns are not read.

The item table is broadcast only in blocks of at most ``block_bytes`` of window
text, measured first; with more than one block the documents pass the blocks one
after the other (an exact set against all rows, in blocks, with a checkpoint
between), and the hits are merged per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tenura.llm.frames import cut_lineage

WINDOW = 10
BLOCK_BYTES = 16 << 20

# A-Z lower-cased; every other byte outside words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ becomes a blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def item_windows(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def build_automaton(items: list[tuple[str, str]], window: int):
    """(automaton over ' w1 w2 ... ' patterns, item ids of each pattern)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in item_windows(text.encode("utf-8", "surrogatepass").translate(_FOLD).split(), window):
            owners.setdefault(w, set()).add(item_id)
    auto = ahocorasick.Automaton()
    ids = []
    for n, (w, who) in enumerate(sorted(owners.items())):
        auto.add_word(" " + w.decode("utf-8", "surrogatepass") + " ", (n, w.count(b" ") + 1))
        ids.append(sorted(who))
    if ids:
        auto.make_automaton()
    return auto, ids


def scan_text(text: str | None, auto, ids) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged hit intervals [first, end) in words, ids of the items found."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words or not ids:
        return len(words), [], set()
    flat = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    ends, spans, found = None, [], set()
    for at, (n, length) in auto.iter(flat):
        if ends is None:   # offsets of the blanks: a match that ends at blank k+1 ends with word k
            blanks = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
            ends = blanks
        last = int(np.searchsorted(ends, at))
        spans.append((last - length, last))
        found.add(n)
    spans.sort()
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(words), [(a, b) for a, b in merged], {i for n in found for i in ids[n]}


_built: dict = {}


def _automaton(items, window):
    """One automaton per worker process and block, named by the block's token."""
    token, rows = items.value
    key = (token, window)
    if _built.get("key") != key:
        _built.update(key=key, value=build_automaton(rows, window))
    return _built["value"]


def _scan(items, window: int, text: str, keep: list[str], result: pa.DataType):
    """Adds the hits of one block to each row; of the row, ``keep`` columns are returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, ids = _automaton(items, window)
        for batch in batches:
            row, hits = batch.column("row"), []
            for x, before in zip(row.field(text), batch.column("hit"), strict=True):
                n, spans, found = scan_text(x.as_py(), auto, ids)
                spans = [{"first": a, "end": b} for a, b in spans]
                if before.is_valid:
                    old = before.as_py()
                    spans, found = old["spans"] + spans, found | set(old["items"])
                hits.append({"n_words": n, "spans": spans, "items": sorted(found)})
            names = [row.type.field(i).name for i in range(row.type.num_fields)]
            kept = pa.StructArray.from_arrays([row.field(names.index(c)) for c in keep],
                                              fields=[row.type.field(names.index(c)) for c in keep])
            yield pa.RecordBatch.from_arrays([kept, pa.array(hits, result)], names=["row", "hit"])
    return run


def _blocks(benchmark: DataFrame, block_bytes: int, item_id: str, text: str, window: int) -> list:
    """Broadcasts of at most about ``block_bytes`` of window text each."""
    sc = benchmark.sparkSession.sparkContext

    def share(block: DataFrame):
        return sc.broadcast((uuid.uuid4().hex, [(r.i, r.t) for r in block.collect()]))

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.col(text).cast("string").alias("t")).filter("t is not null").distinct()
    # windows repeat each word up to ``window`` times
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] * window
    n = max(1, -(-int(total) // block_bytes))
    if n == 1:
        return [share(items)]
    parts = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    return [share(parts.filter(F.col("b") == k)) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, hit): the columns ``keep`` of each document, and n_words, spans (word intervals
    hit, possibly overlapping) and items (ids found)."""
    hit = StructType.fromDDL("n_words long, spans array<struct<first:long,end:long>>, items array<string>")
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(hit).alias("hit"))
    blocks = _blocks(benchmark, block_bytes, item_id, item_text, window)
    for k, items in enumerate(blocks):
        last = k == len(blocks) - 1
        cols = (keep or docs.columns) if last else docs.columns
        row = StructType([docs.schema[c] for c in cols])
        out = out.mapInArrow(_scan(items, window, text, list(cols), to_arrow_type(hit)),
                             StructType([StructField("row", row, False), StructField("hit", hit)]))
        if not last:
            out = cut_lineage(out)
    return out


def union_length(spans: str = "spans"):
    """Number of words in the union of the intervals (they may overlap between blocks)."""
    return F.expr(f"aggregate(array_sort({spans}), named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct("
                  "'n', a.n + greatest(0L, s.end - greatest(s.first, a.e)), 'e', greatest(a.e, s.end)), a -> a.n)")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("hit.n_words").alias("n_words"),
        union_length("hit.spans").alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("hit.items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hit.spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window; columns as they were."""
    return find_contamination(docs, benchmark, window).filter(F.size("hit.spans") == 0).select("row.*")


def original_span(text: str, first: int, end: int) -> tuple[int, int]:
    """Byte offsets in the original text of words [first, end)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], raw.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return int(starts[first]), int(ends[end - 1])
