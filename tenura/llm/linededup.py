"""Operator 3, line dedup by distinct-site spread.

A line (text between ``\\n``, trimmed of blanks, empty lines left alone) that occurs
on at least ``min_sites`` distinct sites (column ``source``; a null site is one site)
is boilerplate.  Its earliest occurrence, by document id and line number, stays; every
other occurrence is removed.

The spread is estimated first: one HyperLogLog sketch of sites per line hash, built
before the shuffle and merged by aggregation.  Lines whose estimate is clearly below
or above the threshold are settled; the lines within ``margin`` of it get an exact
count of distinct sites.  Hot lines meet no single task: sketches and minima are
aggregated map-side, exact counts run over distinct (line, site) pairs, and the
removal joins are ordinary equi-joins that AQE can split (broadcast only below a
counted bound).

Defined results: a null text has no lines and stays null; repeated document rows
count as one document; a null id is later than any other; an empty table gives an
empty result; texts keep their remaining lines in order, joined by ``\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tenura.llm.frames import cut_lineage, keys

MIN_SITES = 10
MARGIN = 0.35            # lg k = 8: standard error 6.5 %, so over five of them
LG_K = 8
BROADCAST_ROWS = 200_000  # 24 bytes each

_BLANKS = " \t\r\x0b\x0c"


def _hash(line):
    return F.xxhash64(F.trim(line, F.lit(_BLANKS)))


def _filled(line):
    return F.length(F.trim(line, F.lit(_BLANKS))) > 0


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """(did, uid, pos, line, site) for each non-empty line."""
    base = docs.select("did", "uid", F.col(site).alias("site"),
                       F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return base.filter(_filled(F.col("raw"))).select("did", "uid", "pos", _hash(F.col("raw")).alias("line"),
                                                     F.coalesce("site", F.lit("")).alias("site"),
                                                     F.col("site").isNull().alias("no_site"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line, keep): hashes of lines on at least ``min_sites`` sites and their earliest place."""
    site_key = F.xxhash64("site", "no_site")
    spread = (lines.groupBy("line")
              .agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(site_key, F.lit(LG_K)).alias("sketch"),
                   F.min(F.struct("did", "uid", "pos")).alias("keep"))
              # a line needs as many occurrences as sites
              .filter(F.col("n") >= min_sites)
              .select("line", "keep", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = cut_lineage(spread.filter(F.col("sites") >= min_sites * (1 - margin)))
    sure = spread.filter(F.col("sites") > min_sites * (1 + margin))
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin))
    if near.isEmpty():
        return sure.select("line", "keep")
    exact = (_bounded(near.select("line"), lines.select("line", site_key.alias("s")), ["line"])
             .distinct().groupBy("line").count().filter(F.col("count") >= min_sites).select("line"))
    return sure.select("line", "keep").unionByName(near.join(exact, "line").select("line", "keep"))


def _bounded(small: DataFrame, big: DataFrame, on: list[str]) -> DataFrame:
    """big join small; small is broadcast only when it has been counted below the bound."""
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on)


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(did, uid, gone): line numbers to remove per document; docs is (did, uid, text, site)."""
    lines = line_table(docs, site)
    bad = cut_lineage(boilerplate_lines(lines, min_sites))
    hits = _bounded(bad, lines.select("did", "uid", "pos", "line"), ["line"])
    return (hits.filter(F.struct("did", "uid", "pos") != F.col("keep"))
            .groupBy("did", "uid").agg(F.collect_set("pos").alias("gone")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            counts.append(sum(1 for x in lines if x.strip(_BLANKS)))
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            texts.append(text)
            dropped.append(len(gone or ()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
             pa.array(dropped, pa.int64())], names=["rest", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(rest, text, n_lines, n_removed): the other columns as a struct, the text after removal."""
    did, uid = keys(docs)
    gone = removed_lines(docs.select(did, uid, "text", site), min_sites, site)
    full = docs.select(did, uid, F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "text")
    joined = full.join(gone, ["did", "uid"], "left").select("rest", "text", "gone")
    return joined.mapInArrow(_cut, StructType([joined.schema["rest"], StructField("text", StringType()),
                                               StructField("n_lines", LongType()),
                                               StructField("n_removed", LongType())]))


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 of the remaining text, text."""
    out = dedup_lines(docs.select("doc_id", "text", "source"), min_sites)
    return out.select("rest.doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with cleaned texts; every row and the columns stay, n_chars follows the text."""
    out = dedup_lines(docs, min_sites)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)
                                    ).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return out.select(*[changed.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns])
