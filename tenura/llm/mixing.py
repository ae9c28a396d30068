"""Operator 6, mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, capped at ``most`` times its own
size (the excess is reshared).  With rate r = target / size, each document is due r
copies: floor(r) for certain and the rest with probability f = r - floor(r).  The
pivotal method settles the rests: two documents trade word mass (size * probability)
at random until one of them is 0 or 1, so the words due to a source stay the same after
each trade; the document left over trades on in the next group.  Groups are formed in
Spark: documents are hashed to groups of bounded size, each leaves one open document,
and these are grouped again until one is left per source, which is drawn by its own
probability.  A source so misses its target by less than one document.

All random numbers are hashes of (seed, id, round), so reruns agree.

Defined results: a null text has size 0 and takes 0; a null source is a source of its
own, last; repeated rows are separate documents; sources without words get target 0;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.frames import NO_ID, cut_lineage, text_uid

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
GROUP = 4096
SEED = 20240607


def _did():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _uid():
    return F.xxhash64(text_uid("text"), F.col("source").cast("string"), F.col("source").isNull())


def _number(order):
    """Tells rows of equal id, text and source apart (they are interchangeable)."""
    return F.row_number().over(Window.partitionBy("did", "uid").orderBy(order)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(did, uid, source, size) for each row."""
    return docs.select(_did().alias("did"), "doc_id", _uid().alias("uid"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
                       .cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): weights by code point order, water filling under the cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # global order number without one task for all sources: order number in a range
    # partition plus the counts of the partitions before it (one row per partition)
    ordered = cut_lineage(per.repartitionByRange(F.col("source").asc_nulls_last())
                          .withColumn("part", F.spark_partition_id()))
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offset = F.lit(0)
    for p, n in before.items():
        offset = F.when(F.col("part") == p, F.lit(n)).otherwise(offset)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    w = F.lit(weights[-1])
    for k, x in enumerate(weights[:-1]):
        w = F.when(F.pmod(rank, F.lit(len(weights))) == k, F.lit(float(x))).otherwise(w)
    ordered = cut_lineage(ordered.select("source", "source_size", w.alias("weight")))
    # level L with sum(min(most * size, L * weight)) = total; L only grows as sources fill up
    words = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, None
    while words:
        full = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
        r = ordered.agg(F.count(F.when(full, 1)).alias("n"),
                        F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0.0)).alias("fixed"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, (words - r.fixed) / r.open
    return ordered.select("source", "source_size", F.least(most * F.col("source_size"),
                                                           level * F.col("weight")).alias("target"))


def _draw(*parts) -> float:
    h = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return (int.from_bytes(h, "big") >> 11) / float(1 << 53)


def settle(rows: list[tuple], level: int, last: bool, seed: int = SEED) -> list[tuple]:
    """Pivotal pass over (did, uid, size, prob) in order; all come back with prob 0 or 1,
    but for one open row unless this is the last level."""
    done, open_row = [], None
    for row in rows:
        if not 0.0 < row[3] < 1.0 or row[2] == 0:
            done.append(row[:3] + (float(round(row[3])),))
            continue
        if open_row is None:
            open_row = row
            continue
        a, b = open_row, row
        # mass that can go from b to a (up) or from a to b (down) until one is 0 or 1
        up = min(a[2] * (1.0 - a[3]), b[2] * b[3])
        down = min(a[2] * a[3], b[2] * (1.0 - b[3]))
        moved = up if _draw(seed, level, a[:2], b[:2]) * (up + down) < down else -down
        pair = []
        for r, m in ((a, moved), (b, -moved)):
            p = r[3] + m / r[2]
            pair.append(r[:3] + (0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p,))
        open_row = None
        for r in pair:
            if r[3] in (0.0, 1.0):
                done.append(r)
            else:
                open_row = r
    if open_row is not None:
        if last:
            done.append(open_row[:3] + (float(_draw(seed, "last", open_row[:2]) < open_row[3]),))
        else:
            done.append(open_row)
    return done


def _settle_group(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["did", "uid", "row"], kind="stable")
        keys = list(zip(pdf["did"].tolist(), zip(pdf["uid"].tolist(), pdf["row"].tolist(), strict=True),
                        pdf["size"].tolist(), pdf["prob"].tolist(), strict=True))
        out = settle(keys, level, last)
        src = pdf["src"].iloc[0]
        return pd.DataFrame({"src": src, "did": [r[0] for r in out], "uid": [r[1][0] for r in out],
                             "row": [r[1][1] for r in out], "size": [r[2] for r in out],
                             "prob": [r[3] for r in out]})
    return run


def round_copies(due: DataFrame, group: int = GROUP) -> DataFrame:
    """due: (src, did, uid, row, size, prob) -> the same rows with prob 0.0 or 1.0."""
    schema = "src long, did long, uid long, row long, size long, prob double"
    settled, open_rows, level = [], due, 0
    counts = due.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    while True:
        n = max(1, -(-int(most) // (group // 2)))
        last = n == 1
        # the number of groups of a source follows its own size; a hash spreads the documents
        own = counts.select("src", F.ceil(F.col("n") / (group // 2)).alias("groups"))
        dealt = open_rows.join(own, "src").withColumn(
            "g", F.pmod(F.xxhash64("did", "uid", "row", F.lit(level)), F.col("groups")))
        # dealt by both: the join's partitioning by src alone would put all groups of a source in one task
        out = cut_lineage(dealt.repartition("src", "g").groupBy("src", "g").applyInPandas(_settle_group(level, last), schema))
        whole = F.col("prob").isin(0.0, 1.0)
        settled.append(out.filter(whole))
        if last:
            break
        open_rows = out.filter(~whole)
        counts = open_rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        level += 1
    result = settled[0]
    for s in settled[1:]:
        result = result.unionByName(s)
    return result


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, did, uid, size, source_size, target, copies, taken) for each row of docs."""
    base = sizes(docs).withColumn("src", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    # repeated rows: a number among equal (did, uid) keeps them apart
    base = cut_lineage(base.withColumn("row", _number(F.lit(0))))
    targets = cut_lineage(source_targets(base, weights, most))
    rated = (base.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                         .otherwise(0.0))
             .withColumn("sure", F.floor(F.col("rate") + 1e-9))
             .withColumn("prob", F.when(F.col("sure") >= most, F.lit(0.0)).otherwise(
                 F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))))
    parts = round_copies(rated.filter("size > 0 and prob > 0").select("src", "did", "uid", "row", "size", "prob"))
    return (rated.join(parts.select("did", "uid", "row", F.col("prob").alias("extra")), ["did", "uid", "row"], "left")
            .withColumn("copies", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(
                F.col("sure") + F.coalesce("extra", F.lit(0.0)).cast("long")))
            .select("doc_id", "did", "uid", "row", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row that is taken, with the number of its ``copies``."""
    chosen = mix(docs).filter("copies > 0").select("did", "uid", "row", "copies")
    full = docs.select(F.struct("*").alias("doc"), _did().alias("did"), _uid().alias("uid"))
    full = full.withColumn("row", _number(F.lit(0)))     # same exchange as the join
    return full.join(chosen, ["did", "uid", "row"]).select("doc.*", "copies")
