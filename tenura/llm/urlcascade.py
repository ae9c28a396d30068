"""Operator 10, URL filters as a Bloom filter cascade (DataFrame functions only).

A rule is (host, path prefix, verdict).  The keys of a url are its host and every parent
domain, each with the leading part of its path of every length that rules use; a rule
fits a url exactly when its key is among them.  Membership of a key in the allow or the
block list is answered by a cascade instead of a join: level 0 is a Bloom filter of the
listed keys; level 1 holds the keys of the corpus that pass level 0 without being listed;
level 2 the listed keys that pass level 1; and so on until a level lets nothing wrong
through.  Over the corpus's complete key universe the cascade answers exactly.

The bits of a level are one binary literal of the scan's expression, so a url is judged
inside one scan.  Level 0 grows with the lists and level 1 with the false
positives of level 0; ``MAX_BITS`` bounds a level (checked, raises beyond it).

Defined results: a null url or one without ``://`` has host and path '' and the default
verdict; repeated rows are judged each for itself; empty lists or an empty table give
the default verdict everywhere; other columns are not read.
"""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.frames import cut_lineage

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
BITS_PER_KEY = 6
HASHES = 3
MAX_BITS = 1 << 26       # 8 MB a level
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, longest first (a longer host before a longer path)."""
    labels = F.split(host, r"\.")
    domains = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)])
    paths = F.filter(paths, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.struct(
        (-F.length(d) - F.length(p)).alias("order"), (-F.length(d)).alias("order2"), F.concat(d, p).alias("key"),
        F.concat(d, F.lit("\n"), p).alias("full")))))
    return F.array_sort(keys)


class Level:
    """One Bloom filter: its bits (built by aggregation) and its number of bits."""

    def __init__(self, keys: DataFrame, n: int, salt: int, bits_per_key: int) -> None:
        bits = 64
        while bits < n * bits_per_key:
            bits *= 2
        if bits > MAX_BITS:
            raise ValueError(f"a level of {n} keys needs {bits} bits, more than {MAX_BITS}")
        self.bits, self.salt = bits, salt
        at = keys.select(F.explode(F.array(*self._places(F.col("full")))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
        table = bytearray(bits // 8)
        for r in words.collect():
            struct.pack_into("<q", table, 8 * r.w, r.word)
        self.table = bytes(table)

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(f"{self.salt}/{k}"), key), F.lit(self.bits)).cast("long")
                for k in range(HASHES)]

    def passes(self, key: Column) -> Column:
        table = F.lit(self.table)

        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(table, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10)
            return F.getbit(byte.cast("int"), (p % 8).cast("int")) == 1
        return reduce(Column.__and__, [bit(p) for p in self._places(key)])


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, salt: int, bits_per_key: int = BITS_PER_KEY) -> Cascade:
        """listed, universe: (full) distinct keys."""
        n = listed.count()
        if not n:
            return cls([])
        levels = [Level(listed, n, salt, bits_per_key)]
        # flag by aggregation: which universe keys are listed
        both = (universe.select("full", F.lit(False).alias("in")).unionByName(listed.select("full", F.lit(True).alias("in")))
                .groupBy("full").agg(F.max("in").alias("in")))
        live = cut_lineage(both.filter(levels[0].passes(F.col("full"))))
        wrong = ~F.col("in")          # what the newest level lets through wrongly
        while len(levels) < MAX_LEVELS:
            bad = live.filter(wrong)
            n = bad.count()
            if not n:
                return cls(levels)
            level = Level(bad, n, salt + 1000 * len(levels), bits_per_key)
            levels.append(level)
            live = cut_lineage(live.filter(wrong | level.passes(F.col("full"))))
            wrong = ~wrong
        raise RuntimeError("cascade does not end")

    def contains(self, key: Column) -> Column:
        """Level 0 alone means listed; each further level that passes turns the answer round."""
        inside = F.lit(False)
        for level in reversed(self.levels):
            inside = F.when(level.passes(key), ~inside).otherwise(F.lit(False))
        return inside


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url",
          bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """All columns of pages as struct ``row`` with host, path, rule, verdict."""
    host, path = host_and_path(F.col(url).cast("string"))
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    base = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    keyed = base.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys.full").alias("full")).distinct()
    cascades = {}
    for n, verdict in enumerate(("allow", "block")):
        listed = spark.createDataFrame([(f"{h}\n{p}",) for h, p, v in rules if v == verdict], "full string").distinct()
        cascades[verdict] = Cascade.build(listed, universe, n + 1, bits_per_key)
    found = F.filter(F.transform("keys", lambda k: F.struct(
        k["key"].alias("key"),
        F.when(cascades["allow"].contains(k["full"]), "allow").when(cascades["block"].contains(k["full"]), "block")
        .alias("verdict"))), lambda k: k["verdict"].isNotNull())
    return (keyed.select("row", "host", "path", F.get(found, F.lit(0)).alias("hit"))
            .select("row", "host", "path", F.col("hit.key").alias("rule"),
                    F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))


def url_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(spark, pages.select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")
