"""Operator 5, quality rules: learned decision lists as Spark conditional expressions.

Statistics of each text are computed with DataFrame functions.  From labelled rows a
decision list is learned by sequential covering: a rule grows by adding the threshold
condition that gains most (FOIL gain) on the growing half, is pruned by dropping final
conditions while its precision on the pruning part does not fall, and is kept when it is
precise enough there; the rows it covers leave, and the next rule is learned.  Every
count is one Spark aggregation over binned statistics, so learning covers all labelled
rows and collects only counters.  The list is emitted as one ordered CASE expression.

Defined results: a null text has no words (all statistics 0, base_failed); repeated rows
are judged each for itself; a document with several labels trains with each; with no
labels the list is empty and the verdict is "kept" wherever the base does not fail;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.frames import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# ratios the conditions are made of; each is interpretable and free of text length
FEATURES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
# thresholds are these percentiles of the labelled rows, denser at both ends
PERCENTILES = (1, 2, 3, 4, 6, 8, 10, 12, 15, 20, 30, 40, 50, 60, 70, 80, 85, 88, 90, 92, 94, 96, 97, 98, 99)
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.85
MIN_COVER = 5           # rows of the growing part that a condition must cover
MIN_PRUNE = 2           # and of the pruning part


def _length_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text (long)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", t.alias("t"))
    words = base.select("*", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
                        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    n = F.size("w")
    hashed = words.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # one hash per window of WINDOW words
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    gram = hashed.select("*", windows.alias("g"))
    gram = gram.select("*", (F.size("g") > F.size(F.array_distinct("g"))).alias("repeats"))
    # starts of windows whose hash occurs twice: neighbours in hash order (only where there are any)
    ordered = gram.select("*", F.when(F.col("repeats"), F.array_sort(F.transform(
        "g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    twin = F.expr(
        "array_sort(transform(filter(transform(s, (e, k) -> struct(e.i as i, "
        "(k > 0 and get(s, k - 1).x = e.x) or (get(s, k + 1).x <=> e.x) as twin)), e -> e.twin), e -> e.i))")
    starts = ordered.select("*", F.when(F.col("repeats"), twin).alias("p"))
    covered = F.expr(f"aggregate(transform(p, (e, k) -> least({WINDOW}L, coalesce(get(p, k + 1) - e, {WINDOW}L))), "
                     "0L, (a, e) -> a + e)")
    long = lambda c: c.cast("long")
    return starts.select(
        "doc_id", long(n).alias("n_words"),
        long(F.length(F.translate("t", BLANKS, ""))).alias("word_chars"),
        long(_length_of(F.col("t"), SYMBOLS)).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(F.coalesce(F.when(F.col("repeats"), covered), F.lit(0))).alias("n_repeat_words"),
        long(F.size("l")).alias("n_lines"),
        long(_length_of(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        long(_length_of(F.col("t"), "0123456789")).alias("n_digits"),
        long(_length_of(F.col("t"), "!?;:~^=+_{}[]()\\/@\"'")).alias("n_marks"),
        long(F.size(F.array_distinct("h"))).alias("n_distinct"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c >= self.threshold if self.above else c < self.threshold


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the label."""
    conditions: tuple[Condition, ...]
    label: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:.4g}"
                            for c in self.conditions) + f" -> {self.label}"


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    at = [p / 100 for p in PERCENTILES]
    r = rows.agg(*[F.percentile_approx(F.expr(e), at, 10_000).alias(f) for f, e in FEATURES.items()]).first()
    return {f: sorted(set(r[f] or [])) for f in FEATURES}


def _reached(value: Column, cuts: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]).cast("array<double>"), lambda t: t <= value))


def learn(stats: DataFrame, labels: DataFrame, target: int = 0) -> list[Rule]:
    """Ordered rules for label ``target`` from stats (doc_id, counts) and labels (doc_id, label)."""
    rows = stats.join(labels.filter(F.col("label").isNotNull()), "doc_id")
    rows = cut_lineage(rows.withColumn("prune", F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0)
                       .withColumn("hit", F.col("label") == target))
    cuts = _thresholds(rows)
    # bin k of a feature: its value reaches k of the thresholds
    binned = cut_lineage(rows.select("*", F.array(*[
        F.struct(F.lit(f).alias("f"), _reached(F.expr(e), cuts[f]).alias("b"))
        for f, e in FEATURES.items()]).alias("bins")))
    rules: list[Rule] = []

    def gains(df: DataFrame) -> tuple[int, int, dict]:
        """(hits, rows, {condition: (hits, rows)}) of a part, from one aggregation over bins."""
        got = (df.select("hit", F.explode("bins").alias("x")).groupBy("x.f", "x.b")
               .agg(F.count_if("hit").alias("h"), F.count(F.lit(1)).alias("n")).collect())
        out, hits, n = {}, 0, 0
        for f in FEATURES:
            per = {r.b: (r.h, r.n) for r in got if r.f == f}
            hits, n = sum(h for h, _ in per.values()), sum(m for _, m in per.values())
            for k, t in enumerate(cuts[f], start=1):
                up = [v for b, v in per.items() if b >= k]
                h, m = sum(v[0] for v in up), sum(v[1] for v in up)
                out[Condition(f, True, t)], out[Condition(f, False, t)] = (h, m), (hits - h, n - m)
        return hits, n, out

    left = binned
    while len(rules) < MAX_RULES:
        chosen: list[Condition] = []
        here = left.filter(~F.col("prune"))
        while len(chosen) < MAX_CONDITIONS:
            hits, n, table = gains(here)
            if not hits or hits == n:
                break
            best, gain = None, 0.0
            for cond, (h, m) in table.items():
                if h >= MIN_COVER and m < n:
                    g = h * (math.log2(h / m) - math.log2(hits / n))
                    if g > gain + 1e-9:
                        best, gain = cond, g
            if best is None:
                break
            chosen.append(best)
            here = here.filter(best.column())
        if not chosen:
            break
        # prune: the beginning of the conjunction that is most precise on the pruning part
        parts = [Rule(tuple(chosen[:k]), target) for k in range(1, len(chosen) + 1)]
        r = left.filter("prune").agg(*[x for k, p in enumerate(parts) for x in (
            F.count_if(p.column() & F.col("hit")).alias(f"h{k}"), F.count_if(p.column()).alias(f"n{k}"))]).first()
        scores = [((r[f"h{k}"] + 1) / (r[f"n{k}"] + 2), r[f"h{k}"]) for k in range(len(parts))]
        k = max(range(len(parts)), key=lambda i: (scores[i][0], -i))
        if scores[k][1] < MIN_PRUNE or scores[k][0] < MIN_PRECISION:
            break
        rules.append(parts[k])
        left = left.filter(~parts[k].column())
    return rules


def decision(rules: list[Rule], default: int = 1) -> Column:
    """The list as one ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(r.label)) if out is None else out.when(r.column(), F.lit(r.label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = cut_lineage(text_stats(docs))
    rules = learn(stats, labels.select("doc_id", F.col("quality").cast("int").alias("label")))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"),
                        (~base_failed() & (decision(rules) == 1)).alias("kept"))
