"""Join building blocks.

Physical strategy is left to Catalyst + AQE: dimension sides that are small at
run time become broadcast joins through AQE's measured-size rule
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), large sides shuffle on the
key with AQE skew splitting.  An explicit ``broadcast`` hint is only placed on
the fixed code list, whose size is bounded by construction, and by
``broadcast_if_small`` after the side has been measured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(on):
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, dict):
        return list(on.items())
    return [(k, k) if isinstance(k, str) else k for k in on]


def _cond(left: DataFrame, right: DataFrame, on) -> Column:
    return reduce(lambda a, b: a & b, [left[lk] == right[rk] for lk, rk in _pairs(on)])


def _broadcast_limit(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    v = conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or \
        conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    return parse_bytes(v)


def parse_bytes(v) -> int:
    """Spark byte-size text ('10485760b', '10MB', '10m', '1g', '-1') -> bytes."""
    v = str(v).strip().lower()
    for unit, mult in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("tb", 1 << 40),
                       ("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30), ("t", 1 << 40), ("b", 1)):
        if v.endswith(unit):
            return int(float(v[: -len(unit)]) * mult)
    return int(v)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it is measured to fit.

    For a side that is joined many times (the edge table of an iterative walk):
    one aggregate job measures its rows and string bytes; when the estimate is
    within ``max_bytes`` (default: the session's broadcast threshold) the hint
    is placed, otherwise the side is returned unchanged and joins shuffle.
    ``df`` should be materialised (checkpointed), so the measurement does not
    recompute it.
    """
    limit = _broadcast_limit(df) if max_bytes is None else max_bytes
    if limit <= 0:
        return df, False
    width = [F.coalesce(F.length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() == "string"
             else F.lit(8) for f in df.schema.fields]
    row = df.select(reduce(lambda a, b: a + b, width).alias("__w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w")).first()
    # per row: the values plus an 8-byte pointer per column and a 16-byte row header
    est = (row["w"] or 0) + row["n"] * (16 + 8 * len(df.columns))
    return (F.broadcast(df), True) if est <= limit else (df, False)


def bridge_join(bridge: DataFrame, entity: DataFrame, on, how: str = "inner") -> DataFrame:
    """Bridge rows joined to the entity they point at (fan-out intended)."""
    return bridge.join(entity, _cond(bridge, entity, on), how)


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Left lookup on one or more key columns (composite keys allowed)."""
    return df.join(dim, _cond(df, dim, on), how)


def label_codes(df: DataFrame, codes: DataFrame, mapping: dict[str, str],
                suffix: str = "_desc", code_col: str = "code", group_col: str = "code_group",
                desc_col: str = "description") -> DataFrame:
    """Label each code column from a (group, code, description) list.

    ``mapping`` maps a column of ``df`` to its code group.  Each lookup is a left
    join against the code list filtered to one group (constant in ON); Spark
    broadcasts the list where it measures it below its threshold.  Result column ``<col><suffix>`` holds the
    description or the raw code (X5).
    """
    out = df
    for col, group in mapping.items():
        d = (codes.where(F.col(group_col) == group)
                  .select(F.col(code_col).alias(f"__code_{col}"),
                          F.col(desc_col).alias(f"__desc_{col}")))
        out = (out.join(d, out[col] == d[f"__code_{col}"], "left")
                  .withColumn(f"{col}{suffix}", F.coalesce(F.col(f"__desc_{col}"), F.col(col)))
                  .drop(f"__code_{col}", f"__desc_{col}"))
    return out


def chain_left(dfs: list[DataFrame], ons: list) -> DataFrame:
    """``dfs[0] LEFT JOIN dfs[1] ... LEFT JOIN dfs[n]``; ``ons[i]`` joins step i+1."""
    out = dfs[0]
    for nxt, on in zip(dfs[1:], ons):
        out = out.join(nxt, _cond(out, nxt, on), "left")
    return out


def left_where(left: DataFrame, right: DataFrame, on, right_pred: Column) -> DataFrame:
    """Left join with an extra right-side predicate in ON (applied before the join)."""
    r = right.where(right_pred)
    return left.join(r, _cond(left, r, on), "left")


def inner_where(left: DataFrame, right: DataFrame, on, right_pred: Column) -> DataFrame:
    """Inner join with an extra right-side predicate."""
    r = right.where(right_pred)
    return left.join(r, _cond(left, r, on), "inner")


def lookup_roles(edges: DataFrame, dim: DataFrame, key: str, roles: dict[str, tuple[str, dict]]) -> DataFrame:
    """Join the same dimension once per role.

    ``roles`` = {edge_column: (prefix, {dim_column: out_name})}.
    """
    out = edges
    for edge_col, (prefix, cols) in roles.items():
        d = dim.select(F.col(key).alias(f"__{prefix}_key"),
                       *[F.col(c).alias(o) for c, o in cols.items()])
        out = out.join(d, out[edge_col] == d[f"__{prefix}_key"], "left").drop(f"__{prefix}_key")
    return out


def missing(required: DataFrame, present: DataFrame, on) -> DataFrame:
    """Rows of ``required`` with no match in ``present``."""
    return required.join(present, _cond(required, present, on), "left_anti")


def without_match(left: DataFrame, right: DataFrame, on, right_pred: Column | None = None) -> DataFrame:
    """NOT EXISTS (correlated subquery) as a left-anti join."""
    r = right if right_pred is None else right.where(right_pred)
    return left.join(r, _cond(left, r, on), "left_anti")


def star_left(base: DataFrame, branches: list[DataFrame], key: str, branch_key: str | None = None) -> DataFrame:
    """Base LEFT JOIN n branches that are already aggregated to one row per key.

    All branches are keyed the same way, so the sort-merge joins share one
    hash partitioning of the key and no branch multiplies another's rows.
    """
    out = base
    bk = branch_key or key
    for b in branches:
        b2 = b.withColumnRenamed(bk, "__k")
        out = out.join(b2, out[key] == b2["__k"], "left").drop("__k")
    return out


def group_by_either_key(df: DataFrame, k1: str, k2: str, out: str = "key") -> Column:
    """Grouping expression ``coalesce(direct key, key via two hops)``."""
    return F.coalesce(F.col(k1), F.col(k2)).alias(out)


def inherit_attr(edges: DataFrame, attrs: DataFrame, own_key: str, other_key: str,
                 attr_key: str, attr: str, out: str = "address") -> DataFrame:
    """Own attribute, else the neighbour's, plus an ``<out>_inherited`` flag.

    ``attrs`` is first reduced to ``min(attr)`` per key (one row per key), so the
    two left joins cannot fan out.
    """
    a = attrs.groupBy(attr_key).agg(F.min(attr).alias("__v"))
    own = a.select(F.col(attr_key).alias("__own_k"), F.col("__v").alias("__own_v"))
    oth = a.select(F.col(attr_key).alias("__oth_k"), F.col("__v").alias("__oth_v"))
    j = (edges.join(own, edges[own_key] == own["__own_k"], "left")
              .join(oth, edges[other_key] == oth["__oth_k"], "left"))
    return (j.withColumn(out, F.coalesce("__own_v", "__oth_v"))
             .withColumn(f"{out}_inherited", F.col("__own_v").isNull() & F.col("__oth_v").isNotNull())
             .drop("__own_k", "__own_v", "__oth_k", "__oth_v"))


def settled(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``cols`` as the output of a one-row generator: rows and values stay as they are.

    A join on a computed key lets Spark test the key for NULL as early as it can, below projections,
    exchanges and aggregates, where the whole expression of the key is written out and run a second
    time, without the sharing of equal parts that a projection has.  A test on a generator's output
    stays above the generator, so it reads the computed value."""
    if not cols:
        return df
    return df.select("*", F.stack(F.lit(1), *cols).alias(*[f"__{c}" for c in cols])).select(
        *[F.col(f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
