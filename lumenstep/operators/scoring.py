"""Scoring as a projection: each feature becomes a balanced CASE tree or a map literal.

Features with more than MAX_LITERALS categories are looked up by a join instead, so that
the generated code stays small.  Rows keep their partitioning; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstep.operators.stats import category, number
from lumenstep.operators.tree import Node

MAX_LITERALS = 2_000
MAX_BROADCAST = 500_000


def step(value: Column, leaves: list[Node], out: Callable[[Node], float]) -> Column:
    """First leaf whose upper bound is at least the value, by bisection."""
    if len(leaves) == 1:
        return F.lit(out(leaves[0]))
    mid = len(leaves) // 2
    return F.when(value <= F.lit(leaves[mid - 1].upper), step(value, leaves[:mid], out)).otherwise(step(value, leaves[mid:], out))


def lookup(df: DataFrame, name: str, nodes: list[Node], out: Callable[[Node], float], unseen: str = "null") -> Column:
    """Value of `out` at the node of each row; unseen categories go to the null node (or count 0: unseen='zero')."""
    null, own = nodes[-1], nodes[:-1]
    if nodes[0].kind == "numeric":
        v = number(name)
        return F.when(v.isNull(), F.lit(out(null))).otherwise(step(v, own, out)) if own else F.lit(out(null))
    v = category(df, name)
    if not own:
        return F.lit(out(null))
    table = F.create_map(*[x for n in own for x in (F.lit(n.category), F.lit(out(n)))])
    other = F.lit(out(null)) if unseen == "null" else F.when(v.isNull(), F.lit(out(null))).otherwise(F.lit(type(out(null))(0)))
    return F.coalesce(F.when(v.isNotNull(), F.try_element_at(table, v)), other)


def with_contributions(df: DataFrame, profile: dict[str, list[Node]], out: Callable[[Node], float] = lambda n: n.score, prefix: str = "contribution_", unseen: str = "null") -> DataFrame:
    """df plus one column for each feature."""
    missing = [c for c in profile if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    plain = {f"{prefix}{k}": lookup(df, k, v, out, unseen) for k, v in profile.items() if len(v) <= MAX_LITERALS}
    spark, wide = df.sparkSession, {k: v for k, v in profile.items() if len(v) > MAX_LITERALS}
    df = df.withColumns(plain)
    for k, v in wide.items():
        table = spark.createDataFrame([(n.category, out(n)) for n in v[:-1]], f"_category string, `{prefix}{k}` double")
        table = F.broadcast(table) if len(v) <= MAX_BROADCAST else table
        null = out(v[-1])
        df = df.join(table, category(df, k) == F.col("_category"), "left").drop("_category").withColumn(f"{prefix}{k}", F.coalesce(F.col(f"`{prefix}{k}`"), F.lit(null)))
    return df


def total(base: float, names: list[str], prefix: str = "contribution_") -> Column:
    """Base plus contributions, always added in the same order."""
    out = F.lit(base)
    for k in names:
        out = out + F.col(f"`{prefix}{k}`")
    return out
