"""Exclusion rules between categories, frame differences, levers and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.operators.tree import Node


def binned(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Numeric columns as equal-width interval labels over their range."""
    r = df.agg(*[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = {}
    for c in columns:
        lo, width = r[f"lo_{c}"], (r[f"hi_{c}"] - r[f"lo_{c}"]) / k if r[f"lo_{c}"] is not None else 0
        i = F.least(F.greatest(F.ceil((F.col(c) - F.lit(lo)) / F.lit(width)) - 1, F.lit(0)), F.lit(k - 1)) if width else F.lit(0)
        out[c] = F.when(F.col(c).isNotNull(), F.concat(F.lit("bin_"), i.cast("string")))
    return df.withColumns(out)


def _seen_together(df: DataFrame, columns: dict[str, Column], numbers: list[dict[str, int]], size: int) -> DataFrame:
    """(i, word, bits): for each numbered value, in words of 64 bits, the values that some row holds with it."""
    names = [pa.array(list(x), pa.string()) for x in numbers]
    places = [np.array([*x.values(), -1], np.int64) for x in numbers]
    words = (size + 63) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((size, words * 64), bool)
        for b in batches:
            ids = [at[pc.fill_null(pc.index_in(b.column(k), value_set=names[k]), len(at) - 1).to_numpy(zero_copy_only=False)] for k, at in enumerate(places)]
            for x in range(len(ids)):
                for y in range(x):
                    both = (ids[x] >= 0) & (ids[y] >= 0)
                    seen[ids[x][both], ids[y][both]] = True
        packed = np.packbits(seen, axis=1, bitorder="little").view("<i8")
        i, word = np.nonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(word), pa.array(packed[i, word])], ["i", "word", "bits"])

    return df.select(*columns.values()).mapInArrow(run, "i long, word long, bits long").groupBy("i", "word").agg(F.bit_or("bits").alias("bits"))


def exclusion_rules(df: DataFrame, columns: list[str], min_support: int = 10, max_values: int = 20_000) -> DataFrame:
    """feature, value, rule_feature, rule_value: pairs with support each that no row holds together.

    Values with support are numbered, feature by feature; over max_values of them are refused.
    Tasks mark the pairs that rows hold in bit sets (50 MB at most), which are combined by
    bit_or; the bits of other features that stay unset are the rules.
    """
    cols = {c: F.col(f"`{c}`").cast("string") for c in columns}
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), v.alias("value")) for c, v in cols.items()])).alias("x")).select("x.*").where("value is not null") if cols else df.select(F.lit("").alias("feature"), F.lit("").alias("value")).limit(0)
    held = seen.groupBy("feature", "value").count().where(F.col("count") >= min_support).select("feature", "value").limit(max_values + 1).collect()
    if len(held) > max_values:
        raise ValueError(f"over {max_values} values with support; raise min_support")
    held = sorted(((columns.index(r.feature), r.value) for r in held))
    table = df.sparkSession.createDataFrame([(i, columns[k], v) for i, (k, v) in enumerate(held)], "n long, feature string, value string")
    numbers: list[dict[str, int]] = [{} for _ in columns]
    for i, (k, v) in enumerate(held):
        numbers[k][v] = i
    size, words = len(held), (len(held) + 63) // 64
    # pairs are marked below the diagonal: values of a feature against those of features before it
    first = {c: min(x.values(), default=0) for c, x in zip(columns, numbers)}
    start = F.coalesce(*[F.when(F.col("feature") == c, n) for c, n in first.items()], F.lit(0)) if first else F.lit(0)
    cells = table.select(F.col("n").alias("i"), start.cast("long").alias("first")).withColumn("word", F.explode(F.expr(f"sequence(0L, {max(0, words - 1)}L)")))
    cells = cells.where(F.col("word") * 64 < F.col("first")).join(_seen_together(df, cols, numbers, size), ["i", "word"], "left") if size else cells.withColumn("bits", F.lit(0))
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    free = cells.select("i", "first", "word", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"), bit.alias("bit"))
    free = free.where((F.col("word") * 64 + F.col("bit") < F.col("first")) & (F.expr("shiftrightunsigned(bits, bit) & 1L") == 0)).select("i", (F.col("word") * 64 + F.col("bit")).alias("j"))
    both = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    pairs = free.select(both.alias("x")).select("x.*")
    # at most max_values rows
    one, other = F.broadcast(table), F.broadcast(table.select("n", F.col("feature").alias("rule_feature"), F.col("value").alias("rule_value")))
    return pairs.join(one, F.col("a") == F.col("n")).drop("n").join(other, F.col("b") == F.col("n")).select("feature", "value", "rule_feature", "rule_value")


def frame_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """column, change (dropped, added, updated), rows_changed; rows are matched by the key."""
    a, b = before.columns, after.columns
    both = [c for c in a if c in b and c != key]
    joined = before.select(key, *[F.col(c).alias(f"_a_{c}") for c in both]).join(after.select(key, *[F.col(c).alias(f"_b_{c}") for c in both]), key)
    counts = joined.agg(F.lit(0).alias("_"), *[F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in both]).first()
    rows = [(c, "dropped", None) for c in a if c not in b] + [(c, "added", None) for c in b if c not in a] + [(c, "updated", counts[c]) for c in both if counts[c]]
    return before.sparkSession.createDataFrame(rows, "column string, change string, rows_changed long")


def best_scores(profile: dict[str, list[Node]], controllable: list[str], largest: bool = False) -> dict[str, float]:
    """Best score each controllable feature can take, its null node aside."""
    return {k: (max if largest else min)([n.score for n in profile[k] if not n.is_null] or [0.0]) for k in controllable}


def lever_effects(df: DataFrame, best: dict[str, float], prefix: str = "contribution_") -> DataFrame:
    """df plus effect_<feature> (contribution less the best), best_lever (first of the largest) and best_effect."""
    df = df.withColumns({f"effect_{k}": F.col(f"{prefix}{k}") - F.lit(v) for k, v in best.items()})
    names = list(best)
    top = F.greatest(*[F.col(f"effect_{k}") for k in names]) if len(names) > 1 else F.col(f"effect_{names[0]}")
    lever = F.coalesce(*[F.when(F.col(f"effect_{k}") == top, F.lit(k)) for k in names])
    return df.withColumn("best_effect", top).withColumn("best_lever", lever)


def expected_value(df: DataFrame, actions: dict[str, tuple[str, float]], value: Column) -> DataFrame:
    """df plus action, cost, expected_value (effect times value, less cost) and roi."""
    pick = lambda i: F.coalesce(*[F.when(F.col("best_lever") == k, F.lit(v[i])) for k, v in actions.items()])
    df = df.withColumn("action", pick(0)).withColumn("cost", pick(1)).withColumn("expected_value", F.col("best_effect") * value - F.col("cost"))
    return df.withColumn("roi", F.try_divide("expected_value", "cost"))


def budget_tiers(df: DataFrame, budgets: list[float], key: str, cells: int = 4096) -> DataFrame:
    """budget, n, spent, value, roi, marginal_roi: the best rows by roi whose costs fit each budget.

    Costs are summed along ranges of roi first and within a range after, so the running
    total over all rows needs no single task.
    """
    r = df.agg(F.min("roi").alias("lo"), F.max("roi").alias("hi")).first()
    width = (r.hi - r.lo) / cells if r.lo is not None and r.hi > r.lo else 1.0
    rows = df.where("roi is not null").withColumn("_cell", F.floor((F.lit(r.hi or 0.0) - F.col("roi")) / F.lit(width)))
    ahead = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = rows.groupBy("_cell").agg(F.sum("cost").alias("_c")).select("_cell", F.coalesce(F.sum("_c").over(ahead), F.lit(0.0)).alias("_ahead"))
    w = Window.partitionBy("_cell").orderBy(F.desc("roi"), key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(cell), "_cell").withColumn("_upto", F.col("_ahead") + F.sum("cost").over(w))
    tier = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    per = rows.withColumn("budget", tier).where(F.col("_upto") <= F.col("budget")).groupBy("budget").agg(F.count("*").alias("n"), F.sum("cost").alias("spent"), F.sum("expected_value").alias("value"))
    order = Window.orderBy("budget")
    gain, more = (F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0)) for c in ("value", "spent"))
    return per.withColumn("roi", F.try_divide("value", "spent")).withColumn("marginal_roi", F.try_divide(gain, more))


def waterfall(contributions: DataFrame, key: str, features: list[str], base: float, prefix: str = "contribution_") -> DataFrame:
    """key, feature, contribution, running: non-zero contributions by size, summed from the base."""
    long = contributions.unpivot([key], [f"{prefix}{k}" for k in features], "feature", "contribution").where("contribution <> 0")
    w = Window.partitionBy(key).orderBy(F.abs("contribution"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return long.select(key, F.expr(f"substring(feature, {len(prefix) + 1})").alias("feature"), "contribution", (F.sum("contribution").over(w) + F.lit(base)).alias("running"))
