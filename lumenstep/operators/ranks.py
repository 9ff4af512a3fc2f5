"""Order statistics of whole columns in bounded memory: exact quantiles, average ranks, Kendall's tau.

Quantiles come by radix selection: numbers become 64-bit keys that sort alike, each pass
counts the next BITS bits of the keys under the prefixes that hold a wanted rank, and the
counts tell where each rank goes on.  All columns and ranks share a pass; what is collected
is at most 2^BITS counts for each prefix, whatever the number of rows.

Ranks come from counts by value, dealt out by ranges of the value: totals of the ranges are
summed on the driver (one number each), places within a range in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.operators.written import settled

#: Bits of a pass, and the number of values under a prefix from which on their whole keys are counted at once.
BITS, FEW = 12, 4096


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys that sort as the doubles do; 0.0 and -0.0 are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)


def of_keys(keys: np.ndarray) -> np.ndarray:
    bits = keys.view(np.int64)
    return np.where(bits < 0, bits & np.int64((1 << 63) - 1), ~bits).view(np.float64)


def _pass(columns: DataFrame, wanted: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """For each (column, prefix, bits of the prefix, bits to look at): (prefix of these bits, count), rising."""
    width = len(columns.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in wanted]
        for b in batches:
            keys = [sort_keys(b.column(i).drop_null().to_numpy(zero_copy_only=False)) for i in range(width)]
            for k, (c, prefix, bits, upto) in enumerate(wanted):
                own = keys[c] if bits == 0 else keys[c][keys[c] >> np.uint64(64 - bits) == np.uint64(prefix)]
                found, count = np.unique(own >> np.uint64(64 - upto), return_counts=True)
                both, back = np.unique(np.concatenate([tables[k][0], found]), return_inverse=True)
                tables[k] = both, np.bincount(back, np.concatenate([tables[k][1], count]), len(both)).astype(np.int64)
        for k, (found, count) in enumerate(tables):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k)), pa.array(found.view(np.int64)), pa.array(count)], ["k", "prefix", "n"])

    rows = columns.mapInArrow(run, "k long, prefix long, n long").groupBy("k", "prefix").agg(F.sum("n").alias("n")).toPandas()
    out: dict = {w[:3]: [] for w in wanted}
    for k, part in rows.groupby("k"):
        keys = part["prefix"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out[wanted[k][:3]] = list(zip(keys[order].tolist(), part["n"].to_numpy(np.int64)[order].tolist()))
    return out


def values_at(df: DataFrame, columns: dict[str, Column], ranks) -> dict[str, tuple[int, dict[int, float]]]:
    """By name: how many numbers (neither null nor NaN) a column has, and its values at some places from 0.

    ranks(n) gives the places wanted among n.  One pass counts, up to six locate.
    """
    names = list(columns)
    if not names:
        return {}
    plain = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_{i}") for i, c in enumerate(columns.values())])
    first = _pass(plain, [(i, 0, 0, BITS) for i in range(len(names))])
    sizes = [sum(n for _, n in first[i, 0, 0]) for i in range(len(names))]
    # (column, place): prefix, its bits, values under it, place among them
    todo, found = {}, {i: {} for i in range(len(names))}

    def descend(i: int, place: int, at: int, bits: int, table: list[tuple[int, int]]) -> None:
        for prefix, n in table:
            if at < n:
                if bits == 64:
                    found[i][place] = float(of_keys(np.array([prefix], np.uint64))[0])
                else:
                    todo[i, place] = (prefix, bits, n, at)
                return
            at -= n

    for i, size in enumerate(sizes):
        for place in set(ranks(size)) if size else ():
            descend(i, place, place, BITS, first[i, 0, 0])
    while todo:
        now, todo = todo, {}
        upto = {(i, prefix, bits): 64 if n <= FEW else min(64, bits + BITS) for (i, _), (prefix, bits, n, _) in now.items()}
        tables = _pass(plain, [(*w, b) for w, b in upto.items()])
        for (i, place), (prefix, bits, _, at) in now.items():
            descend(i, place, at, upto[i, prefix, bits], tables[i, prefix, bits])
    return {name: (sizes[i], found[i]) for i, name in enumerate(names)}


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles by name, between neighbours in proportion; None for columns without numbers."""
    spots = lambda n: [(n - 1) * s for s in shares]
    located = values_at(df, columns, lambda n: [p for x in spots(n) for p in (int(x), min(n - 1, int(x) + 1))])
    out = {}
    for name, (n, at) in located.items():
        between = lambda x: at[int(x)] if x == int(x) or at[int(x)] == at[int(x) + 1] else at[int(x)] + (at[int(x) + 1] - at[int(x)]) * (x - int(x))
        out[name] = [between(x) for x in spots(n)] if n else [None] * len(shares)
    return out


def sums_before(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """rows plus `out`: the sum of `value` over all rows that come before in the order; ties come in any order."""
    part = "_range_part"
    dealt = settled(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))
    totals = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.sum(value)).collect())  # one row for each range
    offsets, so_far = [], 0
    for p, total in totals:
        offsets.append((p, so_far))
        so_far += total
    kind = dealt.agg(F.sum(value).alias("x")).schema[0].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(offsets, f"_range_of int, _range_offset {kind}")
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(table), F.col(part) == F.col("_range_of"))
    return placed.withColumn(out, F.col("_range_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop(part, "_range_of", "_range_offset")


def ranked(df: DataFrame, name: str) -> DataFrame:
    """df with rank_<name>: the average rank of the column, for any type that can be ordered; nulls have none.

    Only values and counts are ordered.  A column rank_<name> is replaced, others may have any names.
    """
    kept = [c for c in df.columns if c != f"rank_{name}"]
    inner = df.select(*[F.col(f"`{c}`") for c in kept]).toDF(*[f"_c{i}" for i in range(len(kept))])
    own = f"_c{kept.index(name)}"
    counts = inner.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("_value")).agg(F.count("*").alias("_count"))
    places = sums_before(counts, ["_value"], "_count", "_before").select("_value", (F.col("_before") + (F.col("_count") + 1) / 2).alias("_rank"))
    return inner.join(places, F.col(own) == F.col("_value"), "left").drop("_value").toDF(*kept, f"rank_{name}")


def above(values: np.ndarray, weight: np.ndarray) -> float:
    """Sum of weight_i * weight_j over i < j with values_i < values_j: bit by bit, zeros before ones under equal higher bits."""
    total = 0.0
    v = np.unique(values, return_inverse=True)[1].astype(np.int64)
    w = weight.astype(np.float64)
    for bit in range(max(1, int(v.max(initial=0)).bit_length()) - 1, -1, -1):
        order = np.argsort(v >> (bit + 1), kind="stable")
        v, w = v[order], w[order]
        zero = (v >> bit) & 1 == 0
        zeros = np.concatenate([[0.0], np.cumsum(np.where(zero, w, 0.0))])[:-1]
        group = v >> (bit + 1)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        inside = zeros - np.repeat(zeros[first], np.diff(np.append(first, len(v))))
        total += float((w * inside)[~zero].sum())
    return total


def signed_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Pairs that agree less pairs that differ in order; rows count n times."""
    if not len(a):
        return 0.0
    agree, differ = np.lexsort((-b, a)), np.lexsort((b, a))
    return above(b[agree], n[agree]) - above(-b[differ], n[differ])


def kendall(df: DataFrame, a: str, b: str, ranges: int = 400) -> float | None:
    """Kendall's tau-b of two columns, rows with a null or NaN left out; null where a column does not vary.

    Approximate quantiles cut both columns into ranges; a value that is itself a cut has a
    range of its own, so no frequent value shares one.  Pairs in different ranges of both
    columns follow from counts of range pairs (at most (2 * ranges + 1)^2, on the driver);
    pairs within a range are counted in its own task: by the one column, by the other, less
    those within both.
    """
    number = lambda c: F.col(f"`{c}`").cast("double") + F.lit(0.0)
    known = df.select(number(a).alias("a"), number(b).alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    cells = settled(known.groupBy("a", "b").agg(F.count("*").alias("n")))
    ranges = max(2, ranges)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = cells.agg(*[F.percentile_approx(c, shares, 10 * ranges).alias(c) for c in ("a", "b")]).first()
    if cuts.a is None:
        return None
    bounds = {c: np.unique(np.array(cuts[c])) for c in ("a", "b")}

    def place(c: str) -> Column:
        edges = bounds[c]

        @F.arrow_udf("int")
        def found(x: pa.Array) -> pa.Array:
            x = x.to_numpy(zero_copy_only=False)
            return pa.array((np.searchsorted(edges, x, "left") + np.searchsorted(edges, x, "right")).astype(np.int32))

        return found(F.col(c))

    placed = settled(cells.select("a", "b", "n", place("a").alias("ra"), place("b").alias("rb")))
    whole = placed.groupBy("ra", "rb").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((2 * len(bounds["a"]) + 1, 2 * len(bounds["b"]) + 1))
    table[whole["ra"], whole["rb"]] = whole["n"]
    below = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    below[1:, 1:] = table.cumsum(0).cumsum(1)
    left = np.concatenate([np.zeros((1, table.shape[1])), table.cumsum(0)[:-1]]).sum(1, keepdims=True)
    score = float((table * below[:-1, :-1]).sum() - (table * (left - below[:-1, 1:])).sum())

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [signed_pairs(part["a"].to_numpy(), part["b"].to_numpy(), part["n"].to_numpy())]})

    # ranges with odd numbers hold one value, all tied
    for keys, sign in ((["ra"], 1), (["rb"], 1), (["ra", "rb"], -1)):
        own = placed.where(" and ".join(f"{k} % 2 = 0" for k in keys)).groupBy(*keys).applyInPandas(inside, "s double")
        score += sign * (own.agg(F.sum("s")).first()[0] or 0.0)
    n = float(table.sum())
    ties = {c: float(cells.groupBy(c).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]) for c in ("a", "b")}
    pairs = n * (n - 1) / 2
    under = np.sqrt((pairs - ties["a"]) * (pairs - ties["b"]))
    return float(score / under) if under else None
