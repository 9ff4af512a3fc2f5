"""Exact splits of numeric features that have more values than the driver should hold.

Counts by value are dealt out by ranges of (feature, value); a window within each range and
one total for each range give every value its rank and the counts and target sums at or below
it.  This table is written once.  A tree grows level by level: every task walks its part of
the table with the open nodes of all features in hand and keeps the best split of each; the
driver sees one split for each node and level, whatever the number of values.

Candidates are thinned by global rank, gains rounded, ties go to the smallest split, as for
features whose values are held on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.operators.params import StepParams
from lumenstep.operators.written import settled

#: (lower, upper, count, target sum) of a leaf.
Leaf = tuple[float, float, float, float]


@dataclass(frozen=True)
class WideValues:
    """A feature's part of a table (feature, place, split, below, below_sum); `distinct` values in all."""

    table: DataFrame
    number: int
    distinct: int


def candidate_step(n: int, alpha: float) -> int:
    """Every so many places between neighbouring values is a candidate."""
    wanted = int((n ** (1 - alpha) - 1) / (1 - alpha)) + 1
    return max(1, n // wanted)


def gains(below: np.ndarray, below_sum: np.ndarray, left: tuple, right: tuple, n: float, base: float, least: float, min_gain: float) -> np.ndarray:
    """Rounded gain of each split of nodes between (count, sum) below their lower and upper ends; 0 where it is not allowed."""
    lc, rc = below - left[0], right[0] - below
    ok = (lc >= least) & (rc >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        ld, rd = abs((below_sum - left[1]) / lc - base), abs((right[1] - below_sum) / rc - base)
        found = ld * np.log2(lc / n * 100) + rd * np.log2(rc / n * 100)
        ok &= np.maximum(ld, rd) >= min_gain
    return np.round(np.where(ok, found, 0.0), 12)


def cumulated(groups: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The table of WideValues and the number of values by feature, of groups (f, v, n, s) without nulls."""
    dealt = settled(groups.repartitionByRange("f", "v").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("f", "part").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("v").alias("first")).collect()
    offsets, sizes, last = [], {}, None
    for r in sorted(totals, key=lambda r: (r.f, r.part)):  # one row for each range and feature
        if last is None or last[0] != r.f:
            last = [r.f, 0, 0, 0.0]
        elif offsets:
            offsets[-1][-1] = r["first"]
        offsets.append([r.f, r.part, last[1], last[2], last[3], None])
        last = [r.f, last[1] + r.k, last[2] + r.n, last[3] + r.s]
        sizes[r.f] = last[1]
    table = groups.sparkSession.createDataFrame(offsets, "_f int, _part int, _k long, _n long, _s double, _next double")
    order = Window.partitionBy("part", "f").orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(table), (F.col("f") == F.col("_f")) & (F.col("part") == F.col("_part"))).select(
        "f", (F.row_number().over(order) - 1 + F.col("_k")).cast("long").alias("place"), "v", F.coalesce(F.lead("v").over(order), "_next").alias("next"),
        (F.sum("n").over(upto) + F.col("_n")).alias("below"), (F.sum("s").over(upto) + F.col("_s")).alias("below_sum"),
    )
    out = placed.where("next is not null").select("f", "place", ((F.col("v") + F.col("next")) / 2).alias("split"), "below", "below_sum")
    return settled(out), sizes


@dataclass
class _Open:
    """Nodes of a feature that may still split, ascending: bounds, and count and sum below them."""

    step: int
    params: StepParams
    least: int
    bounds: np.ndarray  # lower, upper, count and sum below lower, count and sum below upper


def best_splits(table: DataFrame, opened: dict[int, _Open], n: float, base: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """By (feature, node): split, count and sum below it, of the nodes that gain by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for b in batches:
            feature, place, split, below, total = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for f, o in opened.items():
                at = np.flatnonzero((feature == f) & (place % o.step == 0))
                node = np.searchsorted(o.bounds[:, 0], split[at], "left") - 1
                ok = (node >= 0) & (split[at] < o.bounds[np.maximum(node, 0), 1])
                at, node = at[ok], node[ok]
                own = o.bounds[node].T
                gain = gains(below[at], total[at], (own[2], own[3]), (own[4], own[5]), n, base, o.least, o.params.min_info_gain)
                order = np.lexsort((split[at], -gain, node))
                first = order[np.flatnonzero(np.concatenate([[True], np.diff(node[order]) > 0]))] if len(order) else order
                for i in first[gain[first] > 0].tolist():
                    found = (float(gain[i]), -float(split[at[i]]), float(below[at[i]]), float(total[at[i]]))
                    key = (f, int(node[i]))
                    best[key] = max(best.get(key, found), found)
        columns = [[k[0] for k in best], [k[1] for k in best], *zip(*best.values())] if best else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int32() if i < 2 else pa.float64()) for i, x in enumerate(columns)], ["f", "node", "gain", "minus", "below", "total"])

    rows = table.where(F.col("f").isin(*opened)).mapInArrow(run, "f int, node int, gain double, minus double, below double, total double")
    rows = rows.groupBy("f", "node").agg(F.max(F.struct("gain", "minus", "below", "total")).alias("x")).collect()
    return {(r.f, r.node): (-r.x.minus, r.x.below, r.x.total) for r in rows}


def grow(features: dict[str, tuple[WideValues, StepParams, float, float]], n: int, base: float, alpha: float) -> dict[str, list[Leaf]]:
    """Leaves of wide features of one table, ascending; each with its resolved parameters, count and target sum.  One job a level."""
    if not features:
        return {}
    table = next(iter(features.values()))[0].table
    whole = {w.number: (name, w, p, count, total) for name, (w, p, count, total) in features.items()}
    nodes = {f: np.array([[-math.inf, math.inf, 0.0, 0.0, count, total]]) for f, (_, _, _, count, total) in whole.items()}
    closed: dict[int, list[tuple]] = {f: [] for f in nodes}
    depth = 0
    while nodes:
        for f in [f for f in nodes if depth >= whole[f][2].max_depth]:
            closed[f] += [tuple(x) for x in nodes.pop(f)]
        opened = {f: _Open(candidate_step(whole[f][1].distinct, alpha), whole[f][2], max(1, int(whole[f][2].min_leaf_size * n)), x) for f, x in nodes.items()}
        found = best_splits(table, opened, n, base) if opened else {}
        for f, x in list(nodes.items()):
            young = []
            for i, (lower, upper, c0, s0, c1, s1) in enumerate(x):
                if (f, i) not in found:
                    closed[f].append((lower, upper, c0, s0, c1, s1))
                    continue
                cut, c, s = found[f, i]
                young += [(lower, cut, c0, s0, c, s), (cut, upper, c, s, c1, s1)]
            if young:
                nodes[f] = np.array(young)
            else:
                nodes.pop(f)
        depth += 1
    return {whole[f][0]: [(float(lower), float(upper), float(c1 - c0), float(s1 - s0)) for lower, upper, c0, s0, c1, s1 in sorted(x)] for f, x in closed.items()}
