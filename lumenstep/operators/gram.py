"""Counts of leaf pairs for the normal equations of step regressors, for any number of partitions in one scan.

Tasks look up the leaves of whole batches from raw values (a search among upper bounds, an
index of categories) and count pairs of leaves feature by feature in small dense blocks.
Counts leave a task whenever its blocks hold more than CELLS numbers, so a task's memory does
not depend on its rows; what reaches the driver are leaves and pairs of leaves, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.operators.stats import category, number
from lumenstep.operators.tree import Node

CELLS = 4_000_000


@dataclass
class LeafSums:
    """Of one model: rows and target sum by leaf, rows by pair of leaves."""

    count: np.ndarray
    total: np.ndarray
    both: np.ndarray


def values(df: DataFrame, kinds: dict[str, str]) -> list:
    """Columns x0, x1, ... with the values of features (name -> kind) as LeafTable.ids takes them."""
    return [(number(k) if kind == "numeric" else category(df, k)).alias(f"x{i}") for i, (k, kind) in enumerate(kinds.items())]


@dataclass
class LeafTable:
    """Leaf lookup of one feature: upper bounds or categories; the null node comes last."""

    start: int
    size: int
    uppers: np.ndarray | None = None
    names: pa.Array | None = field(default=None, repr=False)

    @staticmethod
    def of(start: int, nodes: list[Node]) -> LeafTable:
        if nodes[0].kind == "numeric":
            return LeafTable(start, len(nodes), uppers=np.array([n.upper for n in nodes[:-1]], float))
        return LeafTable(start, len(nodes), names=pa.array([n.category for n in nodes[:-1]], pa.string()))

    def ids(self, values: pa.Array) -> np.ndarray:
        """Leaf of each value within the feature; nulls and unseen categories are in the null node."""
        null = self.size - 1
        if self.uppers is None:
            return pc.fill_null(pc.index_in(values, value_set=self.names), null).to_numpy(zero_copy_only=False).astype(np.int64) if null else np.zeros(len(values), np.int64)
        x = values.to_numpy(zero_copy_only=False).astype(float)
        return np.where(np.isnan(x), null, np.minimum(np.searchsorted(self.uppers, x, "left"), max(0, null - 1)))


def leaf_sums(df: DataFrame, target: str, profiles: dict[str | None, dict[str, list[Node]]], column: str | None = None) -> dict[str | None, LeafSums]:
    """By model: its sums over the rows with a target whose `column` (as text) is its key; the key None takes all rows."""
    kinds = {k: nodes[0].kind for p in profiles.values() for k, nodes in p.items()}
    features = list(kinds)
    tables, width = {}, {}
    for key, profile in profiles.items():
        tables[key], at = {}, 0
        for k, nodes in profile.items():
            tables[key][k] = LeafTable.of(at, nodes)
            at += len(nodes)
        width[key] = at
    keys = list(profiles)
    slim = df.where(F.col(f"`{target}`").isNotNull()).select(
        F.col(f"`{column}`").cast("string").alias("p") if column else F.lit(None).cast("string").alias("p"), F.col(f"`{target}`").cast("double").alias("y"),
        *values(df, kinds),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, np.ndarray] = {}
        sums: dict[tuple, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            rows = []
            for (m, i0, j0, wide), block in blocks.items():
                at = np.flatnonzero(block)
                rows.append((np.full(len(at), m), i0 + at // wide, j0 + at % wide, block[at].astype(np.int64), np.zeros(len(at))))
            for (m, i0), total in sums.items():
                rows.append((np.full(len(total), m), i0 + np.arange(len(total)), i0 + np.arange(len(total)), np.zeros(len(total), np.int64), total))
            blocks.clear()
            sums.clear()
            columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, float)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "i", "j", "n", "s"])

        for b in batches:
            for m, key in enumerate(keys):
                part = b if key is None else b.filter(pc.fill_null(pc.equal(b.column(0), key), False))
                if not part.num_rows:
                    continue
                y = part.column(1).to_numpy(zero_copy_only=False)
                own = [(t, t.ids(part.column(2 + features.index(k)))) for k, t in tables[key].items()]
                for a, (ta, ia) in enumerate(own):
                    total = sums.setdefault((m, ta.start), np.zeros(ta.size))
                    total += np.bincount(ia, y, ta.size)
                    for tb, ib in own[a:]:
                        name = (m, ta.start, tb.start, tb.size)
                        if name not in blocks:
                            blocks[name] = np.zeros(ta.size * tb.size)
                        blocks[name] += np.bincount(ia * tb.size + ib, minlength=ta.size * tb.size)
            if sum(map(len, blocks.values())) > CELLS:
                yield flushed()
        yield flushed()

    found = slim.mapInArrow(run, "m long, i long, j long, n long, s double").groupBy("m", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    out = {}
    for m, key in enumerate(keys):
        part, at = found[found["m"] == m], width[key]
        i, j = part["i"].to_numpy(np.int64), part["j"].to_numpy(np.int64)
        sums = LeafSums(np.zeros(at), np.zeros(at), np.zeros((at, at)))
        sums.both[i, j] = part["n"]
        sums.both[j, i] = part["n"]
        sums.count[:] = np.diag(sums.both)
        same = i == j
        sums.total[i[same]] = part["s"].to_numpy()[same]
        out[key] = sums
    return out
