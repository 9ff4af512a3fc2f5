"""Evolution of leaf scores over an inverted index from leaves to rows.

A mutation changes a few leaves, so only the rows in these leaves change their prediction.
Rows lie in blocks, each with the positions of its rows by leaf; a block gives the error of
every mutation from the block's present error and the rows that the mutation touches.  A
whole pool of mutations is rated in one job, which returns one sum for each of them.

A mutation multiplies leaf scores by factors.  A generation selects: those that beat the
target remain, best first, and their mean error becomes the target of the next selection.
Pairs of neighbours are averaged, the best joins them, each gets a mutated copy, and
selection follows again, until one is left, none beats the target, or the depth is used up.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.operators.written import settled

#: Factors by leaf.
Mutation = dict[int, float]
METRICS = ("mae", "mse")


def losses(errors: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(errors) if metric == "mae" else errors**2


@dataclass
class Evolve:
    """A genetic search over leaf scores; a whole selection is rated in one job."""

    mutations: int = 100
    generations: int = 50
    max_generation_depth: int = 10
    max_severity: float = 0.5
    max_leaves: int = 20
    early_stopping: int | None = None
    metric: str = "mae"
    seed: int = 1

    def mutate(self, n_leaves: int, rng: random.Random, parent: Mutation | None = None) -> Mutation:
        """Up to max_leaves leaves, drawn with repeats, each raised or lowered by up to max_severity in steps of a thousandth."""
        out, drawn = dict(parent or {}), {}
        for leaf in rng.choices(range(n_leaves), k=rng.randint(1, min(self.max_leaves, n_leaves))):
            step = rng.randint(1, max(1, int(self.max_severity * 1000))) / 1000
            drawn[leaf] = rng.choice((1 + step, 1 - step))
        for leaf, factor in drawn.items():
            out[leaf] = out.get(leaf, 1.0) * factor
        return out


class LeafIndex:
    """Rows (y, fixed, leaves) in blocks with their positions by leaf; fixed is the part of a prediction that does not move."""

    def __init__(self, rows: DataFrame, n_leaves: int, low: float = -np.inf, high: float = np.inf):
        self.n_leaves, self.low, self.high = n_leaves, low, high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                leaves = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                width = len(leaves) // b.num_rows
                order = np.argsort(leaves, kind="stable")
                starts = np.searchsorted(leaves[order], np.arange(n_leaves + 1)).astype(np.int32)
                one = lambda x, t: pa.array([x], pa.list_(t))
                columns = [one(b.column(0).to_numpy(), pa.float64()), one(b.column(1).to_numpy(), pa.float64()), one(leaves, pa.int32()), one((order // max(1, width)).astype(np.int32), pa.int32()), one(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["y", "fixed", "leaves", "rows", "starts"])

        schema = "y array<double>, fixed array<double>, leaves array<int>, rows array<int>, starts array<int>"
        self.blocks = settled(rows.select("y", "fixed", "leaves").mapInArrow(run, schema))

    def errors(self, scores: np.ndarray, pool: list[Mutation], metric: str = "mae") -> DataFrame:
        """(mutation, error, touched): mean loss with the scores changed by each mutation, and the rows whose prediction moves."""
        if metric not in METRICS:
            raise ValueError(f"metric {metric}; there are {METRICS}")
        moves = [(np.array(list(m), np.int64), np.array([scores[i] * (f - 1) for i, f in m.items()], float)) for m in pool]
        low, high = self.low, self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, touched = np.zeros(len(moves)), 0, np.zeros(len(moves), np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    y, fixed, leaves, rows, starts = (c[i].values.to_numpy(zero_copy_only=False) for c in b.columns)
                    plain = fixed + scores[leaves].reshape(len(y), -1).sum(axis=1)
                    loss = losses(np.clip(plain, low, high) - y, metric)
                    moved, whole = np.zeros(len(y)), loss.sum()
                    for k, (changed, by) in enumerate(moves):
                        parts = [rows[starts[leaf] : starts[leaf + 1]] for leaf in changed]
                        for at, d in zip(parts, by, strict=True):
                            moved[at] += d  # a row is in a leaf of a feature once
                        at = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                        total[k] += whole + (losses(np.clip(plain[at] + moved[at], low, high) - y[at], metric) - loss[at]).sum()
                        touched[k] += len(at)
                        moved[at] = 0.0
                    n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moves))), pa.array(total), pa.array(touched), pa.array(np.full(len(moves), n))], ["mutation", "total", "touched", "n"])

        found = self.blocks.mapInArrow(run, "mutation long, total double, touched long, n long")
        return found.groupBy("mutation").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("error"), F.sum("touched").alias("touched"))

    def rated(self, scores: np.ndarray, pool: list[Mutation], metric: str = "mae") -> np.ndarray:
        """The errors of a pool, in its order."""
        out = np.zeros(len(pool))
        for r in self.errors(scores, pool, metric).collect():
            out[r.mutation] = r.error or 0.0
        return out


def selected(pool: list[Mutation], found: np.ndarray, target: float) -> tuple[list[Mutation], float, float]:
    """Those below the target, best first; the best error; their mean, the next target (all as given, if there are none)."""
    order = [int(i) for i in np.argsort(found, kind="stable") if found[i] < target]
    if not order:
        return [], target, target
    return [pool[i] for i in order], float(found[order[0]]), float(np.mean(found[order]))


def bred(parents: list[Mutation], layer: Evolve, n_leaves: int, rng: random.Random) -> list[Mutation]:
    """Means of neighbouring pairs and the best parent, then a mutated copy of each."""
    mean = lambda a, b: {i: (a.get(i, 1.0) + b.get(i, 1.0)) / 2 for i in {**a, **b}}
    young = [*[mean(a, b) for a, b in zip(parents[::2], parents[1::2])], parents[0]]
    return [*young, *[layer.mutate(n_leaves, rng, m) for m in young]]


def generation(index: LeafIndex, scores: np.ndarray, error: float, layer: Evolve, rng: random.Random) -> tuple[np.ndarray, float]:
    """Scores and their error after one generation; unchanged if no mutation is better."""
    pool = [layer.mutate(index.n_leaves, rng) for _ in range(layer.mutations)]
    parents, best, target = selected(pool, index.rated(scores, pool, layer.metric), error)
    if not parents:
        return scores, error
    winner = parents[0]
    for _ in range(layer.max_generation_depth):
        if len(parents) < 2:
            break
        pool = bred(parents, layer, index.n_leaves, rng)
        parents, found, target = selected(pool, index.rated(scores, pool, layer.metric), target)
        if parents and found < best:
            best, winner = found, parents[0]
    out = scores.copy()
    for leaf, factor in winner.items():
        out[leaf] *= factor
    return out, best


def evolve(index: LeafIndex, scores: np.ndarray, layer: Evolve, progress) -> np.ndarray:
    """Generations until they are used up or early_stopping of them in a row bring nothing; progress(step, error) after each."""
    rng = random.Random(layer.seed)
    error, since = float(index.rated(scores, [{}], layer.metric)[0]), 0
    for step in range(layer.generations):
        if layer.early_stopping is not None and since >= layer.early_stopping:
            break
        scores, now = generation(index, scores, error, layer, rng)
        since = 0 if now < error else since + 1
        error = now
        progress(step, error)
    return scores
