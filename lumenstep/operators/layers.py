"""Leaf-weight optimisation of a regressor: tightening and evolution over leaf ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstep.operators import scoring
from lumenstep.operators.evolution import Evolve, LeafIndex, evolve
from lumenstep.operators.models import StepRegressor
from lumenstep.operators.written import settled

__all__ = ["Evolve", "LeafOptimiser", "Tighten", "step_gains"]


@dataclass
class Tighten:
    """Move the leaf whose shift lowers the absolute error most, again and again."""

    iterations: int = 100
    learning_rate: float = 0.03
    early_stopping: int | None = None


@dataclass
class LeafOptimiser:
    """Runs layers over a model in order; `subset` freezes the other features.

    apply_range rates predictions as the model clips them.  callback(layer, step, error) is
    called after every step of a layer.
    """

    model: StepRegressor
    apply_range: bool = False
    callback: Callable[[int, int, float], None] = lambda *_: None
    layers: list = field(default_factory=list)
    completed: list = field(default_factory=list)

    def add_layer(self, layer) -> LeafOptimiser:
        self.layers.append(layer)
        return self

    def drop_layer(self, index: int) -> None:
        self.layers.pop(index)

    def clear_layers(self) -> None:
        self.layers.clear()

    def fit(self, df: DataFrame, subset: list[str] | None = None) -> LeafOptimiser:
        """Target, frozen part and leaf ids of each row, written once with an index from leaves to rows."""
        m = self.model
        self.names = subset or m.features
        self.start, at = {}, 0
        for k in self.names:
            self.start[k] = at
            at += len(m.profile[k])
        self.scores = np.array([n.score for k in self.names for n in m.profile[k]])
        known = df.where(F.col(f"`{m.target}`").isNotNull())
        fixed = F.lit(m.base)
        for k in m.features:
            if k not in self.names:
                fixed = fixed + scoring.lookup(known, k, m.profile[k], lambda n: n.score)
        ids = F.array(*[(scoring.lookup(known, k, m.profile[k], lambda n: n.node_id) + self.start[k]).cast("int") for k in self.names])
        self.rows = settled(known.select(F.col(f"`{m.target}`").cast("double").alias("y"), fixed.alias("fixed"), ids.alias("leaves")))
        bounds = [x if x is not None and self.apply_range else s * np.inf for x, s in zip(m.prediction_range, (-1, 1))]
        self.index = LeafIndex(self.rows, len(self.scores), *bounds)
        return self

    def errors(self, population: np.ndarray) -> np.ndarray:
        """Mean absolute error of each score vector (rows of population)."""
        return np.array([self.index.rated(scores, [{}])[0] for scores in population])

    def _tighten(self, layer: Tighten, progress: Callable[[int, float], None]) -> None:
        best, best_scores, since = self.errors(self.scores[None])[0], self.scores.copy(), 0
        scores = self.scores.copy()
        for step in range(layer.iterations):
            table = F.array(*[F.lit(float(s)) for s in scores])
            err = self.rows.select("leaves", (F.aggregate("leaves", F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1)) + F.col("fixed") - F.col("y")).alias("e"))
            per = step_gains(err.select(F.explode("leaves").alias("leaf"), "e")).collect()
            top = max(per, key=lambda r: (max(r.inc, r.dec), -r.leaf))
            if max(top.inc, top.dec) <= 0:
                break
            up = top.inc >= top.dec
            scores[top.leaf] += (1 if up else -1) * np.sqrt(top.um if up else top.om) * layer.learning_rate
            now = self.errors(scores[None])[0]
            since = 0 if now < best else since + 1
            progress(step, float(now))
            if now < best:
                best, best_scores = now, scores.copy()
            if layer.early_stopping and since >= layer.early_stopping:
                break
        self.scores = best_scores

    def optimise(self) -> StepRegressor:
        """Run the layers left; the best scores found are written back into the model."""
        while self.layers:
            layer = self.layers.pop(0)
            progress = lambda step, error, at=len(self.completed): self.callback(at, step, error)
            if isinstance(layer, Tighten):
                self._tighten(layer, progress)
            else:
                self.scores = evolve(self.index, self.scores, layer, progress)
            self.completed.append(layer)
        for k in self.names:
            own = self.scores[self.start[k] : self.start[k] + len(self.model.profile[k])]
            self.model.profile[k] = [replace(n, score=float(s)) for n, s in zip(self.model.profile[k], own)]
        self.model.meta["optimised"] = True
        return self.model


def step_gains(errors: DataFrame) -> DataFrame:
    """leaf, um, om, inc, dec from (leaf, e): what raising or lowering a leaf would gain.

    Shifting a leaf by the mean error of one side helps the rows of that side and harms all
    others as much: gain = mean error of the side * (2 * rows on the side - all rows).
    um, uc: mean error and rows where the prediction is too low; om, oc: too high; ec: exact.
    """
    low, high = F.col("e") < 0, F.col("e") > 0
    mean = lambda side: F.coalesce(F.avg(F.when(side, F.abs("e"))), F.lit(0.0))
    per = errors.groupBy("leaf").agg(mean(low).alias("um"), F.count_if(low).alias("uc"), mean(high).alias("om"), F.count_if(high).alias("oc"), F.count_if(F.col("e") == 0).alias("ec"))
    rows = F.col("uc") + F.col("oc") + F.col("ec")
    return per.withColumn("inc", F.col("um") * (2 * F.col("uc") - rows)).withColumn("dec", F.col("om") * (2 * F.col("oc") - rows))
