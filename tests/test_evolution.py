"""The index rates mutations as whole predictions would; selection, depth, stopping, callbacks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import evolution
from lumenstep.operators.layers import Evolve, LeafOptimiser, Tighten
from lumenstep.operators.models import StepRegressor

LEAVES = 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    leaves = np.stack([rng.integers(0, 4, 3000), rng.integers(4, 9, 3000), np.where(rng.random(3000) < 0.9, 9, rng.integers(10, 12, 3000))], axis=1)
    y, fixed = rng.normal(10, 4, 3000), rng.normal(0, 1, 3000)
    rows = [(float(a), float(b), [int(x) for x in c]) for a, b, c in zip(y, fixed, leaves)]
    return spark.createDataFrame(rows, "y double, fixed double, leaves array<int>").repartition(5), y, fixed, leaves


@pytest.mark.parametrize("metric", evolution.METRICS)
@pytest.mark.parametrize("low,high", [(-np.inf, np.inf), (3.0, 11.0)])
def test_errors_equal_whole_predictions(data, metric, low, high):
    rows, y, fixed, leaves = data
    index = evolution.LeafIndex(rows, LEAVES, low, high)
    scores, layer, rng = np.linspace(-2, 5, LEAVES), Evolve(max_leaves=5), random.Random(2)
    pool = [{}, *[layer.mutate(LEAVES, rng) for _ in range(15)], {0: 0.0}, {9: 2.0, 10: 0.5, 3: 1.0}]
    want, touched = [], []
    for m in pool:
        own = scores * [m.get(i, 1.0) for i in range(LEAVES)]
        e = np.clip(fixed + own[leaves].sum(axis=1), low, high) - y
        want.append(np.mean(np.abs(e) if metric == "mae" else e**2))
        touched.append(int(np.isin(leaves, list(m)).any(axis=1).sum()) if m else 0)
    assert np.allclose(index.rated(scores, pool, metric), want, rtol=1e-12)
    assert [r.touched for r in index.errors(scores, pool, metric).orderBy("mutation").collect()] == touched


def test_no_rows_and_unknown_metric(spark, data):
    rows = data[0]
    assert evolution.LeafIndex(rows.limit(0), LEAVES).errors(np.zeros(LEAVES), [{}, {1: 2.0}]).where("error is not null").count() == 0
    with pytest.raises(ValueError, match="metric"):
        evolution.LeafIndex(rows, LEAVES).errors(np.zeros(LEAVES), [{}], "rmsle")


def test_selection_moves_the_target():
    pool = ["a", "b", "c", "d", "e"]
    assert evolution.selected(pool, np.array([5.0, 2.0, 9.0, 2.0, 4.0]), 4.5) == (["b", "d", "e"], 2.0, 8.0 / 3)
    assert evolution.selected(pool, np.array([5.0] * 5), 5.0) == ([], 5.0, 5.0)


def test_breeding_pairs_neighbours_and_keeps_the_best():
    layer, rng = Evolve(max_leaves=1, max_severity=0.1), random.Random(1)
    out = evolution.bred([{0: 2.0}, {1: 3.0}, {0: 0.5}], layer, 4, rng)
    assert out[:2] == [{0: 1.5, 1: 2.0}, {0: 2.0}] and len(out) == 4
    for child, young in zip(out[2:], out[:2]):
        changed = [i for i in {**child, **young} if child.get(i, 1.0) != young.get(i, 1.0)]
        assert len(changed) == 1 and 0.9 <= child[changed[0]] / young.get(changed[0], 1.0) <= 1.1


def test_generation_depth_and_target(data, monkeypatch):
    rows = data[0]
    index, scores = evolution.LeafIndex(rows, LEAVES), np.linspace(-2, 5, LEAVES)
    targets, real = [], evolution.selected
    monkeypatch.setattr(evolution, "selected", lambda pool, found, target: targets.append(target) or real(pool, found, target))
    start = float(index.rated(scores, [{}])[0])
    for depth in (0, 1, 3):
        targets.clear()
        out, error = evolution.generation(index, scores, start, Evolve(mutations=30, max_generation_depth=depth), random.Random(3))
        assert len(targets) <= depth + 1 and targets[0] == start and all(b < a for a, b in zip(targets, targets[1:]))
        assert error < start and np.isclose(index.rated(out, [{}])[0], error)
    same, error = evolution.generation(index, scores, 0.0, Evolve(mutations=5), random.Random(3))
    assert error == 0.0 and (same == scores).all()


def test_layers_over_a_model(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", F.month("o_orderdate").alias("month"), "o_totalprice")
    seen = []

    def run(seed):
        model = StepRegressor(prediction_range=(0.0, 400000.0)).fit(rows, "o_totalprice")
        found = LeafOptimiser(model, apply_range=True, callback=lambda *x: seen.append(x)).add_layer(Tighten(2)).add_layer(Evolve(12, 3, 2, early_stopping=2, seed=seed)).fit(rows)
        before = found.errors(found.scores[None])[0]
        out = found.optimise()
        after = out.predict(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("o_totalprice")))).first()[0]
        assert after <= before + 1e-9 and out.meta["optimised"]
        return after, [n.score for v in out.profile.values() for n in v]

    first = run(4)
    assert {x[0] for x in seen} == {0, 1} and [x[1] for x in seen if x[0] == 1] == list(range(len([x for x in seen if x[0] == 1])))
    assert run(4) == first and run(5)[1] != first[1]
