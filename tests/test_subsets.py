"""Subsets of features are rated together and as each would be alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import metrics, scoring, search, tree
from lumenstep.operators.models import StepClassifier


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 17) if i % 9 else None, ["a", "b", None][i % 3], i % 4 == 0, int((i * 37) % 100 < 30 + 3 * (i % 17))) for i in range(1200)]
    return spark.createDataFrame(data, "id long, x double, k string, f boolean, y int").repartition(5)


def test_aucs_equal_single_ones(rows):
    model = StepClassifier(calibrate=False).fit(rows, "y", ["x", "k", "f"])
    subsets = [["x"], ["k"], ["x", "k"], ["f", "k", "x"], ["f"]]
    profiles = [tree.normalised({k: model.profile[k] for k in s}, model.base, dict.fromkeys(s, model.params)) for s in subsets]
    got = search.subset_aucs(rows, "y", model.base, profiles)
    for s, profile, auc in zip(subsets, profiles, got):
        scored = scoring.with_contributions(rows.select("y", *s), profile).select(F.col("y").cast("double").alias("_y"), scoring.total(model.base, sorted(s)).alias("_s"))
        assert auc == pytest.approx(metrics.roc_auc(scored, "_y", "_s").first()[0], abs=1e-12)
    assert search.subset_aucs(rows.where("y = 1"), "y", model.base, profiles) == [0.0] * 5 == search.subset_aucs(rows.limit(0), "y", model.base, profiles)


def test_jobs_do_not_grow_with_subsets(spark, rows):
    found = []
    for n in (2, 30):
        spark.sparkContext.setJobGroup(f"subsets{n}", "")
        out = search.select_features(rows, "y", "id", n, features=["x", "k", "f"])
        found.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"subsets{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert found[1] <= found[0] + 1
    assert out.best(1) == ["x"] and out.best(3) == [k for k, _ in out] and out.best(0) == []
    with pytest.raises(ValueError):
        out.best(4)
    assert np.isfinite([s for _, s in out]).all()


def test_folds_and_samples_with_odd_names(spark):
    rows = spark.createDataFrame([(i, i % 3, 7, 8, 9, 5, 1) for i in range(90)], "id int, y int, _range int, _class int, _rank int, fold int, _hash int")
    out = search.with_folds(rows, "y", "id", 5)
    assert out.columns == ["id", "y", "_range", "_class", "_rank", "_hash", "fold"]
    assert all(r["count"] == 6 for r in out.groupBy("y", "fold").count().collect()) and out.where("_range = 7 and _class = 8 and _rank = 9 and _hash = 1").count() == 90
    some = search.sample_rows(rows, "id", n=10, seed=1)
    assert some.columns == rows.columns and some.count() == 10
