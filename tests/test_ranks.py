"""Quantiles, ranks and Kendall's tau against plain readings, with ties, nulls, NaN and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstep.operators import quality, ranks


def test_keys_sort_as_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    keys = ranks.sort_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all() and (ranks.of_keys(keys) == x).all()
    assert ranks.sort_keys(np.array([-0.0]))[0] == ranks.sort_keys(np.array([0.0]))[0]


@pytest.mark.parametrize("few", [0, 50, ranks.FEW])
def test_quantiles_equal_sorted_values(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(2)
    columns = {"wide": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), "near": 1 + rng.integers(0, 90, 3000) * 2.0**-52, "tied": np.where(rng.random(3000) < 0.7, 4.0, rng.integers(-5, 5, 3000).astype(float))}
    rows = [tuple(float(columns[c][i]) if (i + k) % 11 else (None if i % 2 else float("nan")) for k, c in enumerate(columns)) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    shares = [0.0, 0.013, 0.25, 0.5, 0.77, 0.9999, 1.0]
    got = ranks.quantiles(df, {c: F.col(c) for c in columns}, shares)
    for k, c in enumerate(columns):
        own = np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]])
        assert got[c] == pytest.approx(list(np.quantile(own, shares)), rel=1e-12)
    assert ranks.quantiles(df.limit(0), {"wide": F.col("wide")}, [0.5]) == {"wide": [None]} and ranks.quantiles(df, {}, [0.5]) == {}


def test_little_reaches_the_driver(spark, monkeypatch):
    seen, real = [], ranks._pass
    monkeypatch.setattr(ranks, "_pass", lambda c, wanted: seen.append(out := real(c, wanted)) or out)
    n = 200_000
    df = spark.range(n).select((F.xxhash64("id") / 1e12).alias("x"))
    got = ranks.quantiles(df, {"x": F.col("x")}, [0.25, 0.5])["x"]
    assert got == pytest.approx([df.agg(F.percentile("x", p)).first()[0] for p in (0.25, 0.5)], rel=1e-13)
    assert len(seen) <= 6 and all(len(t) <= max(1 << ranks.BITS, ranks.FEW) for out in seen for t in out.values())


def test_average_ranks_of_any_type_and_names(spark):
    rows = [(v, i, i) for i, v in enumerate(["b", "a", None, "b", "c", "b", "a"])]
    df = spark.createDataFrame(rows, "_value string, _count int, _n int")
    got = {r["_n"]: r["rank__value"] for r in ranks.ranked(df, "_value").collect()}
    assert got == {0: 4.0, 1: 1.5, 2: None, 3: 4.0, 4: 6.0, 5: 4.0, 6: 1.5}
    assert ranks.ranked(df.limit(0), "_value").columns == ["_value", "_count", "_n", "rank__value"]
    many = ranks.ranked(spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v")), "v")
    order = {v: k + 1 for k, v in enumerate(sorted(r.v for r in many.collect()))}
    assert all(r.rank_v == order[r.v] for r in many.collect())
    text = many._jdf.queryExecution().toString()
    assert "Window [" in text and "_range_part" in text and "windowspecdefinition(v" not in text


def brute_tau(known):
    sign = lambda d: (d > 0) - (d < 0)
    pairs = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for i, p in enumerate(known) for q in known[:i]]
    under = (sum(a * a for a, _ in pairs) * sum(b * b for _, b in pairs)) ** 0.5
    return sum(a * b for a, b in pairs) / under if under else None


@pytest.mark.parametrize("cuts", [1, 3, 30, 400])
def test_kendall_against_all_pairs(spark, cuts):
    rng = np.random.default_rng(cuts)
    x = rng.normal(size=250)
    rows = [(float(a), float(b)) for a, b in zip(np.where(rng.random(250) < 0.35, 0.5, x), np.round(x + rng.normal(size=250), 1))]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None), (float("nan"), 3.0), *rows[:40]], "a double, b double").repartition(3)
    assert ranks.kendall(df, "a", "b", ranges=cuts) == pytest.approx(brute_tau(rows + rows[:40]))


def test_kendall_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert ranks.kendall(df, "a", "b") is None and ranks.kendall(df.limit(0), "a", "b") is None
    assert ranks.kendall(spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "a int, b int"), "a", "b") == -1.0


def test_scan_jobs_do_not_grow_with_columns(spark):
    def jobs(width):
        df = spark.range(300).select(*[(F.col("id") % (k + 2)).alias(f"n{k}") for k in range(width)], *[F.concat(F.lit("v "), F.col("id") % (k + 3)).alias(f"t{k}") for k in range(width)])
        spark.sparkContext.setJobGroup(f"scan{width}", "")
        rows = quality.scan(df).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan{width}"))
        spark.sparkContext.setJobGroup("", "")
        return found, {r["column"]: r for r in rows}

    few, _ = jobs(1)
    many, rows = jobs(6)
    assert many <= few + 1
    assert rows["n3"].n_unique == 5 and rows["n3"]["median"] == 2.0 and rows["t2"].kind == "categorical" and rows["t2"].mode == "v 0" and rows["t2"].mixed_type == 1.0
    assert rows["t2"].category_imbalance == pytest.approx(0.0)
