"""Exclusion rules against plain sets; no join of all pairs in the plan."""

import random
from collections import Counter

import pytest

from lumenstep.operators import rules


def brute(rows, columns, least):
    seen = Counter((c, v) for r in rows for c, v in zip(columns, r) if v is not None)
    held = [x for x, n in seen.items() if n >= least]
    together = {((a, r[i]), (b, r[j])) for r in rows for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j}
    return sorted((*x, *y) for x in held for y in held if x[0] != y[0] and (x, y) not in together)


@pytest.mark.parametrize("least,width", [(1, 5), (3, 40), (2, 90)])
def test_equals_sets(spark, least, width):
    rng = random.Random(width)
    rows = [tuple(rng.choice([None, f"v{rng.randrange(width)}", "hot", "hot"]) for _ in range(4)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "a string, `b c` string, c string, n string").repartition(5)
    out = rules.exclusion_rules(frame, frame.columns, least)
    assert sorted(map(tuple, out.collect())) == brute(rows, frame.columns, least)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_small_inputs_and_bound(spark):
    frame = spark.createDataFrame([(1, "x", None), (2, "y", None)], "a int, b string, c string")
    assert sorted(map(tuple, rules.exclusion_rules(frame, ["a", "b", "c"], 1).collect())) == [("a", "1", "b", "y"), ("a", "2", "b", "x"), ("b", "x", "a", "2"), ("b", "y", "a", "1")]
    assert rules.exclusion_rules(frame, ["a"], 1).count() == rules.exclusion_rules(frame, ["a", "b"], 5).count() == rules.exclusion_rules(frame.limit(0), ["a", "b"], 1).count() == 0
    with pytest.raises(ValueError, match="support"):
        rules.exclusion_rules(frame, ["a", "b"], 1, max_values=3)
