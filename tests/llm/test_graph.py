"""Components against a walk over all links, hot nodes included."""

import random

import pytest

from lumenstep.llm import graph


def brute(links):
    least = {x: x for link in links for x in link}
    moved = True
    while moved:
        moved = False
        for u, v in links:
            m = min(least[u], least[v])
            moved |= (least[u], least[v]) != (m, m)
            least[u] = least[v] = m
    return {(x, m) for x, m in least.items() if x != m}


@pytest.mark.parametrize("most", [graph.MAX_BROADCAST_NODES, 0])
def test_hubs_chains_and_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MAX_BROADCAST_NODES", most)
    rng = random.Random(3)
    links = [(5000, x) for x in range(1000, 1300)] + [(7, x) for x in range(1290, 1500)]
    links += [(x, x + 1) for x in range(2000, 2030)] + [(3, 3)]
    links += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    found = graph.components(spark.createDataFrame(links + links[:50], "u long, v long"))
    assert {tuple(r) for r in found.select("node", "component").collect()} == brute(links)
    assert found.count() == len(brute(links))


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_estimates_do_not_grow_with_rounds(spark):
    """A path numbered at random takes several rounds; by products of estimates each would take the ninth power."""
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    found = graph.components(spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long"))
    assert {tuple(r) for r in found.select("node", "component").collect()} == {(x, 0) for x in range(1, 60)}
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 64


def test_a_long_path_ends(spark):
    """Ten rounds."""
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    found = graph.components(spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long"))
    assert found.where("component = 0").count() == found.count() == 2999
