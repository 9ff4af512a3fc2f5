"""Depth of the language model: the registered query on held-out texts, six bytes of context against a direct version."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenstep.llm import queries
from lumenstep.llm.context_tree import scored


def test_held_out_texts_beat_the_base_score(spark):
    rows = [r for r in queries.op8_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    size = {r.doc_id: r.n for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    for r in rows:
        assert r.n_bytes == size[r.doc_id] and math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (r.n_bytes + 1))
    assert sum(r.bits_per_byte * (r.n_bytes + 1) for r in rows) < 4 * sum(r.n_bytes for r in rows)


def direct(docs, depth):
    stream = lambda t: b"\0" * depth + t.encode() + b"\0"
    counts, kids = Counter(), {}
    steps = lambda s: [(i, (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1) for i in range(depth, len(s)) for k in range(8)]
    for i, t in docs:
        s = stream(t)
        for j, u, bit in steps(s) if zlib.crc32(str(i).encode()) % 10 else []:
            for d in range(depth + 1):
                counts[u, s[j - d : j], bit] += 1
    nodes = {x[:2] for x in counts}
    for u, c in nodes:
        kids.setdefault((u, c[1:]), []).append((u, c)) if c else None
    log, memo = math.lgamma, {}

    def weigh(x):
        if x not in memo:
            a, b = counts[(*x, 0)], counts[(*x, 1)]
            own = log(a + 0.5) + log(b + 0.5) - 2 * log(0.5) - log(a + b + 1)
            below = own if len(x[1]) == depth else sum(weigh(y)[0] for y in kids[x])
            stay = 1.0 if len(x[1]) == depth else 1 / (1 + math.exp(min(700, below - own)))
            memo[x] = (max(own, below) + math.log((1 + math.exp(-abs(own - below))) / 2), stay)
        return memo[x]

    def one(u, s, j, d=0):
        x = (u, s[j - d : j])
        if x not in nodes:
            return 0.5
        a, b = counts[(*x, 0)], counts[(*x, 1)]
        stay = weigh(x)[1]
        return stay * (b + 0.5) / (a + b + 1) + ((1 - stay) * one(u, s, j, d + 1) if d < depth else 0)

    chance = lambda u, bit, s, j: one(u, s, j) if bit else 1 - one(u, s, j)
    return {i: sum(math.log10(chance(u, bit, stream(t), j)) for j, u, bit in steps(stream(t))) for i, t in docs}


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_any_depth_agrees_with_direct(spark, depth):
    docs = [(i, f"{w} the other {w} word ü{i % 4}") for i, w in enumerate(["abc", "context", "contest", "y"] * 8)]
    want = direct(docs, depth)
    for options in ({}, {"max_tokens": 2, "max_grams": 5}):
        got = {r.doc_id: r.score for r in scored(spark.createDataFrame(docs, "doc_id long, text string"), depth=depth, **options).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_depth_is_bounded_by_the_key(spark):
    with pytest.raises(ValueError):
        scored(spark.createDataFrame([(1, "a")], "doc_id long, text string"), depth=7)
