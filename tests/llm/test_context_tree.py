"""The language model against a direct, recursive one."""

import math
import re
import zlib
from collections import Counter

from lumenstep.llm.context_tree import scored

DOCS = [(i, t) for i, t in enumerate(["abc abd", "", None, "Zwei Wörter wörter", "aaaa " * 30, "The the THE\tend\n", "q", "abc abd abc", "Neu und unbekannt", "xyz " * 5] * 3)]


def direct(docs):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    stream = lambda t: b"\0\0\0" + low(t).encode() + b"\0"
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in words(t))
    total, v = sum(c.values()), len(c)
    counts = Counter()
    for t in train:
        s = stream(t)
        for i in range(3, len(s)):
            for k in range(8):
                u, bit = (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1
                for d in range(4):
                    counts[u, s[i - d : i], bit] += 1
    nodes = {(u, ctx) for u, ctx, _ in counts}
    kids = {}
    for u, ctx in nodes:
        if ctx:
            kids.setdefault((u, ctx[1:]), []).append((u, ctx))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weigh(x):
        if x not in memo:
            own = kt(counts[(*x, 0)], counts[(*x, 1)])
            if len(x[1]) == 3:
                memo[x] = (own, 1.0)
            else:
                below = sum(weigh(y)[0] for y in kids.get(x, []))
                hi = max(own, below)
                memo[x] = (hi + math.log((math.exp(own - hi) + math.exp(below - hi)) / 2), 1 / (1 + math.exp(min(700, below - own))))
        return memo[x]

    def one(u, s, i, d=0):
        x = (u, s[i - d : i])
        if x not in nodes:
            return 0.5
        a, b = counts[(*x, 0)], counts[(*x, 1)]
        own = (b + 0.5) / (a + b + 1)
        stay = weigh(x)[1]
        return own if d == 3 else stay * own + (1 - stay) * one(u, s, i, d + 1)

    out = {}
    for i, t in docs:
        s, total_log = stream(t), 0.0
        for j in range(3, len(s)):
            for k in range(8):
                p = one((1 << k) | (s[j] >> (8 - k)), s, j)
                total_log += math.log10(p if (s[j] >> (7 - k)) & 1 else 1 - p)
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), total, base, total_log)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got[i][4:], want[i][4:])), (i, got[i], want[i])


def run(spark, **options):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string")
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored(frame, **options).collect()}


def test_lookup_and_join_agree_with_direct(spark):
    want = direct(DOCS)
    close(run(spark), want)
    close(run(spark, max_tokens=3, max_grams=3), want)


def test_empty_and_repeats(spark):
    assert scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a")], "doc_id long, text string")
    got = scored(rows).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (1, 2), (1, 3), (1, 3)]
