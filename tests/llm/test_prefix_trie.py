"""The trie against brute force over many tasks and runs; merging compares little."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lumenstep.llm import prefix_trie


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(x)] for c, x in convs.items()}
    nodes = defaultdict(lambda: [[], []])
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = convs.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])][0].append(c)
        nodes[tuple(path)][1].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(nodes[p][0]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = hashlib.sha256(",".join(map(str, sorted(nodes[p][1]))).encode()).hexdigest()
        out.append((min(nodes[p][0]), len(p), min(nodes[p[:-1]][0]) if p else None, len(nodes[p][0]), len(kids[p]), leaves[p], saved[p], ends))
    return sorted(out, key=str)


def made():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 400), *range(-9, 0), 10**15, 2**53 + 1, 2**53 + 3]:
        hot = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = ["user", "assistant"][t % 2]
            text = "hello" if hot and t < 3 else rng.choice(["a", "bé", "", "yes", f"own {c}"])
            rows.append((c, t, role, text))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1300) for t in range(12)]
    rows += [(2000, t, "user", "long " + str(t % 7)) for t in range(1200)] + [(2001, t, "user", "long " + str(t % 7)) for t in range(1100)]
    rows += [(3000, None, None, "x"), (3000, 0, "user", None), (3000, 0, "user", None), (3000, -300, "a", "b"), (None, 0, "user", "nobody"), (3002, 5, "user", "only")]
    return rows


@pytest.mark.parametrize("partitions,run", [("1", 2048), ("7", 5), ("40", 3)])
def test_equals_brute_force(spark, monkeypatch, partitions, run):
    rows = made()
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, symbols int").repartition(5)
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(4, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    trie = lambda f: prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(f)))
    assert trie(frame.limit(0)).count() == 0
    assert sorted(map(tuple, trie(frame).collect()), key=str) == brute([(4, 0, "user", "a")])


def test_merge_gives_order_and_common_prefixes(monkeypatch):
    rng = random.Random(3)
    words = {bytes(rng.choice([1, 2]) for _ in range(rng.randint(0, 30))) for _ in range(500)}
    symbols = [b"".join(bytes([x] * prefix_trie.SYMBOL) for x in w) for w in words]
    rows = [(s, i) for i, s in enumerate(symbols)]
    runs = [prefix_trie.Run(rows[lo : lo + 13]) for lo in range(0, len(rows), 13)]
    looked = []
    real = prefix_trie.common
    monkeypatch.setattr(prefix_trie, "common", lambda a, b, known=0: looked.append(real(a, b, known) - known) or real(a, b, known))
    out = list(prefix_trie.merged(runs))
    assert [r for _, r in out] == sorted(rows)
    assert [lcp for lcp, _ in out] == [0, *(real(a[0], b[0]) for a, b in zip(sorted(rows), sorted(rows)[1:]))]
    # each symbol of a row is compared once at most beyond the ties of equal prefixes
    assert sum(looked) <= sum(len(s) // prefix_trie.SYMBOL for s in symbols)
    assert list(prefix_trie.merged([])) == []
