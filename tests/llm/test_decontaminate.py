"""Decontamination against brute force."""

import hashlib
import random
import re

from lumenstep.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = [(i, {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}) for i, t in items if (w := words(t))]
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for i, win in wins:
            for g in win:
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit |= set(range(j, j + len(g)))
                        got.add(str(i))
        line = ",".join(sorted(got))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(line.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(8)
    v = ["a", "B", "été", "É", "x1", "O'Neil", "ça", "d"]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30])] + [(50, None), (51, ""), (52, "a'b\\"), (7, "same id twice a b c d e f g h")]
    items = [(i, t if i > 2 or t is None else f"rare{i} " + t) for i, t in items]
    docs = [(i, text(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "") + "." + text(rng.randint(0, 9))) for i in range(120)]
    return docs + [(200, None), (201, ""), (202, "..."), (None, items[6][1]), (203, items[7][1]), (203, items[7][1]), (204, " ".join([items[7][1]] * 300))], items


def test_digest(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for options in ({}, {"max_windows": 7}):
        assert sorted(map(tuple, D.digest(d, b, **options).collect()), key=str) == want
    assert all(r.n_hit == 0 for r in D.digest(d, b.limit(0)).collect())
    assert D.digest(d.limit(0), b).count() == 0


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before {item.upper()}, after!", "w"), (2, "clean. text", "v"), (3, None, None)], "doc_id long, text string, bench_hits string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in D.decontaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert [r.text for r in D.decontaminated(docs, bench, remove="spans").orderBy("doc_id").collect()] == ["before after", "clean. text", None]


def test_full_bitmap_and_joined_windows_change_nothing(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "MIN_BITS", 64)
    monkeypatch.setattr(D, "MAX_BITS", 64)
    monkeypatch.setattr(D, "MAX_DIRTY", 0)
    assert sorted(map(tuple, D.digest(d, b, max_windows=0).collect()), key=str) == brute(docs, items)


def test_names_of_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (None, "", "y", 6)], "doc_id long, text string, _words string, _c0 long")
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert D.decontaminated(docs, bench).collect() == docs.where("doc_id is null").collect()
    assert sorted(D.decontaminated(docs, bench, remove="spans").collect(), key=str) == sorted([(1, "a c", "x", 5), (None, "", "y", 6)], key=str)
