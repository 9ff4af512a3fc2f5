"""Near-duplicates against brute force."""

import random
import re

from lumenstep.llm.near_dedup import near_duplicates


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    ids, found = [i for i, _ in rows], {i: sets(t) for i, t in rows}
    comp = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and found[a] and found[b] and 100 * len(found[a] & found[b]) >= 75 * len(found[a] | found[b])]
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(found[i]), comp[i], comp[i] == i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeXYé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    rows, n = [(100, None), (101, ""), (102, " \n "), (103, "One two"), (104, "one\ttwo"), (105, "x " * 4000)], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 12, 60, 200]))]
        if rng.random() < 0.4:
            base[2:2] = passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_chain_and_hot_copies(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(30)] + [(1000 + i, "same old text of seven words here") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_empty_and_nulls(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(frame).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in near_duplicates(frame).collect() if r.doc_id is not None) == [(False, 1, True)] * 2


def test_hot_pairs_in_parts_and_clashing_names(spark, monkeypatch):
    from lumenstep.llm import near_dedup as N

    monkeypatch.setattr(N, "HOT_PAIRS", 2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(30)] + [(99, "a b \x00 c d e f"), (98, "a b \x00 c d e f")]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, _gone string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame).collect()}
    assert got == brute(rows)
    out = N.deduplicated(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, x in got.items() if x[2])


def test_estimates_stay_short(spark):
    """Texts whose links form a path numbered at random, in both solutions of the components."""
    words, ids = [f"w{i}" for i in range(300)], list(range(24))
    random.Random(4).shuffle(ids)
    rows = [(i, " ".join(words[8 * k : 8 * k + 100])) for k, i in enumerate(ids)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute(rows)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200
