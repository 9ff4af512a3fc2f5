"""Near words, forms and roots against brute force; each neighbour is made once."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from lumenstep.llm import spelling


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def around(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + k :] for c in alphabet for k in (0, 1) for i in range(len(word) + 1 - k)}
    return out - {word}


def brute_variants(words):
    alphabet = set("".join(words))
    out = {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in around(w, alphabet) & set(words))
        form = near[0][1] if near and words[near[0][1]] >= 2 * n else None
        out[w] = [n, len(near), form, words[form] if form else None, w]
    for w, row in out.items():
        while out[row[4]][2]:
            row[4] = out[row[4]][2]
    return {w: tuple(r) for w, r in out.items()}


def test_each_neighbour_once():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint64)
    words = ["aabba", "abc", "a", "éébac" * 40]
    made = {w: [] for w in words}
    for keys, word, at, drop, code in spelling.neighbours(words, alphabet):
        for k, w, a, d, c in zip(keys.tolist(), word.tolist(), at.tolist(), drop.tolist(), code.tolist()):
            text = words[w][:a] + (chr(c) if c else "") + words[w][a + d :]
            made[words[w]].append(text)
            assert k == spelling.Letters([text]).keys()[0]
    for w in words:
        assert len(made[w]) == len(set(made[w])) and set(made[w]) == around(w, "abcé")


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeàé") for _ in range(rng.randint(5, 7))) for _ in range(30)]
    words = {}
    for w in base:
        words[w] = rng.randint(100, 120)
        for _ in range(25):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(v))
                v[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("abcdeàé")])
            words.setdefault("".join(v) or "x", rng.choice([3, 5, 10, 20, 40, 50]))
    words |= {"z" * 3000: 50, "z" * 2999: 10, "z" * 1500 + "a" + "z" * 1499: 25}
    vocab = spark.createDataFrame([(w, n, 1, "k") for w, n in words.items()], "word string, n long, form int, key string").repartition(3)
    want = brute_variants({w: n for w, n in words.items() if len(w) < 100})
    long = {"z" * 3000: (50, 2, None, None, "z" * 3000), "z" * 2999: (10, 2, "z" * 3000, 50, "z" * 3000), "z" * 1500 + "a" + "z" * 1499: (25, 2, "z" * 3000, 50, "z" * 3000)}
    for positions in (spelling.POSITIONS, 37):
        monkeypatch.setattr(spelling, "POSITIONS", positions)
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(vocab).collect()}
        assert got == want | long


def test_equal_keys_are_told_apart_by_text(spark, monkeypatch):
    monkeypatch.setattr(spelling, "mix", lambda x: x & np.uint64(7))
    words = {"hello": 40, "hallo": 10, "house": 20, "hose": 4, "horse": 5, "zzzzz": 3}
    vocab = spark.createDataFrame(list(words.items()), "word string, n long").coalesce(1)
    keys = spelling.Letters(list(words)).keys()
    assert len(set(keys.tolist())) < len(words)
    assert {(r.word, r.near) for r in spelling.near_words(vocab).collect()} == {("hello", "hallo"), ("hallo", "hello"), ("house", "hose"), ("hose", "house"), ("horse", "hose"), ("hose", "horse"), ("house", "horse"), ("horse", "house")}


def test_words_of_odd_documents(spark):
    rows = [(i % 900, "Straße ÉCOLE École don't naïve×word " + "KelvinK abcde ABCDE") for i in range(3000)]
    rows += [(None, "nulls again nulls nulls"), (1, None), (2, ""), (3, "lonely"), (4, "twice twice"), (5, "y" * 200_000), (6, "y" * 200_000), (7, "y" * 200_000)]
    frame = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.vocabulary(spelling.slipped(frame)).collect()}
    assert got == brute_words(rows)
    assert "nulls" in got and "lonely" not in got and "twice" not in got
    assert spelling.variants(spelling.vocabulary(spelling.slipped(frame.limit(0)))).count() == 0
