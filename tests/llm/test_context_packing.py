"""What the language model shuffles: few rows with many keys each, whole whatever the flushes and cuts."""

import numpy as np
import pyarrow as pa
import pytest

from lumenstep.llm import context_tree as T


@pytest.mark.parametrize("flush, longest", [(T.FLUSH, T.LONGEST), (3_000, 7), (50, 100)])
def test_partial_counts_are_rows_of_many_keys(monkeypatch, flush, longest):
    monkeypatch.setattr(T, "FLUSH", flush)
    monkeypatch.setattr(T, "LONGEST", longest)
    rng = np.random.default_rng(3)
    texts = [None, "", "Ab ab"] + ["".join(map(chr, rng.integers(97, 123, 2_000))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))]), pa.array(texts)], names=["doc_id", "text"])
    out = list(T._count(iter([batch]), 6))
    if flush == T.FLUSH and longest == 100_000:
        assert sum(b.num_rows for b in out) <= 2 * T.BUCKETS < 100_000 < sum(T._sizes(b, "key0").sum() for b in out)
    got = {}
    for b in out:
        token = np.repeat(b.column("bucket").to_numpy() >= T.BUCKETS, T._sizes(b, "key0"))
        assert (T._sizes(b, "key0") <= longest).all()
        for k, n, t in zip(T._joined(b, T._KEY), T._joined(b, T._N), token):
            got[bool(t), int(k)] = got.get((bool(t), int(k)), 0) + int(n)
    want = {}
    for i, text in zip(batch.column(0).to_pylist(), texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        words, _, grams, _ = T._keys(data, np.array([0, len(data)]), 6)
        for token, keys in ((True, words), (False, grams)):
            for k in keys.tolist() if not (token and T.held_out(i)) else []:
                want[token, k] = want.get((token, k), 0) + (not T.held_out(i))
    assert got == want


def test_groups_are_cut_between_buckets(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 5)
    sizes = {0: 2, 1: 9, 2: 1, 3: 30, 4: 3}
    rows = [(b, [b * 100 + i]) for b, n in sizes.items() for i in range(n)]
    make = lambda part: T._batch(T._COUNTS, len(part), bucket=np.array([b for b, _ in part], np.int32), keys=pa.array([k for _, k in part]))
    found = list(T._groups(iter([make(rows[i : i + 4]) for i in range(0, len(rows), 4)]), "keys"))
    assert [k for g in found for k in T._flat(g, "keys").tolist()] == [k for _, (k,) in rows]
    seen = [set(g.column("bucket").to_pylist()) for g in found]
    assert len(seen) > 2 and sum(map(len, seen)) == len(sizes)
