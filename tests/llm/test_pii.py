"""Base spans against Python's re, added spans on a planted fixture."""

import hashlib
import random
import re

from lumenstep.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE]


def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "x..y%@c-d.e.f_g@h.i", "@", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0255.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "4111  1111", "+1 (679) 555-1339", "+12.", "+1 22 333 4444 5", "++49-30-123456-7", "é", "😀", "\n", " ", ",", "12 34", "٣٤٥٦", "9" * 25]
    return [None, "", "a" * 30000 + "@" + ".a" * 9000, "1" * 30000, *["".join(rng.choice(bits) + rng.choice(["", " ", "é "]) for _ in range(rng.randint(1, 12))) for _ in range(300)]]


def test_base_is_exact(spark):
    rows = list(enumerate(texts()))
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string"), pii.Boosted()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id][1])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(w) for w in want], rows[r.doc_id]
        flat = sorted((s, k, e) for k, w in enumerate(want) for s, e in w)
        line = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in flat)
        assert r.spans == line and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_added_spans_and_redaction(spark):
    rows = [(i, f"call me, phone +1 (679) 555-{1000 + i} soon", "x") for i in range(80)]
    rows += [(100, "my phone (679) 555-0142 works", "x"), (101, "on 12-05-2020 we met", "x"), (102, None, "x"), (103, "order no 55 123 99 1", "x"), (103, "order no 55 123 99 1", "x")]
    rows += [(200 + i, f"invoice 12 34 {i + 10} paid", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.digest(docs, model).collect()}
    assert got[100].n_added == 1 and got[100].n_phone == 0 and got[100].spans == "phone:9:23"
    assert got[101].n_added == got[103].n_added == got[200].n_added == 0
    out = pii.redacted(docs, model)
    assert out.columns == docs.columns and out.first().base == "x"
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[100] == "my phone [PHONE] works" and text[0] == "call me, phone [PHONE] soon" and text[102] is None
    assert pii.digest(docs.limit(0)).count() == 0
