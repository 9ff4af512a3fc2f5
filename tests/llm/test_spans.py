"""Walks over span arrays against plain loops, and many spans in one text."""

import random

from pyspark.sql import functions as F

from lumenstep.llm import pii, secrets, spans


def test_untouched_and_best_of_runs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        span = lambda: (lambda a: (a, a + rng.randint(1, 9)))(rng.randint(0, 900))
        rows.append((i, [span() for _ in range(rng.choice([0, 3, 300]))], [span() for _ in range(rng.choice([0, 2, 40]))]))
    frame = spark.createDataFrame(rows, "i int, own array<struct<start:int,end:int>>, by array<struct<start:int,end:int>>")
    got = {r.i: sorted(map(tuple, r.u)) for r in frame.select("i", spans.untouched(F.col("own"), F.col("by")).alias("u")).collect()}
    assert got == {i: sorted(o for o in own if not any(o[0] < b[1] and b[0] < o[1] for b in by)) for i, own, by in rows}
    scored = F.transform("own", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("kind"), (x["end"] - x["start"]).cast("double").alias("margin")))
    for r in frame.select("own", spans.best_of_runs(scored).alias("b")).collect():
        want, best = [], None
        for s, e in sorted(map(tuple, r.own)):
            if best and s < best[1]:
                best = (s, e) if e - s > best[1] - best[0] else best
            else:
                want, best = want + [best] if best else want, (s, e)
        assert [(x.start, x.end) for x in r.b] == want + ([best] if best else [])


def test_thousands_of_spans_in_one_text(spark):
    text = " ".join(f"a{i}@bc.de token=abcdef{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, None), (1, text)], "doc_id long, text string")
    assert sorted(r.n_email for r in pii.digest(docs).collect()) == [0, 3000, 3000]
    assert sorted(r.n_assign for r in secrets.digest(docs).collect()) == [0, 3000, 3000]


def test_thresholds_come_from_held_out_documents():
    """Trees see base spans only with feature 0; held out, half of what looks the same is none."""
    yes, no = (True,) + (False,) * 12, (False,) * 13
    f = lambda x: tuple(x[:12]) + (True,)
    model = pii.estimated([(3, f(yes), 100, 0), (3, f(no), 0, 50)], [(3, f(yes), 50, 0)])
    assert 3 in model.thresholds and model.off == "email,ip,card"
    contrary = tuple(i in (0, 1, 12) for i in range(13))
    assert 3 not in pii.estimated([(3, f(yes), 100, 0)], [(3, f(yes), 1, 0), (3, contrary, 0, 90)], min_precision=1.1).thresholds
