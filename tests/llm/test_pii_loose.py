"""Loose candidates that are many among the base spans; none of them counts as wrong unheard."""

from lumenstep.llm import pii


def test_many_loose_phones_are_added(spark):
    for asked, said in (("call me", "phone"), ("see", "so")):
        rows = [(i, f"{asked}, {said} +1 (679) 555-{1000 + i} soon") for i in range(80)]
        rows += [(100 + i, f"my {said} (679) 555-{2000 + i} works") for i in range(30)]
        rows += [(200 + i, f"invoice 12 34 {i + 10} paid") for i in range(40)] + [(300, "on 12-05-2020 we met")]
        got = {r.doc_id: r.n_added for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[i] == (100 <= i < 130) for i in got), said


def test_a_kind_without_base_spans(spark):
    cards = ["4111.1111.1111.1111", "5500.0000.0000.0004", "4012.8888.8888.1881"]
    rows = [(i, f"pay by card {cards[i % 3]} now") for i in range(30)] + [(100 + i, f"total 4111.1111.1111.11{i} now") for i in range(10, 100)]
    got = {r.doc_id: r.n_added for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 100) for i in got)


def features(**on):
    f = [False] * (pii.CHECKED + 1)
    for i in on.get("at", ()):
        f[i] = True
    return tuple(f)


def test_base_spans_buy_no_room_for_wrong_candidates():
    base, wrong = features(at=(pii.NAMED, 4, pii.CHECKED)), features(at=(1, 3))
    for k in (20, 50, 80, 400):
        model = pii.estimated([(3, base, 800, 0), (3, wrong, 0, k - k // 5)], [(3, base, 200, 0), (3, wrong, 0, k // 5)])
        assert 3 not in model.thresholds or model.margin(wrong) < model.thresholds[3]
        both = pii.estimated([(3, base, 800, 160), (3, wrong, 0, k)], [(3, base, 200, 40), (3, wrong, 0, k)])
        assert model.margin(base) > model.margin(wrong) and both.margin(base) >= both.thresholds[3] > both.margin(wrong)


def test_kinds_without_a_precise_cut_have_a_threshold_above_all_candidates():
    base, weak, wrong = features(at=(pii.NAMED, 4, pii.CHECKED)), features(at=(4, pii.CHECKED)), features(at=(1, 3))
    model = pii.estimated([(3, base, 800, 0), (3, weak, 20, 0), (3, wrong, 0, 90)], [(3, base, 200, 0), (3, wrong, 0, 10)])
    assert model.margin(wrong) < model.thresholds[3] <= model.margin(base) and model.off == "email,ip,card"
    assert not pii.estimated([(3, base, 800, 0), (3, base, 0, 0)], min_precision=1.1).thresholds
    assert not pii.estimated([(3, wrong, 0, 90)]).thresholds
