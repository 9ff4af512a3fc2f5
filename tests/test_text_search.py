"""The search of text bounds, switches, token scores, histories and nested values on tables small enough to check by hand."""

import pytest

from lumenstep.functions.text import TextFeatures, chunks
from lumenstep.operators import search
from lumenstep.operators.models import StepClassifier
from lumenstep.sources import tables

PAIRS = [("good day", "y"), ("good sun", "y"), ("bad day", "n"), ("bad rain", "n")]


def test_search_finds_the_bounds_that_let_words_count(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS * 10)], "id int, text string, label string")
    tuned = search.TextSearch(TextFeatures("text", drop_stop_words=False), n_trials=6, spaces={"min_word": [0.1, 0.9], "max_word": 1.1, "min_ngram": 0.0, "max_ngram": 1.0})
    best = tuned.optimise(df, df, "label", id_columns=("id",))
    # without words only the length tells: seven characters are "n", of three texts of eight one is wrong
    assert {p["min_word"]: round(v, 3) for p, v in tuned.history} == {0.1: 1.0, 0.9: 0.733}
    assert best["min_word"] == 0.1 and set(tuned.features.maps[1]) == {"good", "bad", "day", "sun", "rain"}


def test_switches_leave_columns_out(spark):
    df = spark.createDataFrame([(1, "See http://a.b It's 7"), (2, None)], "id int, text string")
    off = dict.fromkeys(("uppercase", "punctuation", "emojis", "numbers", "sentiment"), False)
    out = TextFeatures("text", drop_stop_words=False, **off).transform(df)
    assert out.columns == ["id", "nlp_urls", "nlp_char", "nlp_words", "nlp_avg_word_len"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 1, 10, 2, 5.0), (2, 0, 0, 0, 0.0)]
    kept = TextFeatures("text", drop_stop_words=False, urls=False, **off).transform(df)
    assert kept.columns == ["id", "nlp_char", "nlp_words", "nlp_avg_word_len"] and kept.orderBy("id").first().nlp_words == 5


def test_token_scores_with_bigrams(spark):
    learned = spark.createDataFrame([(t, int(y == "y")) for t, y in PAIRS], "text string, y int")
    features = TextFeatures("text", n=2, drop_stop_words=False).fit(learned, "y", min_word=0.0, max_word=1.1, min_ngram=0.0, max_ngram=1.1)
    rows = features.map_scores(spark.createDataFrame([("Good sun good",), ("bad",), (None,)], "text string")).collect()
    got = [[(x.token, x.score) for x in r.token_scores] for r in rows]
    assert got == [[("good sun", 0.5), ("sun good", 0.0), ("good", 0.0), ("sun", 0.0), ("good", 0.5)], [("bad", -0.5)], []]


def test_history_keeps_the_last_of_each_name(spark, tmp_path):
    history = tables.MetricHistory(spark, str(tmp_path / "h"))
    for i in range(4):
        history.add("fit", {"auc": i / 10})
    history.add("scan", {"seconds": 2})
    assert sorted((r.name, *r.metrics.values()) for r in history.latest(2).collect()) == [("fit", 0.2), ("fit", 0.3), ("scan", 2.0)]


def test_nested_values_and_records(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, [1.0, nan], {"k": inf}, (2.0, "x")), (2, None, None, None)], "id int, a array<double>, m map<string,double>, s struct<v: double, w: string>")
    assert [r.record for r in tables.records(df).orderBy("id").collect()] == ['{"id":1,"a":[1.0,null],"m":{"k":null},"s":{"v":2.0,"w":"x"}}', '{"id":2}']
    lists = spark.createDataFrame([(1, '[{"k":1},{"k":2}]'), (2, "[]"), (3, None)], "id int, body string")
    assert sorted((r.id, r.k) for r in tables.unnested(lists, "body", "k int").collect() if r.k) == [(1, 1), (1, 2)]
    assert tables.unnested(lists, "body", "k int").count() == 4
    arrays = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "v array<int>")
    assert [r[0] for r in arrays.select(chunks(arrays.v, 2)).collect()] == [[[1, 2], [3]], [], None]


def test_nested_profile(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 2, "c") for i in range(40)], "x int, k string, y int, same string")
    model = StepClassifier(calibrate=False).fit(df, "y")
    out = model.nested_profile()
    assert {n["category"] for n in out["categorical"]["k"]} >= {"a", "b"} and set(out["numeric"]) == {"x"}
    assert sum(n["freq"] for n in out["categorical"]["k"]) == pytest.approx(1.0)
