"""Queries on encodings, metrics by name, correlation graphs, text scores and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenstep.functions import text as X
from lumenstep.operators import metrics, quality, ranks, rules, search, stats
from lumenstep.operators.models import StepClassifier
from lumenstep.operators.written import shared_dir
from lumenstep.plans._registry import query
from lumenstep.plans.modelling import _CONFUSION, _LEVERS, _PROFILE, _SPLITS, _docs_model, _levers, _scored, priced, r, returned
from lumenstep.sources import tables
from lumenstep.streaming.scoring import LiveStats

# --- encodings and nodes ---


@query("select l_orderkey, l_linenumber, (l_linestatus = 'O')::int as code from lineitem")
def label_encode_target(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    out, _ = stats.encode_target(rows, "l_linestatus", "code")
    return out.select("l_orderkey", "l_linenumber", F.col("code").cast("int").alias("code"))


@query(_SPLITS + "select split, lc::bigint as below from c")
def numeric_candidates(t):
    s = stats.collect(returned(t), "y", ["l_quantity"], [])[()]
    split, count, _ = stats.candidates(s.features["l_quantity"], 0.1)
    return t.spark.createDataFrame([(float(x), int(c)) for x, c in zip(split, count)], "split double, below long")


_DEAR = "select o_orderkey, nullif(o_orderpriority, '5-LOW') as v, (o_totalprice > 150000)::int::double as y from orders join customer on o_custkey = c_custkey"


def _dear(t):
    v = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return priced(t).select("o_orderkey", v.alias("v"), (F.col("o_totalprice") > 150000).cast("int").alias("y"))


@query(f"select round(avg(y) filter (v is null), 6) as mean, round(count(*) filter (v is null)::double / count(*), 6) as freq from ({_DEAR})")
def mixed_null_node(t):
    model = StepClassifier(calibrate=False).fit(_dear(t), "y", ["v"])
    return model.profile_frame(t.spark).where("is_null").select(r("mean").alias("mean"), r("freq").alias("freq"))


@query(
    f"with b as ({_DEAR}), k as (select * from b where v is not null), g as (select count(*)::double as n, avg(y) as bv from k), "
    "x as (select v, count(*) / min(n) * (avg(y) - min(bv)) as r from k cross join g group by v), "
    "e as (select least(min(r), 0) as lo, greatest(max(r), 0) as hi from x), "
    "s as (select v, case when r = 0 then 0.0::double when r < 0 then abs(r) / lo * bv else r / hi * (1 - bv) end as s from x cross join e cross join g) "
    "select o_orderkey, round(bv + coalesce(s, 0), 6) as score from b cross join g left join s on b.v = s.v"
)
def unseen_fallback(t):
    """Categories and nulls that the fit never saw score as a null node without rows."""
    model = StepClassifier(calibrate=False).fit(_dear(t).where("v is not null"), "y", ["v"])
    return model.score(_dear(t)).select("o_orderkey", r("score").alias("score"))


@query(_PROFILE + "select f as feature, round(min(s), 6) as lowest, round(max(s), 6) as highest from norm group by f")
def best_partition(t):
    model, _ = _docs_model(t)
    low, high = (rules.best_scores(model.profile, ["lang", "source"], largest) for largest in (False, True))
    return t.spark.createDataFrame([(k, low[k], high[k]) for k in low], "feature string, lowest double, highest double").withColumns({c: r(c) for c in ("lowest", "highest")})


@query(
    _LEVERS
    + ", z as (select *, sum(cost) over (order by roi desc, doc_id rows unbounded preceding) as upto from y), q as (select b.budget, sum(cost) as spent, sum(expected_value) as value from z join (select unnest([100.0, 250.0, 500.0])::double as budget) b on upto <= b.budget group by b.budget) "
    "select budget, round(value / spent, 6) as roi, round((value - coalesce(lag(value) over (order by budget), 0)) / nullif(spent - coalesce(lag(spent) over (order by budget), 0), 0), 6) as marginal_roi from q"
)
def marginal_roi(t):
    return rules.budget_tiers(_levers(t), [100.0, 250.0, 500.0], "doc_id").select("budget", r("roi").alias("roi"), r("marginal_roi").alias("marginal_roi"))


# --- metrics ---


@query(
    _CONFUSION
    + ", k as (select *, tp + fp + tn + fn as n from c), x as (select *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::double / (n * n) as chance from k) "
    "select round(((tp + tn)::double / n - chance) / (1 - chance), 6) as kappa, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc from x"
)
def kappa_mcc(t):
    c = metrics.counts(_scored(t), "y", F.col("s") > 0.5)
    return t.spark.createDataFrame([(metrics.kappa(**c), metrics.mcc(**c))], "kappa double, mcc double").withColumns({c: r(c) for c in ("kappa", "mcc")})


@query(
    _CONFUSION
    + ", q as (select tp as hit, fp as wrong, fn as missed, 'positive' as k from c union all select tn, fn, fp, 'negative' from c), "
    "m as (select k, hit + missed as n, coalesce(hit / nullif(hit + wrong, 0)::double, 0) as p, coalesce(hit / nullif(hit + missed, 0)::double, 0) as q, coalesce(2 * hit / nullif(2 * hit + wrong + missed, 0)::double, 0) as f from q) "
    "select k || '-f1' as metric, round(f, 6) as value from m union all select k || '-precision', round(p, 6) from m union all select k || '-recall', round(q, 6) from m "
    "union all select 'macro-f1', round(avg(f), 6) from m union all select 'weighted-f1', round(sum(f * n) / sum(n), 6) from m "
    "union all select 'accuracy', round((tp + tn) / (tp + fp + tn + fn)::double, 6) from c"
)
def search_metrics(t):
    scored = _scored(t).cache()
    names = [f"{k}-{s}" for k in ("positive", "negative") for s in ("f1", "precision", "recall")] + ["macro-f1", "weighted-f1", "accuracy"]
    rows = [(n, float(metrics.named(scored, n, "y", "s"))) for n in names]
    scored.unpersist()
    return t.spark.createDataFrame(rows, "metric string, value double").withColumn("value", r("value"))


_GUESS = "(o_totalprice * 0.5 + 1000 * month(o_orderdate))"


@query(
    f"with p as (select o_totalprice as y, {_GUESS} as p from orders), g as (select min(p) as lo, (max(p) - min(p)) / 100 as w from p) "
    "select bin, count(*) as n, round(sum(y), 2) as total_true, round(sum(p), 3) as total_pred from (select *, floor((p - lo) / w)::int + 1 as bin from p cross join g) where bin between 1 and 100 group by bin"
)
def reg_bins(t):
    """Means times counts: whole cents and half cents, where means may lie on a rounding tie."""
    rows = t.orders.withColumn("p", F.expr(_GUESS))
    return metrics.regression_bins(rows, "o_totalprice", "p").select("bin", "n", *[r(F.col(f"mean_{c}") * F.col("n"), d).alias(f"total_{c}") for c, d in (("true", 2), ("pred", 3))])


@query(f"select c_mktsegment, count(*) as n, round(avg(abs(o_totalprice - {_GUESS})), 4) as mae from orders join customer on o_custkey = c_custkey group by c_mktsegment")
def mae_per_partition(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("o_totalprice") - F.expr(_GUESS))), 4).alias("mae"))


# --- correlation graph and quality ---

_MEASURES = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as c from lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :])


def _edges(t, least: float):
    found = search.correlations(t.lineitem, _MEASURES)
    pairs = {tuple(sorted(k)): float(v) for k, v in found.items() if k[0] != k[1]}
    return t.spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items() if abs(c) >= least], "a string, b string, c double")


@query(f"select a, b, round(c, 6) as c from ({_PAIRS}) where abs(c) >= 0.002")
def corr_edges(t):
    return _edges(t, 0.002).withColumn("c", r("c"))


@query(f"with e as (select a, b from ({_PAIRS}) where abs(c) >= 0.002) select node, count(*) as degree from (select a as node from e union all select b from e) group by node")
def node_degree(t):
    return _edges(t, 0.002).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


_CELLS = "c as (select l_quantity as a, l_discount as b, count(*)::double as n from lineitem group by all)"


@query(
    f"with {_CELLS}, p as (select sum(case when (x.a - y.a) * (x.b - y.b) > 0 then x.n * y.n when (x.a - y.a) * (x.b - y.b) < 0 then -x.n * y.n else 0 end) / 2 as s from c x cross join c y), "
    "t as (select sum(n) * (sum(n) - 1) / 2 as k from c), ta as (select sum(n * (n - 1) / 2) as k from (select sum(n) as n from c group by a)), tb as (select sum(n * (n - 1) / 2) as k from (select sum(n) as n from c group by b)) "
    "select round(s / sqrt((t.k - ta.k) * (t.k - tb.k)), 6) as tau from p, t, ta, tb"
)
def corr_kendall(t):
    found = search.correlations(t.lineitem, ["l_quantity", "l_discount"], "kendall")
    return t.spark.createDataFrame([(v,) for v in found.values()], "tau double").select(r("tau").alias("tau"))


@query(
    "select 'status' as \"column\", round(avg((o_orderstatus = 'P')::int::double), 6) as missing_pct from orders union all select 'priority', round(avg((o_orderpriority = '5-LOW')::int::double), 6) from orders"
)
def scan_missing(t):
    o = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return quality.scan(o).select("column", r("missing_pct").alias("missing_pct"))


_LIVE = "select month(o_orderdate)::double as m, o_orderpriority as p, (o_totalprice > 150000)::int::double as y from orders"


@query(f"select 'm' as feature, m as number, null::varchar as text, count(*) as n, sum(y) as s from ({_LIVE}) group by m union all select 'p', null, p, count(*), sum(y) from ({_LIVE}) group by p")
def live_counts(t):
    """Statistics that three micro-batches, one of them run twice, have written."""
    rows = t.orders.select(F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("p"), (F.col("o_totalprice") > 150000).cast("int").alias("y"), "o_orderkey")
    live = LiveStats(f"{shared_dir(t.spark)}/live-{uuid.uuid4().hex}", "y", ["m"], ["p"])
    for batch in (0, 1, 1, 2):
        live.absorb(rows.where(F.pmod("o_orderkey", F.lit(3)) == batch).drop("o_orderkey"), batch)
    return live.counts(t.spark)


_SHARES = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]


@query(" union all ".join(f"select '{c}' as \"column\", {p}::double as share, round(quantile_cont({c}::double, {p}), 6) as value from {t}" for t, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("lineitem", "l_orderkey")) for p in _SHARES))
def exact_quantiles(t):
    """All quantiles of three columns by radix selection."""
    columns = ["l_extendedprice", "l_discount", "l_orderkey"]
    found = ranks.quantiles(t.lineitem, {c: F.col(c) for c in columns}, _SHARES)
    return t.spark.createDataFrame([(c, p, float(x)) for c in columns for p, x in zip(_SHARES, found[c])], "column string, share double, value double").withColumn("value", r("value"))


@query("with p as (select sign(a.c_acctbal - b.c_acctbal) * sign(a.c_custkey % 1009 - b.c_custkey % 1009) as s, a.c_acctbal = b.c_acctbal as ta, a.c_custkey % 1009 = b.c_custkey % 1009 as tb from customer a join customer b on a.c_custkey < b.c_custkey) select round(sum(s) / sqrt(count(*) filter (not ta)::double * count(*) filter (not tb)::double), 6) as tau from p")
def kendall_continuous(t):
    """A column of as many values as rows against one with ties."""
    c = t.customer.select("c_acctbal", (F.col("c_custkey") % 1009).alias("k"))
    return t.spark.createDataFrame([(ranks.kendall(c, "c_acctbal", "k", ranges=40),)], "tau double").select(r("tau").alias("tau"))


# --- text ---

_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '', 'g'), '[^a-zA-Z'']', ' ', 'g'), '''', '', 'g')), '\s+'), lambda x: x <> '')"


@query(
    f"with d as (select doc_id, quality::double as y, {_WORDS} as w from documents natural join labels), g as (select count(*)::double as n, avg(y) as b from d), "
    "m as (select token, avg(y) - min(b) as s, count(*) / min(n) as f from (select y, unnest(list_distinct(w)) as token from d) cross join g group by token), "
    "k as (select doc_id, s from (select doc_id, unnest(w) as token from d) join (select * from m where f > 0.05 and f < 0.7) using (token)) "
    "select doc_id, round(coalesce(sum(s) filter (s > 0), 0), 5) as pos, count(s) filter (s > 0) as pos_count, round(coalesce(sum(s) filter (s < 0), 0), 5) as neg, count(s) filter (s < 0) as neg_count from d left join k using (doc_id) group by doc_id"
)
def sentiment_unigram(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    features = X.TextFeatures("text", drop_stop_words=False).fit(d, "quality", min_word=0.05)
    out = features.transform(d)
    return out.select("doc_id", r("nlp_pos", 5).alias("pos"), F.col("nlp_pos_count").cast("long").alias("pos_count"), r("nlp_neg", 5).alias("neg"), F.col("nlp_neg_count").cast("long").alias("neg_count"))


@query(
    f"""with d as (select doc_id, quality::double as y, {_WORDS} as w from documents natural join labels),
g as (select count(*)::double as n, avg(y) as b from d),
w2 as (select doc_id, y, case when len(w) > 1 then list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) else [] end as p from d),
m1 as (select token, avg(y) - min(b) as s from (select y, unnest(list_distinct(w)) as token from d) cross join g group by token having count(*) / min(n) > 0.02 and count(*) / min(n) < 0.9),
m2 as (select token, avg(y) - min(b) as s from (select y, unnest(list_distinct(p)) as token from w2) cross join g group by token having count(*) / min(n) > 0.02 and count(*) / min(n) < 0.9),
h as (select doc_id, token, place, s, sign(s) as up from (select doc_id, unnest(p) as token, unnest(range(len(p))) as place from w2) join m2 using (token) where s <> 0),
h2 as (select doc_id, up, sum(s) as total, count(*) as n from h group by all),
first as (select doc_id, up, list(token order by place) as grams from (select doc_id, up, token, min(place) as place from h group by all) group by all),
left_over as (select d.doc_id, u.up, list_reduce(coalesce(grams, []), lambda acc, x: replace(acc, ' ' || replace(x, ' ', '  ') || ' ', ' '), ' ' || array_to_string(w, '  ') || ' ') as line
  from d cross join (values (1), (-1)) u(up) left join first f on f.doc_id = d.doc_id and f.up = u.up),
h1 as (select doc_id, up, sum(s) as total, count(*) as n from (select doc_id, up, unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) as token from left_over) join m1 using (token) where sign(s) = up group by all),
either as (select * from h1 union all select * from h2)
select d.doc_id, round(coalesce(sum(total) filter (up > 0), 0), 5) as pos, coalesce(sum(n) filter (up > 0), 0)::bigint as pos_count,
  round(coalesce(sum(total) filter (up < 0), 0), 5) as neg, coalesce(sum(n) filter (up < 0), 0)::bigint as neg_count from d left join either using (doc_id) group by d.doc_id"""
)
def sentiment_bigrams(t):
    """Overlapping and repeated bigrams all count; words that none of them takes count singly."""
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    bounds = {f"{side}_{kind}": v for kind in ("word", "ngram") for side, v in (("min", 0.02), ("max", 0.9))}
    out = X.TextFeatures("text", n=2, drop_stop_words=False).fit(d, "quality", **bounds).transform(d)
    return out.select("doc_id", r("nlp_pos", 5).alias("pos"), F.col("nlp_pos_count").alias("pos_count"), r("nlp_neg", 5).alias("neg"), F.col("nlp_neg_count").alias("neg_count"))


@query(r"select page_id, len(regexp_extract_all(html, 'https?://[^\s]+')) as urls, length(regexp_replace(html, 'https?://[^\s]+', '', 'g')) as rest from pages")
def url_features(t):
    return t.pages.select("page_id", X.urls(F.col("html")).cast("long").alias("urls"), F.length(X.without_urls(F.col("html"))).cast("long").alias("rest"))


@query(
    f"with d as (select doc_id, quality::double as y, {_WORDS} as w from documents natural join labels), g as (select count(*)::double as n, avg(y) as b from d), "
    "m as (select token, avg(y) - min(b) as s, count(*) / min(n) as f from (select y, unnest(list_distinct(w)) as token from d) cross join g group by token), "
    "k as (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from d) "
    "select doc_id, i, token, round(coalesce(s, 0), 5) as score from k left join (select * from m where f > 0.05 and f < 0.7) using (token)"
)
def token_scores(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    features = X.TextFeatures("text", drop_stop_words=False).fit(d, "quality", min_word=0.05)
    out = features.map_scores(d).select("doc_id", F.posexplode("token_scores").alias("i", "x"))
    return out.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "x.token", r("x.score", 5).alias("score"))


@query()
def text_bounds_search(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    tuned = search.TextSearch(X.TextFeatures("text"), n_trials=3, spaces=search.TEXT_SPACES | {"min_word": [0.02, 0.05, 0.1], "max_word": [0.5, 0.7, 0.9]})
    best = tuned.optimise(d.where(~held), d.where(held), "quality", id_columns=("doc_id",))
    return t.spark.createDataFrame([(k, float(v)) for k, v in sorted(best.items())], "bound string, value double")


@query("select o_custkey, list_aggregate(list_transform(range(1, len(k) + 1, 7), lambda i: len(k[i:i + 6])), 'string_agg', ',') as sizes from (select o_custkey, list(o_orderkey) as k from orders group by o_custkey)")
def chunk_lists(t):
    k = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"))
    parts = X.chunks(F.col("k"), 7)
    return k.where(F.flatten(parts) == F.col("k")).select("o_custkey", F.array_join(F.transform(parts, lambda p: F.size(p).cast("string")), ",").alias("sizes"))


@query("select c_custkey, unnest([c_nationkey, c_nationkey + 1]) as nation, unnest(['home', 'next']) as tag from customer")
def nested_records(t):
    one = lambda n, tag: F.struct(n.alias("nation"), F.lit(tag).alias("tag"))
    c = t.customer.select("c_custkey", F.to_json(F.array(one(F.col("c_nationkey"), "home"), one(F.col("c_nationkey") + 1, "next"))).alias("body"))
    return tables.unnested(c, "body", "nation long, tag string")


# --- scalars ---


@query("select p_partkey, split_part(b, '___', 1) as brand, split_part(b, '___', 2) as size from (select p_partkey, p_brand || '___' || p_size as b from part)")
def split_pair(t):
    both = F.split(F.concat_ws("___", "p_brand", F.col("p_size").cast("string")), "___")
    return t.part.select("p_partkey", both[0].alias("brand"), both[1].alias("size"))


@query("select c_custkey, round(pow(abs(d), 0.7) * sign(d), 4) as powered, round(log2(abs(d) + 1), 6) as bits, round(sqrt(abs(d)), 6) as root from (select c_custkey, c_acctbal - 4000 as d from customer)")
def power_and_log(t):
    d = F.col("c_acctbal") - 4000
    return t.customer.select("c_custkey", r(F.pow(F.abs(d), F.lit(0.7)) * F.signum(d), 4).alias("powered"), r(F.log2(F.abs(d) + 1), 6).alias("bits"), r(F.sqrt(F.abs(d)), 6).alias("root"))


@query("select event_type, round(coalesce(sum(v) filter (not isnan(v)), 0), 2) as total, count(*) filter (isnan(v)) as skipped from (select event_type, case when event_id % 7 = 0 then 'nan'::double else value end as v from events) group by event_type")
def nan_skipping_sum(t):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = t.events.select("event_type", v.alias("v"))
    return e.groupBy("event_type").agg(r(F.coalesce(F.sum(F.nanvl("v", F.lit(None).cast("double"))), F.lit(0.0)), 2).alias("total"), F.count_if(F.isnan("v")).alias("skipped"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total, len(embedding) as n from embeddings")
def array_sum(t):
    kept = F.filter(F.transform("embedding", lambda x: x.cast("double")), lambda x: ~F.isnan(x))
    return t.embeddings.select("vec_id", r(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("embedding").cast("long").alias("n"))


@query("select o_orderkey, try_strptime(s, '%d/%m/%Y') as parsed from (select o_orderkey, case when o_orderstatus = 'P' then 'none' else strftime(o_orderdate, '%d/%m/%Y') end as s from orders)")
def parse_day_first(t):
    s = F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", F.try_to_timestamp(s, F.lit("dd/MM/yyyy")).alias("parsed"))


@query("select o_orderkey, ('0x' || substr(md5('3:' || o_orderkey::varchar), 1, 13))::bigint::double / 4503599627370496.0 < 0.25 as held_out from orders")
def train_test_split(t):
    """A quarter is held out by a hash of the key; reruns and other partitionings agree."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("3:"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return t.orders.select("o_orderkey", (u < 0.25).alias("held_out"))


@query("select r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::varchar as record from region")
def json_records(t):
    return t.region.select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("record"))


# --- samples and columns to drop ---

_HASH = "('0x' || substr(md5('7:' || o_orderkey::varchar), 1, 13))::bigint"


@query(f"select o_orderkey from orders where {_HASH} < {int(0.1 * (1 << 52))}")
def sample_fraction(t):
    return search.sample_rows(t.orders, "o_orderkey", fraction=0.1, seed=7).select("o_orderkey")


@query(f"select o_orderkey from orders order by {_HASH}, o_orderkey limit 100")
def sample_count(t):
    return search.sample_rows(t.orders, "o_orderkey", n=100, seed=7).select("o_orderkey")


_ODD = {
    "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "zero": "0", "same": "'x'", "zeros": "case when o_orderkey % 2 = 0 then 0 end",
    "none": "cast(null as double)", "partly": "nullif(o_orderpriority, '5-LOW')",
}
_ODD_COLUMNS = [f"{x} as {c}" for c, x in _ODD.items()]


@query(
    f"with o as (select {', '.join(_ODD_COLUMNS)} from orders) "
    + " union all ".join(
        f"select '{c}' as \"column\" from o having count({c}) = 0 or count(distinct {c}) = 1 and count({c}) = count(*)"
        + (f" or count(*) filter ({c} <> 0) = 0" if c not in ("same", "partly") else "")
        for c in _ODD
    )
)
def uninformative_columns(t):
    odd = t.orders.selectExpr(*_ODD_COLUMNS)
    return t.spark.createDataFrame([(c,) for c in quality.uninformative(odd)], "column string")


@query(
    f"select 'mae' as measure, round(avg(abs(y - p)), 4) as value from (select o_totalprice as y, {_GUESS} as p from orders) "
    f"union all select 'observed_max', max(o_totalprice) from orders union all select 'observed_min', min(o_totalprice) from orders "
    f"union all select 'rmse', round(sqrt(avg((y - p) * (y - p))), 4) from (select o_totalprice as y, {_GUESS} as p from orders)"
)
def regression_bundle(t):
    found = metrics.evaluate_regressor(t.orders.withColumn("p", F.expr(_GUESS)), "o_totalprice", "p")
    return t.spark.createDataFrame([(k, float(found[k])) for k in ("mae", "rmse", "observed_min", "observed_max")], "measure string, value double").withColumn("value", r("value", 4))
