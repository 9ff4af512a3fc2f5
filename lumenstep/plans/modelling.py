"""Queries that fit, score, explain and evaluate step-function models."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstep.operators import evolution, layers, metrics, quality, rules, search
from lumenstep.operators.models import PartitionedModel, StepClassifier, StepRegressor, surrogate
from lumenstep.operators.params import StepParams
from lumenstep.plans._registry import Tables, query

LEAVES = StepParams(max_depth=4, min_leaf_size=0.01)


def r(c, n=6):
    return F.round(c, n)


def rated(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("int").alias("y"))


def returned(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))


def priced(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_orderpriority", "c_acctbal", F.month("o_orderdate").alias("month"), "o_totalprice")


#: Categorical profile of lang and source against quality; ends on the CTE `norm`.
_PROFILE = """with base as (select d.doc_id, d.lang, d.source, l.quality::double as y from documents d join labels l on d.doc_id = l.doc_id),
g as (select count(*)::double as n, avg(y) as bv from base),
lng as (select doc_id, 'lang' as f, lang as v, y from base union all select doc_id, 'source', source, y from base),
stats as (select f, v, count(*) as c, avg(y) as m from lng group by f, v),
raw as (select f, v, c, m, (c / n) * (m - bv) as r from stats cross join g),
ext as (select sum(mn) as smin, sum(mx) as smax from (select f, least(min(r), 0) as mn, greatest(max(r), 0) as mx from raw group by f)),
norm as (select f, v, c, m, r, case when r = 0 then 0.0::double when r < 0 then abs(r) / smin * bv else r / smax * (1 - bv) end as s from raw cross join ext cross join g),
p as (select lng.doc_id, min(lng.y) as y, round(min(g.bv) + sum(norm.s), 6) as s from lng join norm on lng.f = norm.f and lng.v = norm.v cross join g group by lng.doc_id)
"""


def _docs_model(t: Tables) -> tuple[StepClassifier, DataFrame]:
    d = rated(t)
    return StepClassifier().fit(d, "y", ["lang", "source"]), d


def _scored(t: Tables) -> DataFrame:
    model, d = _docs_model(t)
    return model.score(d).select("doc_id", "y", r("score").alias("s"))


@query(_PROFILE + "select doc_id, s as score from p")
def score_docs_categorical(t):
    return _scored(t).select("doc_id", F.col("s").alias("score"))


@query(_PROFILE + "select f as feature, v as category, round(m, 6) as mean, round(c / n, 6) as freq, round(r, 8) as raw, round(s, 6) as score from norm cross join g")
def profile_categorical(t):
    model, d = _docs_model(t)
    return model.profile_frame(d.sparkSession).where("not is_null").select("feature", "category", r("mean").alias("mean"), r("freq").alias("freq"), r("raw", 8).alias("raw"), r("score").alias("score"))


@query(_PROFILE + "select doc_id, f as feature, round(s, 6) as contribution from lng join norm using (f, v)")
def contributions_long(t):
    model, d = _docs_model(t)
    e = model.explain(d).unpivot(["doc_id"], ["contribution_lang", "contribution_source"], "feature", "c")
    return e.select("doc_id", F.expr("substring(feature, 14)").alias("feature"), r("c").alias("contribution"))


@query(_PROFILE + "select f as feature, round(w / sum(w) over (), 6) as importance from (select f, least(greatest(1 - sum(pow(c / n, 2)), 0), 1) * sum(abs(s)) as w from norm cross join g group by f)")
def feature_importance(t):
    model, d = _docs_model(t)
    return d.sparkSession.createDataFrame(list(model.importances().items()), "feature string, importance double").withColumn("importance", r("importance"))


@query(_PROFILE + "select doc_id, (s > 0.5)::int as prediction from p")
def predict_class(t):
    return _scored(t).select("doc_id", (F.col("s") > 0.5).cast("int").alias("prediction"))


@query(_PROFILE + "select f as feature, v as value, round(s, 6) as contribution, round(c / n, 6) as frequency, round(round(s, 6) * 100, 1) as score_label from norm cross join g")
def plot_data(t):
    model, d = _docs_model(t)
    p = model.plot_data(d.sparkSession).where("value <> 'Null'")
    return p.select("feature", "value", r("contribution").alias("contribution"), r("frequency").alias("frequency"), r(r("contribution") * 100, 1).alias("score_label"))


@query("select lang, (row_number() over (order by avg(quality::double), lang) - 1)::bigint as code from documents natural join labels group by lang")
def encode_rank(t):
    per = rated(t).groupBy("lang").agg(F.avg(F.col("y").cast("double")).alias("m"))
    return per.select("lang", (F.row_number().over(Window.orderBy("m", "lang")) - 1).cast("long").alias("code"))


_CALIBRATION = _PROFILE + """, b as (select greatest(ceil(round(s * 20, 9))::int - 1, 0) as b, y from p where s >= 0 and s <= 1),
ag as (select b, avg(y) as tm, count(*)::double as tc from b group by b),
d as (select x.b, coalesce(tm, 0) as tm, coalesce(tc, 0) as tc from (select unnest(range(0, 20))::int as b) x left join ag on ag.b = x.b),
w as (select b, tm * tc as ts, tc from d),
w3 as (select b, sum(ts) over k as ts, sum(tc) over k as tc from w window k as (order by b rows between 1 preceding and 1 following)),
wp as (select b, case when tc = 0 then 0.0::double else ts / tc end as wp from w3),
k as (select x.k, wp from (select unnest(range(0, 101))::int as k) x join wp on b = least(x.k // 5, 19)),
cal as (select k, round(avg(wp) over (order by k rows between 7 preceding and 7 following), 6) as proba from k)
"""


def _calibration(t: Tables) -> tuple[DataFrame, list[float]]:
    from lumenstep.operators import calibration

    s = _scored(t)
    rows = calibration.bins(s, F.col("s"), F.col("y")).collect()
    return s, [round(x, 6) for x in calibration.smoothed([(x.bin, x.n, x["mean"]) for x in rows])]


@query(_CALIBRATION + "select k::bigint as k, proba from cal")
def calibration_map(t):
    s, table = _calibration(t)
    return s.sparkSession.createDataFrame(list(enumerate(table)), "k long, proba double").withColumn("proba", r("proba"))


@query(_CALIBRATION + "select doc_id, proba from p join cal on k = least(greatest(trunc(s * 100)::int, 0), 100)")
def proba_lookup(t):
    from lumenstep.operators import calibration

    s, table = _calibration(t)
    return s.select("doc_id", r(calibration.probability(F.col("s"), table)).alias("proba"))


_SWEEP = _PROFILE + ", sw as (select t, count(*) filter (y = 1 and s > t / 100.0::double) as tp, count(*) filter (y = 0 and s > t / 100.0::double) as fp, count(*) filter (y = 0 and s <= t / 100.0::double) as tn, count(*) filter (y = 1 and s <= t / 100.0::double) as fn from p, (select unnest(range(0, 101)) as t) group by t)\n"


@query(_SWEEP + "select t::int as threshold_pct, tp, fp, tn, fn from sw")
def threshold_sweep(t):
    return metrics.threshold_sweep(_scored(t), "y", "s")


@query(_SWEEP + ", c as (select t, tp / (tp + fp + 1e-9::double) as p, tp / (tp + fn + 1e-9::double) as q from sw) select round(sum((pq - q) * (p + pp) / 2), 6) as auc_pr from (select p, q, lag(p) over (order by t) as pp, lag(q) over (order by t) as pq from c)")
def pr_auc(t):
    return metrics.pr_auc(metrics.threshold_sweep(_scored(t), "y", "s")).select(r("auc_pr").alias("auc_pr"))


@query(_PROFILE + ", k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as k from p) select round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as roc_auc from k")
def roc_auc(t):
    return metrics.roc_auc(_scored(t), "y", "s").select(r("roc_auc").alias("roc_auc"))


@query(_PROFILE + "select round(avg(pow(y - s, 2)), 6) as brier, round(1 - avg(pow(y - s, 2)), 6) as neg_brier_loss, round(avg(-case when y = 1 then ln(least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) else ln(1 - least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) end), 6) as log_loss from p")
def log_loss_brier(t):
    return metrics.losses(_scored(t), "y", "s").select(*[r(c).alias(c) for c in ("brier", "neg_brier_loss", "log_loss")])


_CONFUSION = _PROFILE + ", c as (select count(*) filter (y = 1 and s > 0.5) as tp, count(*) filter (y = 0 and s > 0.5) as fp, count(*) filter (y = 0 and s <= 0.5) as tn, count(*) filter (y = 1 and s <= 0.5) as fn from p)\n"


@query(_CONFUSION + "select * from c")
def confusion(t):
    c = metrics.counts(_scored(t), "y", F.col("s") > 0.5)
    return t.spark.createDataFrame([(c["tp"], c["fp"], c["tn"], c["fn"])], "tp long, fp long, tn long, fn long")


@query(_CONFUSION + ", q as (select '1' as class, tp as hit, fp as wrong, fn as missed from c union all select '0', tn, fn, fp from c) select class, round(coalesce(hit / nullif((hit + wrong), 0)::double, 0), 6) as precision, round(coalesce(hit / nullif((hit + missed), 0)::double, 0), 6) as recall, (hit + missed)::bigint as support from q")
def class_report(t):
    rep = metrics.report(**metrics.counts(_scored(t), "y", F.col("s") > 0.5))
    rows = [(c, rep[c]["precision"], rep[c]["recall"], rep[c]["support"]) for c in ("0", "1")]
    return t.spark.createDataFrame(rows, "class string, precision double, recall double, support long").select("class", r("precision").alias("precision"), r("recall").alias("recall"), "support")


@query(_PROFILE + "select y::int as class, round_even(s * 100, 0)::int as bin, count(*) as n from p group by all")
def prob_bins(t):
    return metrics.probability_bins(_scored(t), "y", "s")


# --- numeric splits ---

_SPLITS = """with b as (select l_quantity as x, case when l_returnflag = 'R' then 1.0::double else 0.0::double end as y from lineitem),
g as (select count(*)::double as n, avg(y) as bv, sum(y) as sy from b),
u as (select x, count(*) as c, sum(y) as s from b group by x),
w as (select x, lead(x) over o as nx, sum(c) over (order by x rows unbounded preceding) as lc, sum(s) over (order by x rows unbounded preceding) as ls, row_number() over o - 1 as i, count(*) over () as nu from u window o as (order by x)),
k as (select *, floor((pow(nu, 0.9) - 1) / 0.9)::bigint + 1 as nb from w where nx is not null),
c as (select (x + nx) / 2 as split, lc, ls / lc as l_mean, n - lc as rc, (sy - ls) / (n - lc) as r_mean, n, bv from k cross join g where i % greatest(1, floor(nu / nb)::bigint) = 0),
sc as (select split, l_mean, r_mean, abs(l_mean - bv) * log2(lc / n * 100) + abs(r_mean - bv) * log2(rc / n * 100) as gain from c where lc >= greatest(1, floor(0.0001 * n)) and rc >= greatest(1, floor(0.0001 * n)) and greatest(abs(l_mean - bv), abs(r_mean - bv)) >= 0.0001)
"""


#: A tree of depth 2 on a column of many values: the root split, then the best split of each side.
_DEPTH_TWO = (
    _SPLITS.replace("l_quantity", "l_extendedprice").partition("sc as (")[0]
    + """least as (select greatest(1, floor(0.0001 * n)) as least, n, bv, sy from g),
root as (select split, lc, l_mean * lc as ls from (select c.*, abs(l_mean - c.bv) * log2(lc / c.n * 100) + abs(r_mean - c.bv) * log2(rc / c.n * 100) as gain from c cross join least
  where lc >= least and rc >= least and greatest(abs(l_mean - c.bv), abs(r_mean - c.bv)) >= 0.0001) where gain > 0 order by round(gain, 12) desc, split limit 1),
node as (select 0 as side, -1e300 as lower, split as upper, 0::double as c0, 0::double as s0, lc::double as c1, ls as s1 from root
  union all select 1, split, 1e300, lc, ls, (select n from g), (select sy from g) from root),
young as (select side, split, lc, ls, lower, upper, c0, s0, c1, s1, abs((ls - s0) / (lc - c0) - bv) as ld, abs((s1 - ls) / (c1 - lc) - bv) as rd, lc - c0 as ln, c1 - lc as rn, n
  from (select split, lc, s as ls from (select split, lc, l_mean * lc as s from c)) join node on split > lower and split < upper cross join least where lc - c0 >= least and c1 - lc >= least),
best as (select * from (select *, row_number() over (partition by side order by round(ld * log2(ln / n * 100) + rd * log2(rn / n * 100), 12) desc, split) as k,
  ld * log2(ln / n * 100) + rd * log2(rn / n * 100) as gain from young where greatest(ld, rd) >= 0.0001) where k = 1 and gain > 0),
leaf as (select lower, split as upper, ln as n, (ls - s0) / ln as m from best union all select split, upper, rn, (s1 - ls) / rn from best
  union all select lower, upper, c1 - c0, (s1 - s0) / (c1 - c0) from node where side not in (select side from best))
select round(nullif(lower, -1e300), 4) as lower, round(nullif(upper, 1e300), 4) as upper, n::bigint as n, round(m, 6) as mean from leaf
"""
)


@query(_DEPTH_TWO)
def tree_of_many_values(t):
    """Leaves of a feature whose values stay distributed."""
    d = t.lineitem.select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model = StepClassifier(StepParams(max_depth=2), calibrate=False).fit(d, "y", ["l_extendedprice"])
    rows = [(x.lower, x.upper, round(x.freq * model.stats.n), x.mean) for x in model.profile["l_extendedprice"] if not x.is_null]
    finite = [(None if np.isinf(lo) else lo, None if np.isinf(up) else up, n, m) for lo, up, n, m in rows]
    return t.spark.createDataFrame(finite, "lower double, upper double, n long, mean double").select(r("lower", 4).alias("lower"), r("upper", 4).alias("upper"), "n", r("mean").alias("mean"))


@query(_SPLITS + "select split, lc::bigint as l_cnt, round(l_mean, 6) as l_mean, rc::bigint as r_cnt, round(r_mean, 6) as r_mean from c")
def split_stats(t):
    from lumenstep.operators import stats

    s = stats.collect(returned(t), "y", ["l_quantity"], [])[()]
    split, count, total = stats.candidates(s.features["l_quantity"], 0.1)
    rows = [(float(x), int(c), float(v / c), int(s.n - c), float((s.total - v) / (s.n - c))) for x, c, v in zip(split, count, total)]
    return t.spark.createDataFrame(rows, "split double, l_cnt long, l_mean double, r_cnt long, r_mean double").withColumns({c: r(c) for c in ("l_mean", "r_mean")})


@query(_SPLITS + "select split from sc where gain > 0 order by round(gain, 12) desc, split limit 1")
def root_split(t):
    model = StepClassifier(StepParams(max_depth=1), calibrate=False).fit(returned(t), "y", ["l_quantity"])
    return t.spark.createDataFrame([(model.profile["l_quantity"][0].upper,)], "split double")


@query(_SPLITS + ", s as (select split from sc where gain > 0 order by round(gain, 12) desc, split limit 1) select l_orderkey || '-' || l_linenumber as id, case when l_quantity <= split then 0 else 1 end as leaf from lineitem cross join s")
def leaf_ids(t):
    model = StepClassifier(StepParams(max_depth=1), calibrate=False).fit(returned(t), "y", ["l_quantity"])
    return model.leaf_ids(returned(t)).select("id", F.col("leaf_l_quantity").alias("leaf"))


@query("select c_mktsegment, count(*) as n, round(avg(o_totalprice), 4) as base from orders join customer on o_custkey = c_custkey group by c_mktsegment union all select '__dataset__', count(*), round(avg(o_totalprice), 4) from orders join customer on o_custkey = c_custkey")
def partition_bases(t):
    from lumenstep.operators import stats

    s = stats.collect(priced(t), "o_totalprice", ["month"], [], ["c_mktsegment"])
    s = {k[0]: v for k, v in s.items()} | {"__dataset__": stats.Stats.merged(list(s.values()))}
    return t.spark.createDataFrame([(k, v.n, v.base) for k, v in s.items()], "c_mktsegment string, n long, base double").withColumn("base", r("base", 4))


@query("select f, v, c - cf as train_n from (select fold as f, o_orderpriority as v, sum(c) over (partition by o_orderpriority) as c, c as cf from (select o_orderkey % 5 as fold, o_orderpriority, count(*) as c from orders group by all))")
def fold_loo_stats(t):
    from lumenstep.operators import stats

    s = stats.collect(t.orders.select((F.col("o_orderkey") % 5).alias("fold"), "o_orderpriority", "o_totalprice"), "o_totalprice", [], ["o_orderpriority"], ["fold"])
    whole = stats.Stats.merged(list(s.values()))
    rows = [(int(k[0]), str(v), int(c)) for k, own in s.items() for f in [whole.minus(own).features["o_orderpriority"]] for v, c in zip(f.values, f.count)]
    return t.spark.createDataFrame(rows, "f long, v string, train_n long")


_ERR = "(select o_orderpriority as leaf, round(o_totalprice, 2) - 150000 as e from orders)"


@query(f"select leaf, round(um, 4) as um, uc, round(om, 4) as om, oc, ec from (select leaf, coalesce(avg(-e) filter (e < 0), 0) as um, count(*) filter (e < 0) as uc, coalesce(avg(e) filter (e > 0), 0) as om, count(*) filter (e > 0) as oc, count(*) filter (e = 0) as ec from {_ERR} group by leaf)")
def tighten_step(t):
    e = t.orders.select(F.col("o_orderpriority").alias("leaf"), (r("o_totalprice", 2) - 150000).alias("e"))
    return layers.step_gains(e).select("leaf", r("um", 4).alias("um"), "uc", r("om", 4).alias("om"), "oc", "ec")


#: Scores of 20 leaves (priority, month, status) and seeded mutations of them.
_POOL, _DRAW = evolution.Evolve(mutations=24, max_leaves=6), random.Random(8)
_MUTATIONS = [_POOL.mutate(20, _DRAW) for _ in range(_POOL.mutations)]
_FACTORS = ", ".join(f"({m}, {leaf}, {factor!r}::double)" for m, x in enumerate(_MUTATIONS) for leaf, factor in x.items())


@query(
    f"""with f(mutation, leaf, factor) as (values {_FACTORS}),
w as (select l.leaf, m.mutation, 5000.0::double * (l.leaf % 7 - 2) * coalesce(f.factor, 1) as score from range(20) l(leaf) cross join range({len(_MUTATIONS)}) m(mutation)
  left join f on f.leaf = l.leaf and f.mutation = m.mutation),
o as (select o_orderkey, o_totalprice - 140000 as y, unnest([substr(o_orderpriority, 1, 1)::int - 1, month(o_orderdate)::int + 4, case o_orderstatus when 'F' then 17 when 'O' then 18 else 19 end]) as leaf from orders),
e as (select mutation, o_orderkey, sum(score) - min(y) as e from o join w on w.leaf = o.leaf group by all),
r as (select mutation, avg(abs(e)) as error from e group by mutation),
b as (select avg(abs(e)) as target from (select o_orderkey, sum(5000.0::double * (leaf % 7 - 2)) - min(y) as e from o group by o_orderkey)),
s as (select r.*, target, error < target as better from r cross join b)
select mutation, round(error, 4) as error, better, case when better then row_number() over (partition by better order by error, mutation) end as place,
  round(coalesce((select avg(error) from s where better), target), 4) as next_target from s"""
)
def evolve_generation(t):
    """One selection of seeded mutations: errors from the index, ranks of the better ones, the moved target."""
    status = F.when(F.col("o_orderstatus") == "F", 17).when(F.col("o_orderstatus") == "O", 18).otherwise(19)
    leaves = F.array(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.month("o_orderdate") + 4, status)
    index = evolution.LeafIndex(t.orders.select((F.col("o_totalprice") - 140000).alias("y"), F.lit(0.0).alias("fixed"), leaves.alias("leaves")), 20)
    scores = np.array([5000.0 * (i % 7 - 2) for i in range(20)])
    found, now = index.rated(scores, _MUTATIONS), float(index.rated(scores, [{}])[0])
    better, _, target = evolution.selected(list(range(len(found))), found, now)
    places = {m: k + 1 for k, m in enumerate(better)}
    rows = [(m, float(e), m in places, places.get(m), target) for m, e in enumerate(found)]
    return t.spark.createDataFrame(rows, "mutation long, error double, better boolean, place long, next_target double").select("mutation", r("error", 4).alias("error"), "better", "place", r("next_target", 4).alias("next_target"))


@query("select round(avg(abs(e)), 4) as mae, round(avg(e * e), 0) as mse, round(sqrt(avg(e * e)), 4) as rmse, round(1 - avg(e * e) / var_pop(o_totalprice), 6) as r2, round(1 - var_pop(e) / var_pop(o_totalprice), 6) as evs, round(avg(abs(e) / greatest(abs(o_totalprice), 2.220446049250313e-16)), 6) as mape from (select o_totalprice, o_totalprice - 150000 as e from orders)")
def reg_metrics(t):
    m = metrics.regression(t.orders.withColumn("p", F.lit(150000.0)), "o_totalprice", "p")
    return m.select(r("mae", 4).alias("mae"), r("mse", 0).alias("mse"), r("rmse", 4).alias("rmse"), r("r2").alias("r2"), r("evs").alias("evs"), r("mape").alias("mape"))


# --- quality ---


@query("select round(count(distinct p_brand)::double / count(p_brand), 4) as cardinality, count(distinct p_brand) as n_unique, 0.0::double as missing_pct, (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 1) as mode, (select round(avg(abs(c::double / n * k - 1)), 6) from (select count(*) as c, sum(count(*)) over () as n, count(*) over () as k from part group by p_brand)) as category_imbalance from part")
def scan_categorical(t):
    s = quality.scan(t.part.select("p_brand"))
    return s.select("cardinality", "n_unique", "missing_pct", "mode", r("category_imbalance").alias("category_imbalance"))


@query("select min(c_acctbal) as min, max(c_acctbal) as max, round(avg(c_acctbal), 4) as mean, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(stddev_samp(c_acctbal), 4) as std, round(skewness(c_acctbal), 6) as skewness, round(kurtosis(c_acctbal), 6) as kurtosis from customer")
def scan_numeric(t):
    s = quality.scan(t.customer.select("c_acctbal"))
    return s.select("min", "max", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r("std", 4).alias("std"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query("select 'c_custkey' as \"column\", 'id' as kind union all select 'c_mktsegment', 'categorical' union all select 'empty', 'empty'")
def scan_types(t):
    return quality.scan(t.customer.select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("empty"))).select("column", "kind")


# --- rules, levers, differences ---

_PAIRS = "with l as (select p_partkey, p_brand as a, p_size::varchar as b from part), a as (select a from l group by a having count(*) >= 2), b as (select b from l group by b having count(*) >= 2), x as (select a, b from a cross join b except select a, b from l)\n"


@query(_PAIRS + "select 'p_brand' as feature, a as value, 'p_size' as rule_feature, b as rule_value from x union all select 'p_size', b, 'p_brand', a from x")
def exclusion_rules(t):
    return rules.exclusion_rules(t.part, ["p_brand", "p_size"], 2)


@query("select * from (values ('p_brand', 'dropped', null::bigint), ('p_price2', 'added', null)) v(\"column\", change, rows_changed) union all select 'p_size', 'updated', count(*) from part where p_size > 25")
def df_delta(t):
    after = t.part.withColumn("p_size", F.when(F.col("p_size") > 25, 0).otherwise(F.col("p_size"))).withColumn("p_price2", F.col("p_retailprice") * 2).drop("p_brand")
    return rules.frame_delta(t.part, after, "p_partkey")


_LEVERS = _PROFILE + """, best as (select f, min(s) as b from norm group by f),
e as (select lng.doc_id, max(case when f = 'lang' then s - b end) as el, max(case when f = 'source' then s - b end) as es from lng join norm using (f, v) join best using (f) group by lng.doc_id),
v as (select doc_id, case when el >= es then 'lang' else 'source' end as best_lever, round(greatest(el, es), 6) as best_effect from e),
x as (select *, case when best_lever = 'lang' then 2.0::double else 5.0::double end as cost from v),
y as (select *, round(best_effect * 100 - cost, 4) as expected_value, round((best_effect * 100 - cost) / cost, 6) as roi from x)
"""


def _levers(t: Tables) -> DataFrame:
    model, d = _docs_model(t)
    best = rules.best_scores(model.profile, ["lang", "source"])
    df = rules.lever_effects(model.explain(d), best).withColumn("best_effect", r("best_effect"))
    df = rules.expected_value(df, {"lang": ("translate", 2.0), "source": ("replace", 5.0)}, F.lit(100.0))
    return df.select("doc_id", "best_lever", "best_effect", "cost", r("expected_value", 4).alias("expected_value"), r("roi").alias("roi"))


@query(_LEVERS + "select * from y")
def lever_effects(t):
    return _levers(t)


@query(_LEVERS + ", z as (select *, sum(cost) over (order by roi desc, doc_id rows unbounded preceding) as upto from y), q as (select b.budget, count(*) as n, sum(cost) as spent, round(sum(expected_value), 2) as value from z join (select unnest([100.0, 250.0, 500.0])::double as budget) b on upto <= b.budget group by b.budget) select * from q")
def budget_tiers(t):
    return rules.budget_tiers(_levers(t), [100.0, 250.0, 500.0], "doc_id").select("budget", "n", "spent", r("value", 2).alias("value"))


# --- rows only: iterative or seeded ---


@query()
def tree_full_fit(t):
    model = StepClassifier(LEAVES).fit(returned(t), "y", id_columns=("id",))
    return model.predict_explain(returned(t)).select("id", "score", "proba", "multiplier", "support")


@query()
def ridge_regressor(t):
    return StepRegressor(LEAVES).fit(priced(t), "o_totalprice", id_columns=("o_orderkey",)).predict(priced(t)).select("o_orderkey", "prediction")


@query(
    """with b as (select c_mktsegment as p, o_orderpriority as v, o_totalprice as y, o_orderkey from orders join customer on o_custkey = c_custkey),
g as (select p, count(*)::double as n, avg(y) as my from b group by p),
u as (select p, v, count(*)::double as c, sum(y) as s from b group by p, v),
x as (select p, v, c, s, n, my, s / c - my as raw from u join g using (p)),
k as (select *, raw * raw * c + 1 as d, raw * c / n as m, raw * s - raw * c * my as rhs from x),
z as (select p, any_value(n) as n, sum(m * rhs / d) as mb, sum(m * m / d) as mm from k group by p),
w as (select k.p, v, my, raw, m, rhs / d + k.n * m / d * mb / (1 - k.n * mm) as w from k join z on z.p = k.p),
base as (select p, min(my) - sum(m * w) as b0 from w group by p)
select o_orderkey, round(b0 + raw * w, 4) as prediction from b join w on w.p = b.p and w.v = b.v join base on base.p = b.p"""
)
def ridge_per_partition(t):
    """Regressors of all partitions from one scan; the SQL inverts each one's normal equations in closed form."""
    d = priced(t).select("o_orderkey", "c_mktsegment", "o_orderpriority", "o_totalprice")
    model = PartitionedModel(StepRegressor, StepParams()).fit(d, "o_totalprice", "c_mktsegment", ["o_orderpriority"])
    return model.predict(d).select("o_orderkey", r("prediction", 4).alias("prediction"))


@query(
    """with b as (select d.doc_id, d.lang as p, d.source as v, l.quality::double as y from documents d join labels l on d.doc_id = l.doc_id),
g as (select p, count(*)::double as n, avg(y) as bv from b group by p),
u as (select p, v, count(*) as c, avg(y) as m from b group by p, v),
raw as (select u.p, v, (c / n) * (m - bv) as r, bv from u join g on g.p = u.p),
ext as (select p, least(min(r), 0) as lo, greatest(max(r), 0) as hi from raw group by p),
s as (select raw.p, v, bv + case when r = 0 then 0.0::double when r < 0 then abs(r) / lo * bv else r / hi * (1 - bv) end as score from raw join ext on ext.p = raw.p)
select doc_id, round(score, 6) as score from b join s on s.p = b.p and s.v is not distinct from b.v"""
)
def scores_per_partition(t):
    """A classifier for each language, each row scored by its own."""
    d = rated(t)
    return PartitionedModel().fit(d, "y", "lang", ["source"]).score(d).select("doc_id", r("score").alias("score"))


@query(_PROFILE + ", k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as k from p) select round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as roc_auc from k")
def subset_auc(t):
    """The AUC of a subset of features, rated with others in one scan."""
    model, d = _docs_model(t)
    one = {"lang": model.profile["lang"]}
    return t.spark.createDataFrame([(search.subset_aucs(d, "y", model.base, [one, model.profile])[1],)], "roc_auc double").select(r("roc_auc").alias("roc_auc"))


@query()
def partition_scores(t):
    d = rated(t)
    return PartitionedModel(params=LEAVES).fit(d, "y", "lang", ["source", "n_chars"]).predict(d).select("doc_id", "score", "proba", "prediction")


@query()
def hp_search(t):
    s = search.ParamSearch(n_trials=4, n_folds=3, metric="weighted-f1")
    best = s.optimise(rated(t), "y", "doc_id", ["lang", "source", "n_chars"])
    return t.spark.createDataFrame([(i, v, str(c)) for i, (c, v) in enumerate(s.history)], "trial long, value double, choice string").withColumn("best", F.lit(best.to_json()))


@query()
def evolve_tighten(t):
    model = StepRegressor(LEAVES).fit(priced(t), "o_totalprice", ["c_mktsegment", "o_orderpriority", "month"])
    out = layers.LeafOptimiser(model).add_layer(layers.Tighten(3)).add_layer(layers.Evolve(10, 2)).fit(priced(t)).optimise()
    return out.predict(priced(t)).select("o_orderkey", "prediction")


@query()
def surrogate_fit(t):
    model = surrogate(StepRegressor, priced(t), F.col("month") * 10.0 + F.col("c_acctbal") / 1000, ["month", "c_acctbal"], params=LEAVES)
    return model.predict(priced(t)).select("o_orderkey", "prediction")


@query()
def random_subset_selector(t):
    return t.spark.createDataFrame(search.select_features(rated(t), "y", "doc_id", 4, features=["lang", "source", "n_chars"]), "feature string, score double")


@query()
def target_path(t):
    model, _ = _docs_model(t)
    return t.spark.createDataFrame([(k, n.category or "null", n.score) for k, n in search.reach_target(model, 0.7).items()], "feature string, category string, score double")


# --- models of partitions and parts of a score ---


@query(
    _PROFILE
    + ", w as (select lng.doc_id, lng.f as feature, norm.s as contribution, bv + sum(norm.s) over (partition by lng.doc_id order by abs(norm.s), lng.f rows unbounded preceding) as running "
    "from lng join norm on lng.f = norm.f and lng.v = norm.v cross join g where norm.s <> 0) select doc_id, feature, round(contribution, 6) as contribution, round(running, 6) as running from w"
)
def waterfall(t):
    model, d = _docs_model(t)
    return rules.waterfall(model.explain(d), "doc_id", model.features, model.base).withColumns({c: r(c) for c in ("contribution", "running")})


@query(
    "with base as (select d.doc_id, d.lang, d.source, l.quality::double as y from documents d join labels l on d.doc_id = l.doc_id), "
    "g as (select lang, count(*)::double as n, avg(y) as bv from base group by lang), "
    "raw as (select lang, source, count(*) / min(n) * (avg(y) - min(bv)) as r from base join g using (lang) group by lang, source), "
    "ext as (select lang, least(min(r), 0) as smin, greatest(max(r), 0) as smax from raw group by lang), "
    "s as (select doc_id, bv, case when r = 0 then 0.0::double when r < 0 then abs(r) / smin * bv else r / smax * (1 - bv) end as s from base join g using (lang) join ext using (lang) join raw using (lang, source)) "
    "select doc_id, round(s, 6) as contribution_source, round(bv, 6) as base_value, round(bv + s, 6) as score from s"
)
def partition_explain(t):
    d = rated(t)
    out = PartitionedModel().fit(d, "y", "lang", ["source"]).explain(d)
    return out.select("doc_id", *[r(c).alias(c) for c in ("contribution_source", "base_value", "score")])
