"""Joins, aggregates, windows, sets and scalars of feature-engineering workflows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenstep.functions import text as X
from lumenstep.operators import search
from lumenstep.operators.prep import Pipeline
from lumenstep.operators.quality import drop_uninformative
from lumenstep.operators.search import sample_rows, with_folds
from lumenstep.plans._registry import query
from lumenstep.streaming.scoring import session_counts


def r(c, n=6):
    return F.round(c, n)


# --- projections and filters ---


@query("select o_orderkey, round(o_totalprice * 0.9, 4) as net, case when o_totalprice > 100000 then 'big' else 'small' end as size from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 400000")
def project_filter(t):
    o = t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 400000))
    return o.select("o_orderkey", r(F.col("o_totalprice") * 0.9, 4).alias("net"), F.when(F.col("o_totalprice") > 100000, "big").otherwise("small").alias("size"))


@query("select p_partkey, case p_brand when 'Brand#11' then 1 when 'Brand#12' then 2 end as code, least(greatest(p_size, 5), 20) as clipped from part")
def map_and_clip(t):
    codes = F.create_map(F.lit("Brand#11"), F.lit(1), F.lit("Brand#12"), F.lit(2))
    return t.part.select("p_partkey", F.try_element_at(codes, F.col("p_brand")).alias("code"), F.least(F.greatest("p_size", F.lit(5)), F.lit(20)).alias("clipped"))


@query("select c_custkey, c_acctbal from (select c_custkey, case when c_acctbal > 0 then c_acctbal end as c_acctbal from customer) where c_acctbal is not null")
def drop_nulls(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal")).na.drop(subset=["c_acctbal"])


@query("select l_orderkey, l_linenumber, 'quantity' as measure, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'tax', l_tax from lineitem")
def unpivot_measures(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")).unpivot(["l_orderkey", "l_linenumber"], ["quantity", "tax"], "measure", "value")


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by o_custkey")
def dummies_pivot(t):
    p = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("select p_partkey, cast(ceil(round((p_retailprice - lo) / ((hi - lo) / 10), 9)) as int) as bin from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)")
def equal_width_bins(t):
    g = t.part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return t.part.join(F.broadcast(g)).select("p_partkey", F.ceil(F.round((F.col("p_retailprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10), 9)).cast("int").alias("bin"))


# --- joins ---


@query("select o_orderkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def left_dim(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("select a.o_custkey, a.o_orderstatus, a.n, b.top from (select o_custkey, o_orderstatus, count(*) as n from orders group by all) a left join (select o_custkey, o_orderstatus, max(o_totalprice) as top from orders where o_totalprice > 200000 group by all) b on a.o_custkey = b.o_custkey and a.o_orderstatus = b.o_orderstatus")
def composite_left(t):
    keys = ["o_custkey", "o_orderstatus"]
    big = t.orders.where("o_totalprice > 200000").groupBy(*keys).agg(F.max("o_totalprice").alias("top"))
    return t.orders.groupBy(*keys).agg(F.count("*").alias("n")).join(big, keys, "left")


@query("select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority")
def inner_join(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("select p_partkey, coalesce(n, 0) as n from (select l_partkey, count(*) as n from lineitem group by l_partkey) right join part on l_partkey = p_partkey")
def right_join(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "right").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, lang, quality from documents natural join labels")
def natural_join(t):
    common = [c for c in t.documents.columns if c in t.labels.columns]
    return t.documents.join(t.labels, common).select("doc_id", "lang", "quality")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def semi_join(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# --- aggregates ---


@query("select c_custkey, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as total, min(o_totalprice) as least, max(o_totalprice) as most, round(avg(o_totalprice), 6) as mean, count(distinct o_orderpriority) as kinds, min_by(o_orderstatus, o_orderkey) as first_status from customer left join orders on c_custkey = o_custkey group by c_custkey")
def customer_features(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n"), r(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"),
        r(F.avg("o_totalprice")).alias("mean"), F.count_distinct("o_orderpriority").alias("kinds"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"),
    )


@query("select o_custkey, o_orderpriority as favourite from (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as k from orders group by o_custkey, o_orderpriority) where k = 1")
def mode_per_customer(t):
    return t.orders.groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("favourite"))


@query("select o_custkey, round(avg(n), 6) as lines_per_order from (select l_orderkey, count(*)::double as n from lineitem group by l_orderkey) join orders on l_orderkey = o_orderkey group by o_custkey")
def nested_avg(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(r(F.avg("n")).alias("lines_per_order"))


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from lineitem group by l_suppkey")
def distinct_counts(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as keys from orders group by o_custkey")
def order_list(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("keys"))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity - l_discount * l_quantity), 2) as v from lineitem group by l_returnflag")
def correlated_sum(t):
    return t.lineitem.groupBy("l_returnflag").agg(r(F.sum(F.col("l_extendedprice") * F.col("l_quantity") - F.col("l_discount") * F.col("l_quantity")), 2).alias("v"))


@query("select c_mktsegment, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from customer group by c_mktsegment")
def value_counts(t):
    per = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return per.withColumn("share", r(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())))


@query("select count(*) as n, round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 6) as variance, round(stddev_samp(l_quantity), 6) as std, round(skewness(l_quantity), 6) as skewness, round(kurtosis(l_quantity), 6) as kurtosis, round(quantile_cont(l_quantity, 0.25), 6) as q25, round(quantile_cont(l_quantity, 0.5), 6) as median, round(quantile_cont(l_quantity, 0.75), 6) as q75 from lineitem")
def moments(t):
    from lumenstep.operators import quality, ranks

    m = quality.moments(F.col("l_quantity"))
    q = ranks.quantiles(t.lineitem, {"q": F.col("l_quantity")}, list(quality.QUARTILES.values()))["q"]
    whole = t.lineitem.agg(F.count("*").alias("n"), *[r(m[k]).alias(k) for k in ("mean", "variance", "std", "skewness", "kurtosis")])
    return whole.withColumns({k: r(F.lit(x)) for k, x in zip(quality.QUARTILES, q)})


@query("select count(*) filter (v is null) as missing, round(avg(case when v is null then 1.0::double else 0.0::double end), 6) as share from (select nullif(o_orderstatus, 'P') as v from orders)")
def null_share(t):
    v = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("v"))
    return v.agg(F.count_if(F.col("v").isNull()).alias("missing"), r(F.avg(F.col("v").isNull().cast("double"))).alias("share"))


@query("select cast(floor(l_quantity / 5) as int) as bucket, count(*) as n from lineitem group by 1")
def histogram(t):
    return t.lineitem.groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# --- windows ---


@query("select o_orderkey, lag(o_totalprice) over w as previous, datediff('day', lag(o_orderdate::date) over w, o_orderdate::date) as gap from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def order_lag(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(w).alias("previous"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("gap"))


@query("select o_orderkey, max(k) over (partition by o_custkey) - k + 1 as from_last from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders)")
def reverse_order_number(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.withColumn("k", F.row_number().over(w))
    return o.select("o_orderkey", (F.max("k").over(Window.partitionBy("o_custkey")) - F.col("k") + 1).cast("long").alias("from_last"))


@query("select o_custkey, o_orderkey, k from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k <= 3")
def last_three(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("o_custkey", "o_orderkey", "k")


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as upto from orders")
def running_total(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", r(F.sum("o_totalprice").over(w), 2).alias("upto"))


@query("select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as filled from (select *, case when event_type = 'purchase' then value end as v from events)")
def forward_fill(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("filled"))


@query("select event_id, case when count(value) over w >= 2 then round(avg(value) over w, 6) end as smooth from events window w as (partition by user_id order by ts, event_id rows between 1 preceding and 1 following)")
def rolling_center(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 1)
    return t.events.select("event_id", F.when(F.count("value").over(w) >= 2, r(F.avg("value").over(w))).alias("smooth"))


@query("select o_custkey, month, last_before from (select o_custkey, date_trunc('month', o_orderdate)::date as month, max(prev) as last_before from (select *, lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) group by all)")
def last_purchase_lag(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.withColumn("prev", F.lag("o_orderdate").over(w))
    return o.groupBy("o_custkey", F.trunc("o_orderdate", "MM").alias("month")).agg(F.max("prev").alias("last_before"))


@query("select o_orderkey, coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) <= o_orderdate + interval 30 day, false) as again from orders")
def rebuy_within_30_days(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.coalesce(F.lead("o_orderdate").over(w) <= F.col("o_orderdate") + F.expr("interval 30 days"), F.lit(False)).alias("again"))


@query("select c_custkey, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rank_b from (select c_custkey, round(c_acctbal, -2) as b from customer)")
def average_rank(t):
    c = t.customer.select("c_custkey", r("c_acctbal", -2).alias("b"))
    return search.ranked(c, "b").select("c_custkey", "rank_b")


# --- sorts, limits, sets ---


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select p_partkey, p_type from part where p_type in (select p_type from part group by p_type order by count(*) desc, p_type limit 5)")
def top_categories(t):
    top = t.part.groupBy("p_type").count().orderBy(F.desc("count"), "p_type").limit(5).select("p_type")
    return t.part.join(F.broadcast(top), "p_type", "left_semi").select("p_partkey", "p_type")


@query("select 'c' as side, c_nationkey as nation, count(*) as n from customer group by all union all select 's', s_nationkey, count(*) from supplier group by all")
def union_all(t):
    one = t.customer.groupBy(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return one.unionByName(t.supplier.groupBy(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def dedupe(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("select o_orderkey, (row_number() over (partition by o_orderstatus order by o_orderkey) - 1) % 5 as fold from orders")
def cv_fold_assign(t):
    return with_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


@query("select o_orderkey, o_totalprice from orders where ('0x' || substr(md5('3:' || o_orderkey::varchar), 1, 13))::bigint < floor(0.2 * 4503599627370496)::bigint")
def seeded_sample(t):
    return sample_rows(t.orders, "o_orderkey", fraction=0.2, seed=3).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice, case when o_orderkey % 2 = 0 then 1 end as half from orders")
def drop_uninformative_columns(t):
    x = t.orders.select("o_orderkey", "o_totalprice", F.lit("one").alias("same"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("o_orderkey") % 3 == 0, 0).alias("zero"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("half"))
    return drop_uninformative(x)


# --- dates and customers over time ---


@query("select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, (dayofweek(o_orderdate) + 6) % 7 as dow, dayname(o_orderdate) as name, last_day(o_orderdate) as month_end from orders")
def date_parts(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.month(d).cast("long").alias("m"), F.weekday(d).cast("long").alias("dow"), F.date_format(d, "EEEE").alias("name"), F.last_day(d).alias("month_end"))


@query("select o_custkey, datediff('day', max(o_orderdate)::date, top) as recency, datediff('day', min(o_orderdate)::date, top) as tenure, count(*) as n, datediff('day', max(o_orderdate)::date, top) > 180 as churned from orders, (select max(o_orderdate)::date as top from orders) group by o_custkey, top")
def recency_tenure(t):
    top = t.orders.agg(F.max("o_orderdate").alias("top"))
    per = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"), F.count("*").alias("n")).join(F.broadcast(top))
    recency = F.datediff("top", "last").cast("long")
    return per.select("o_custkey", recency.alias("recency"), F.datediff("top", "first").cast("long").alias("tenure"), "n", (recency > 180).alias("churned"))


@query("select o_custkey, date_trunc('month', o_orderdate)::date as month, count(*) as frequency, round(sum(o_totalprice), 2) as monetary from orders group by all")
def rfm_monthly(t):
    return t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("frequency"), r(F.sum("o_totalprice"), 2).alias("monetary"))


@query("select o_custkey, round(aov * 365 / case when gap is null or gap = 0 then 1 else gap end, 4) as clv from (select o_custkey, avg(o_totalprice) as aov, avg(g) as gap from (select *, datediff('day', lag(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate::date)::double as g from orders) group by o_custkey)")
def clv(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.withColumn("g", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)))
    per = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("aov"), F.avg("g").alias("gap"))
    return per.select("o_custkey", r(F.col("aov") * 365 / F.when(F.coalesce("gap", F.lit(0.0)) == 0, 1).otherwise(F.col("gap")), 4).alias("clv"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def event_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("select s as start, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) group by s")
def event_sliding(t):
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("select user_id, min(ts) as started, max(ts) + interval 30 minute as ended, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events)) group by user_id, s")
def event_session(t):
    return session_counts(t.events, "ts", "user_id")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def event_json_prop(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- text ---

@query(r"select doc_id, len(regexp_extract_all(text, '\b[A-Z]+\b')) as upper_words, len(regexp_extract_all(text, '[A-Z]')) as upper_letters, len(regexp_extract_all(text, '[0-9]')) as digits, len(regexp_extract_all(text, 'https?://[^\s]+')) as urls from (select doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') as text from documents)")
def text_counts(t):
    x = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return t.documents.select("doc_id", *[c.cast("long").alias(n) for n, c in (("upper_words", X.uppercase_words(x)), ("upper_letters", X.uppercase_letters(x)), ("digits", X.count(x, "[0-9]")), ("urls", X.urls(x)))])


@query(r"select doc_id, len(w) as n, array_to_string(w[1:5], ' ') as head from (select doc_id, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '[^a-zA-Z'']', ' ', 'g'), '''', '', 'g')), '\s+'), lambda x: x <> '') as w from documents)")
def text_clean_tokens(t):
    w = t.documents.select("doc_id", X.tokens(X.clean(F.col("text"))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query(r"with d as (select quality::double as y, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')), '\b[a-z0-9_][a-z0-9_]+\b')) as w from documents natural join labels), g as (select count(*) as n, avg(y) as b from d) select token, round(avg(y) - min(b), 6) as word_map, round(count(*)::double / min(n), 6) as freq from (select y, unnest(w) as token from d), g group by token having count(*)::double / min(n) > 0.01 and count(*)::double / min(n) < 0.7")
def word_map_filtered(t):
    d = t.documents.join(t.labels, "doc_id")
    terms = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", " ")), F.lit(r"\b[a-z0-9_][a-z0-9_]+\b"), F.lit(0))
    return X.word_map(d, terms, "quality").where("freq > 0.01 and freq < 0.7").select("token", r("word_map").alias("word_map"), r("freq").alias("freq"))


@query("select conv_id, gram, count(*) as n from (select conv_id, array_to_string(w[i:i + 1], ' ') as gram from (select conv_id, w, unnest(generate_series(1, len(w) - 1)) as i from (select conv_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from conversations) where len(w) >= 2)) group by all".replace("\\\\", "\\"))
def bigram_counts(t):
    c = t.conversations.select("conv_id", F.explode(X.ngrams(X.tokens(F.col("text")), 2)).alias("gram"))
    return c.groupBy("conv_id", "gram").agg(F.count("*").alias("n"))


# --- preparation ---

_ORDERS = [{"type": "TextClean", "columns": ["o_orderpriority"], "params": {"operations": ["lowercase"]}}]


@query("select o_orderkey, lower(o_orderpriority) as o_orderpriority, month(o_orderdate) as o_orderdate_month, (dayofweek(o_orderdate) + 6) % 7 as o_orderdate_dayofweek, o_totalprice / 2 as half from orders")
def prep_spec(t):
    spec = {"steps": [*_ORDERS, {"type": "DateTimeExtractTransformer", "columns": ["o_orderdate"], "params": {"components": ["month", "dayofweek"], "drop_original": True}}, {"type": "Expression", "params": {"expressions": {"half": "o_totalprice / 2"}}}, {"type": "DropColumns", "columns": ["o_custkey", "o_orderstatus", "o_totalprice"]}]}
    out = Pipeline.compile(spec).fit_transform(t.orders)
    return out.withColumns({c: F.col(c).cast("long") for c in ("o_orderdate_month", "o_orderdate_dayofweek")})


@query("select c_custkey, coalesce(b, (select quantile_cont(b, 0.5) from (select case when c_acctbal > 0 then c_acctbal end as b from customer))) as b from (select c_custkey, case when c_acctbal > 0 then c_acctbal end as b from customer)")
def prep_fill_median(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return Pipeline.compile({"steps": [{"type": "FillMissing", "columns": ["b"], "params": {"strategy": "median"}}]}).fit_transform(c)


@query("select p_partkey, case when count(*) over (partition by p_size) >= 0.02 * count(*) over () then p_size::varchar else 'Other' end as s from part")
def prep_condense(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("string").alias("s"))
    return Pipeline.compile({"steps": [{"type": "CategoryCondense", "columns": ["s"], "params": {"min_frequency": 0.02}}]}).fit_transform(p)


@query("select c_custkey, try_cast(substr(c_name, 10) as bigint) as c_name, upper(c_mktsegment) as segment from customer")
def prep_cast(t):
    c = t.customer.select("c_custkey", F.substring("c_name", 10, 100).alias("c_name"), "c_mktsegment")
    steps = [{"type": "TypeCast", "params": {"dtypes": {"c_name": "long"}}}, {"type": "ChangeCase", "columns": ["c_mktsegment"], "params": {"case": "upper"}}, {"type": "RenameColumns", "params": {"mapping": {"c_mktsegment": "segment"}}}]
    return Pipeline.compile({"steps": steps}).fit_transform(c)


@query("select o_orderkey, lag(o_totalprice) over w as o_totalprice_lag1, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as mean3, count(*) over (partition by o_custkey) as o_orderkey_count from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def prep_windows(t):
    by = {"by": ["o_custkey"], "order": ["o_orderdate", "o_orderkey"]}
    steps = [{"type": "GroupedLag", "columns": ["o_totalprice"], "params": by}, {"type": "RollingAgg", "columns": ["o_totalprice"], "params": by | {"window": 3}}, {"type": "GroupByAgg", "columns": ["o_orderkey"], "params": {"by": ["o_custkey"], "functions": ["count"]}}]
    out = Pipeline.compile({"steps": steps}).fit_transform(t.orders)
    return out.select("o_orderkey", "o_totalprice_lag1", r("o_totalprice_avg3", 4).alias("mean3"), "o_orderkey_count")


@query("select c_custkey, round((c_acctbal - m) / s, 6) as c_acctbal, (c_mktsegment = 'BUILDING')::int as building from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)")
def prep_scale_onehot(t):
    steps = [{"type": "Scale", "columns": ["c_acctbal"]}, {"type": "OneHot", "columns": ["c_mktsegment"]}]
    out = Pipeline.compile({"steps": steps}).fit_transform(t.customer)
    return out.select("c_custkey", r("c_acctbal").alias("c_acctbal"), F.col("c_mktsegment_BUILDING").alias("building"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as qp, round(corr(l_quantity, l_discount), 6) as qd, round(corr(l_extendedprice, l_discount), 6) as pd from lineitem")
def corr_pearson(t):
    c = lambda a, b: r(F.corr(a, b))
    return t.lineitem.agg(c("l_quantity", "l_extendedprice").alias("qp"), c("l_quantity", "l_discount").alias("qd"), c("l_extendedprice", "l_discount").alias("pd"))


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0::double"


@query(f"select round(corr(a, b), 6) as qd from (select {_RANK.format('l_quantity')} as a, {_RANK.format('l_discount')} as b from lineitem)")
def corr_spearman(t):
    both = search.ranked(search.ranked(t.lineitem.select("l_quantity", "l_discount"), "l_quantity"), "l_discount")
    return both.agg(r(F.corr("rank_l_quantity", "rank_l_discount")).alias("qd"))
