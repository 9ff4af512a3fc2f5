"""One query for each corpus operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from lumenstep.llm import byte_bpe, chat, context_tree, decontaminate, mixing, near_dedup, ordinal, pii, prefix_trie, secrets, sharding, spelling, topk

#: Quality weight of a document in the mix, by its label.
GOOD, POOR = 2.0, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(labels: DataFrame) -> DataFrame:
    """_rated, _quality: the best label of each document."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_rated")).agg(F.max("quality").alias("_quality"))


def op1_pii(spark, sf_dir):
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.digest(_table(spark, sf_dir, "documents"), 16)


def op3_mixing(spark, sf_dir):
    return mixing.digest(_table(spark, sf_dir, "documents"), ratings(_table(spark, sf_dir, "labels")), GOOD, POOR)


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_chat(spark, sf_dir):
    text = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd))


def op8_lm_score(spark, sf_dir):
    return context_tree.scored(_table(spark, sf_dir, "documents"), depth=context_tree.DEPTH)


def op9_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, _table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text")).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op10_topk(spark, sf_dir):
    vectors = topk.usable(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op11_spelling(spark, sf_dir):
    """All words of the documents with their near words, forms and roots."""
    return spelling.variants(spelling.vocabulary(spelling.slipped(_table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark, sf_dir):
    """All nodes of the trie of the rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(_table(spark, sf_dir, "conversations"))))


def op13_byte_bpe(spark, sf_dir):
    """Digests of the token ids of every document, and of the bytes read back from them."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, back=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_sharding, op3_mixing, op4_near_dedup, op5_secrets, op6_decontamination, op7_chat, op8_lm_score, op9_quality, op10_topk,
        op11_spelling, op12_prefix_trie, op13_byte_bpe,
    )
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Table of crc32 by byte, and the unsigned crc32 of the UTF-8 bytes of a text.
_CRC_TABLE = "crc as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i))"


def _crc32(text: str) -> str:
    bytes_of = f"list_transform(range(length(hex({text})) // 2), lambda i: ('0x' || hex({text})[2 * i + 1 : 2 * i + 2])::bigint)"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295)"


ORACLE_SQL = {
    "op3_mixing": f"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size, md5(coalesce(text, '')) as m,
    (('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
l as (select doc_id, max(quality) as quality from labels group by doc_id),
k as (select d.*, -ln(u) / case when quality > 0 then {GOOD} when quality = 0 then {POOR} else 1.0 end as key from d left join l on d.doc_id = l.doc_id),
s as (select source, sum(size)::bigint as source_size, (array[5.0, 2.0, 1.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from d group by source),
r as (select *, 2.0 * source_size as most, 2.0 * source_size / w as ratio from s),
v as (select *, (1.5 * sum(source_size) over () - coalesce(sum(most) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by ratio, source rows between current row and unbounded following) as level from r),
t as (select source, source_size, case when level >= ratio then most
  else w * (select min_by(level, ratio) from v where level < ratio) end as target from v),
e as (select k.*, source_size, target, least(floor(target / source_size), 2)::bigint as epochs from k join t on k.source is not distinct from t.source),
p as (select *, coalesce(sum(size) over (partition by source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before from e)
select doc_id, size, source_size, target,
  (size * (epochs + case when 2 * before + size <= 2 * (target - epochs * source_size) and epochs < 2 then 1 else 0 end))::bigint as taken from p
""",
    "op4_near_dedup": f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as common from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 75 * (x.n + y.n - common)),
e as (select u, v from links union all select v, u from links),
reach(a, b) as (select u, v from e union select reach.a, e.v from reach join e on reach.b = e.u),
c as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) as component_id,
  w.doc_id = least(w.doc_id, coalesce(c.b, w.doc_id)) as kept
from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id
""",
    "op6_decontamination": f"""
with i as (select item_id, regexp_extract_all({_LOWER.format('text')}, '{_BENCH_WORD}') as w from benchmark),
g as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as j from i where len(w) > 0)),
d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{_BENCH_WORD}') as w from documents),
x as (select doc_id, j, n, array_to_string(w[j:j + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as j from d, (select distinct n from g) where len(w) >= n)),
h as (select x.doc_id, x.j, x.n, g.item_id from x join g on x.g = g.g and x.n = g.n),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(generate_series(j, j + n - 1)) as place from h) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as line from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(line, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
""",
    "op10_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op11_spelling": f"""
with recursive {_CRC_TABLE},
r as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
g as (select id, run, count(*) as n from r where length(run) >= 5 group by all),
h as (select run, n, {_crc32("(id || ':' || run)")} as h from g, crc),
w as (select case when h % 97 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, sum(n)::bigint as n from h group by word),
v as (select word, n from w where length(word) >= 5 and n >= 3),
p as (select word, n, unnest(generate_series(1, length(word))) as i from v),
x as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as less from p),
pairs as (select distinct a.word, b.word as near from x a join v b on a.less = b.word
  union select distinct b.word, a.word from x a join v b on a.less = b.word
  union select distinct a.word, b.word from x a join x b on a.i = b.i and a.less = b.less and length(a.word) = length(b.word) and a.word <> b.word),
s as (select v.word, v.n, count(near) as n_near, min(struct_pack(less := -m.n, near := near)) as best
  from v left join pairs on v.word = pairs.word left join v m on m.word = near group by all),
f as (select word, n, n_near, case when -best.less >= 2 * n then best.near end as form, case when -best.less >= 2 * n then -best.less end as form_n from s),
up(word, root) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.root where f.form is not null),
last as (select up.word, root from up join f on f.word = up.root where f.form is null)
select f.word, n, n_near, form, form_n, root from f join last on last.word = f.word
""",
    "op12_prefix_trie": f"""
with {_CRC_TABLE},
c as (select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as s
  from conversations where conv_id is not null group by conv_id),
h as (select *, {_crc32("conv_id::varchar")} % 9 as h from c, crc),
b as (select h.conv_id, coalesce(c.s[1 : h], []) || h.s[h + 1 :] as s from h left join c on c.conv_id = h.conv_id - h.conv_id % 5),
q as (select s, len(s)::bigint as depth, min(conv_id) as conv_id, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) as line from b group by s),
p as (select s, n, conv_id, line, unnest(generate_series(0, len(s))) as d from q),
nodes as (select s[1 : d] as path, d as depth, min(conv_id) as conv_id, sum(n)::bigint as n_convs, max(case when d = len(s) then line end) as line from p group by all),
kids as (select path[1 : depth - 1] as over, count(*) as n_children from nodes where depth > 0 group by over),
own as (select nodes.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(path[depth].t) end as saved
  from nodes left join kids on over = path),
below as (select path[1 : d] as top, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from (select *, unnest(generate_series(0, depth)) as d from own) group by top)
select own.conv_id, own.depth, up.conv_id as parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(coalesce(own.line, '')) as ends_sha256
from own join below on top = own.path left join nodes up on up.path = own.path[1 : own.depth - 1] and up.depth = own.depth - 1
""",
}
