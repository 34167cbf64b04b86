"""The operators' registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embed_dedup, jaccard_join, langid, mixing, quality, spelling, substring_dedup, toxicity, vector_codes, warc
from .common import crc_mod, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, labels)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, with_digests=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and of every third a twin some way off (cosine about 0.96), as the tables hold hardly any link."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    twin = F.transform("embedding", lambda x, i: x + 0.15 * F.sqrt(square / F.size("embedding")) * ((F.col("vec_id") * 31 + (i + 1) * 17) % 7 - 3))
    # the twin before its id: beside it in one select, the lambda would take the new vec_id for the old
    twins = v.where("vec_id % 3 = 0").select("vec_id", twin.alias("embedding"), "label")
    return v.unionByName(twins.withColumn("vec_id", F.col("vec_id") + 1_000_000_000))


def embedding_planted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(planted(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_messages(table(spark, sf_dir, "conversations"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    warc.write_archives(pages, folder, dictionary=warc.train_dictionary(pages))
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_bpe, op4_quality, op5_embedding_dedup, op6_jaccard_join, op7_chat_format, op8_passage_dedup, op9_mixing, op10_warc, op11_vector_codes, op12_spelling, op13_decontaminate, embedding_planted_links)}

SQL = {
    "op5_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a, count(*) as n from links group by a),
reach(s, t) as (select vec_id, vec_id from embeddings union select reach.s, links.b from reach join links on reach.t = links.a),
low as (select s, min(t) as c from reach group by s)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, low.c as component_id, e.vec_id = low.c as kept
from embeddings e join low on low.s = e.vec_id left join n on n.a = e.vec_id""",
    "op6_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
sh as (select doc_id, len(s) as n, unnest(s) as g from sets),
both_in as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
half as (select a, b from both_in where i >= 0.8 * (na + nb - i)),
links as (select a, b from half union all select b, a from half),
n as (select a, count(*) as n from links group by a),
reach(s, t) as (select doc_id, doc_id from documents union select reach.s, links.b from reach join links on reach.t = links.a),
low as (select s, min(t) as c from reach group by s)
select d.doc_id, coalesce(n.n, 0)::bigint as n_links, low.c as component_id, d.doc_id = low.c as kept
from documents d join low on low.s = d.doc_id left join n on n.a = d.doc_id""",
    "op9_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  md5(concat('11:', coalesce(doc_id::varchar, 'null'))) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1, 2, 3][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from s),
r as (select *, cap / weight as ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by ratio, encode(source) nulls last rows between current row and unbounded following) as level from r),
c as (select *, first_value(case when ratio > level then level end ignore nulls) over (order by ratio, encode(source) nulls last rows between unbounded preceding and unbounded following) as common from l),
t as (select source, source_size, case when common is null or ratio <= common then cap::double else weight * common end as target from c),
p as (select *, round(target)::bigint as goal, floor(round(target) / greatest(source_size, 1))::bigint as passes from t),
x as (select d.*, p.source_size, p.target, p.passes, p.goal - p.passes * p.source_size as part,
  coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (passes * size + greatest(least(start + size, part) - start, 0))::bigint as taken from x""",
    "op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as h from p),
bits as (select *, array_to_string(list_transform(range(1, 41), lambda j: lpad(bin(strpos('0123456789abcdef', substr(h, j::bigint, 1)) - 1), 4, '0')), '') as v,
  min(page_id) over (partition by h) as low from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast('0b' || substr(v, i::bigint * 5 + 1, 5) as bigint), 1)), '') as payload_digest,
  case when page_id = low then 'response' else 'revisit' end as record_type,
  case when page_id <> low then low end as refers_to from bits""",
}

_ROUND = """,
a{r} as materialized (select vec_id, part, first(e order by d, e) as e, min(d) as d from (select v.vec_id, v.part, c.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d from v join c{r} c using (part)) group by vec_id, part)"""
_MOVE = """,
s{r} as (select part, e, i, sum(x[i])::bigint as s, count(*)::bigint as n from v join a{r} using (vec_id, part), unnest(range(1, len(x) + 1)) as u(i) group by part, e, i),
m{r} as (select part, e, list((s - ((s % n) + n) % n) // n order by i) as x from s{r} group by part, e),
c{next} as materialized (select part, e, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} using (part, e))"""
SQL["op11_vector_codes"] = """
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as q from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, part, q[part * len(q) // 8 + 1:(part + 1) * len(q) // 8] as x from k, unnest(range(8)) as u(part)),
c0 as materialized (select part, e, x from v join (select vec_id, row_number() over (order by vec_id) - 1 as e from k order by vec_id limit 16) using (vec_id))""" + "".join(_ROUND.format(r=r) + (_MOVE.format(r=r, next=r + 1) if r < 6 else "") for r in range(7)) + """,
coded as (select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a6 group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) from c6) as codebooks_sha256
from coded join k using (vec_id)"""

SQL["op12_spelling"] = r"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents),
u as (select id, w, count(*) as n, hex(encode(id || ':' || w)) as b from runs where length(w) >= 6 group by id, w),
h as (select w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(b)::int, 2), lambda i: ('0x' || substr(b, i::bigint + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from u, crc),
words as (select case when h % 199 = 0 then left(w, (h % length(w))::bigint) || substr(w, (h % length(w) + 2)::bigint) else w end as word, sum(n)::bigint as n from h group by 1 having length(word) >= 6 and sum(n) >= 5),
cut as (select word, i, left(word, i) as a, substr(word, i + 2) as z from words, unnest(range(0, length(word))) as x(i)),
near as (select p.word, q.word as other from cut p join cut q on p.i = q.i and p.a = q.a and p.z = q.z and length(p.word) = length(q.word) and p.word <> q.word
  union select cut.word, o.word from cut join words o on o.word = cut.a || cut.z union select o.word, cut.word from cut join words o on o.word = cut.a || cut.z),
best as (select near.word, count(*)::bigint as n_near, first(other order by o.n desc, encode(other)) as other, max(o.n) as top from near join words o on o.word = near.other group by near.word),
f as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when top >= 5 * n then other end as form, case when top >= 5 * n then top end as form_n from words left join best using (word)),
chain(word, top_word) as (select word, word from f union all select chain.word, f.form from chain join f on f.word = chain.top_word where f.form is not null)
select f.word, f.n, n_near, form, form_n, top_word as root from f join chain on chain.word = f.word where top_word in (select word from f where form is null)"""

SQL["op13_decontaminate"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') as t from b, unnest(range(0, greatest(len(w) - 9, 1))) as u(i) where len(w) > 0),
places as (select r, n, i, array_to_string(w[i + 1:i + n], ' ') as t from d, (select distinct n from win), unnest(range(0, len(w) - n + 1)) as u(i)),
found as (select r, n, i, item from places join win using (n, t)),
hit as (select r, count(distinct p) as n_hit from (select distinct r, n, i from found), unnest(range(i, i + n)) as u(p) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by encode(item)) as ids from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)"""

_PLANTED = """with recursive base as (select vec_id, cast(embedding as double[]) as embedding, label from embeddings),
planted as (select * from base union all select vec_id + 1000000000, list_transform(embedding, lambda x, i: x + 0.15 * sqrt(list_inner_product(embedding, embedding) / len(embedding)) * ((vec_id * 31 + i * 17) % 7 - 3)), label from base where vec_id % 3 = 0),
"""
SQL["embedding_planted_links"] = SQL["op5_embedding_dedup"].replace("from embeddings", "from planted").replace("with recursive ", _PLANTED, 1)
