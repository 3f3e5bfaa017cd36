"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, decontam, divergence, embed_dedup, langid, lm, negatives, packing, pii, quality, token_counts, token_ids
from harrow.llm.common import documents
from harrow.llm.minhash import near_duplicates


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), width=4)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), path, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(spark, documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.write_and_read(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, documents(spark, sf_dir))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.mine(spark, vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, case when len(w) < 4 then w else w[i:i+3] end as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
overlap as (
  select a.doc_id as a, b.doc_id as b, count(*) as i
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select o.a, o.b from overlap o join sizes x on x.doc_id = o.a join sizes y on y.doc_id = o.b
  where 100 * o.i >= 80 * (x.n + y.n - o.i)),
reach(id, to_id) as (
  select doc_id, doc_id from documents
  union
  select r.id, l.b from reach r join links l on l.a = r.to_id)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes s using (doc_id)
join (select id, min(to_id) as component_id from reach group by id) c on c.id = d.doc_id
"""

OP9_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(id, to_id) as (select vec_id, vec_id from v union select r.id, l.b from reach r join links l on l.a = r.to_id)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v left join (select a, count(*) as n from links group by a) on a = vec_id
join (select id, min(to_id) as component_id from reach group by id) on id = vec_id
"""

OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as s
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
good as (select * from (select *, row_number() over (partition by anchor_id order by s desc, vec_id) as r from scored where same) where r <= 5),
bad as (
  select g.anchor_id, g.vec_id as positive_id, n.vec_id as negative_id, g.s as positive_score, n.s as negative_score,
    row_number() over (partition by g.anchor_id, g.vec_id order by n.s desc, n.vec_id) as rank
  from good g join scored n on n.anchor_id = g.anchor_id and not n.same and 30 * g.s <= 100 * n.s and 100 * n.s <= 90 * g.s)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from bad where rank <= 10
"""

OP12_SQL = r"""
with docs as (select row_number() over () as r, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
occurrences as (
  select r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as (select lang, term, count(*)::bigint as n from occurrences group by 1, 2 having count(distinct r) >= 30),
sizes as (select lang, count(*)::bigint as v, sum(n)::bigint as total from kept group by 1),
counts as (select o.lang, o.source, o.term, count(*)::bigint as n from occurrences o join kept k on k.lang = o.lang and k.term = o.term group by 1, 2, 3),
totals as (
  select g.lang, g.source, coalesce(c.total, 0) as total from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n)::bigint as total from counts group by 1, 2) c on c.lang = g.lang and c.source = g.source),
shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
    (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v))::bigint as p, (1 + (1000000000::hugeint * (k.n + 5)) // (s.total + 5 * s.v))::bigint as q
  from totals t join sizes s on s.lang = t.lang join kept k on k.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from totals a join totals b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


def queries() -> dict:
    return {"op1_minhash": op1_minhash, "op2_personal_data": op2_personal_data, "op3_token_counts": op3_token_counts, "op4_token_ids": op4_token_ids, "op5_katz": op5_katz, "op6_quality": op6_quality, "op7_byte_bpe": op7_byte_bpe, "op8_language": op8_language, "op9_embeddings": op9_embeddings, "op10_leaks": op10_leaks, "op11_negatives": op11_negatives, "op12_divergence": op12_divergence, "op13_packing": op13_packing}


def oracle_sql() -> dict:
    return {"op1_minhash": OP1_SQL, "op9_embeddings": OP9_SQL, "op11_negatives": OP11_SQL, "op12_divergence": OP12_SQL}
