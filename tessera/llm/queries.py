"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, embedding_dedup, html_extraction, language_id, mixing, ngram_join, sharding, token_counts, toxicity, url_filter
from tessera.llm._io import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spread_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spread_table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(spread_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(spread_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_toxicity,
        op3_mixing,
        op4_url_filter,
        op5_decontamination,
        op6_sharding,
        op7_html_extraction,
        op8_ngram_join,
        op9_token_counts,
        op10_embedding_dedup,
    )
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Where SQL can say the same; learned models, the library's tokens and seeded orders it cannot.
SQL: dict[str, str] = {
    "op5_decontamination": rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null and text is not null),
win as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from grams join win using (n, g)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join items using (doc_id)""",
    "op8_ngram_join": rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct doc_id, hash(g) g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y using (g) where x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, m component_id from d left join n using (doc_id) join (select a doc_id, min(b) m from r group by a) using (doc_id)""",
    "op10_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id a, y.vec_id b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
select vec_id, coalesce(n, 0) n_links, m component_id, vec_id = m kept from embeddings left join (select a vec_id, count(*) n from l group by a) using (vec_id) join (select a vec_id, min(b) m from r group by a) using (vec_id)""",
}
