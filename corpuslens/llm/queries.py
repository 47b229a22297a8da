"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, packing, pieces, quality, secrets, simhash, topk, toxicity, urls, warc
from .common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.train(pages))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_url_filters: its rows without the verdict of the trees."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive, then reads it; payloads are decoded and checked against their headers."""
    found = warc.read_archive(spark, warc.write_archive(read(spark, sf_dir, "pages")), payload="verify")
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scans, op2_url_filters, url_rules, op3_quality, op4_simhash_near_dedup, op5_embedding_near_dedup, op6_top_products, op7_packing, op8_pieces, op9_warc, op10_toxicity)}


URL_RULES_SQL = """
with u as (select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages),
r as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from u),
h as (
  select page_id, regexp_extract(rest, '^[^/?#]*', 0) as own, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from r),
p as (select page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
rules(verdict, rule) as (values ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
parts as (select verdict, rule, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules),
best as (
  select p.host, p.path, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) as b
  from (select distinct host, path from p) p join parts on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by p.host, p.path)
select p.page_id, p.host, p.path, best.b.rule as rule, best.b.verdict as verdict
from p left join best on p.host = best.host and p.path = best.path
"""

OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
m as (select h, max(page_id) as last from d where n >= 1000 group by h)
select d.page_id, d.n::bigint as payload_bytes, d.h as payload_digest,
  case when m.last is not null and d.page_id is distinct from m.last then 'revisit' else 'response' end as record_type,
  case when m.last is not null and d.page_id is distinct from m.last then m.last end as refers_to
from d left join m on d.h = m.h and d.n >= 1000
"""


#: Components by the transitive closure, for tables whose groups are small.
OP5_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (
  select r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (
  select a.r as a, b.r as b from s a join s b on a.r <> b.r and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
low as (select reach.a as r, min(v.vec_id) as low from reach join v on v.r = reach.b group by reach.a),
n as (select a as r, count(*) as n from link group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least(v.vec_id, low.low) as component_id,
  coalesce(v.vec_id = least(v.vec_id, low.low), false) as kept
from v left join low on low.r = v.r left join n on n.r = v.r
"""

OP6_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::hugeint) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by r order by score desc, vec_id nulls last)::int as rank, vec_id, score
from p qualify rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"url_rules": URL_RULES_SQL, "op5_embedding_near_dedup": OP5_SQL, "op6_top_products": OP6_SQL, "op9_warc": OP9_SQL}
