"""Registered queries: identities, requests, study exports, samples and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agreement, embed, pairing, requests, resample, study
from ..sources import io
from ..streaming import ingest
from .more import ASG, RATERS, study_frames, two_raters, vectors
from .queries import register, rounded, table


@register("select doc_id, (doc_id % 5)::int as part from documents")
def modulo_parts(spark, sf_dir):
    """The table as the five splits of a modulo partition, put together again."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    out = None
    for k in range(5):
        one = resample.modulo_split(d, 5, k, "doc_id").withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@register("""with k as (select d.doc_id as key, 'u' || d.n_chars as url from documents d where d.doc_id in (select doc_id from labels)), j as (select * from k where url in (select 'u' || length(html) from pages union all select 'u' || n_chars from documents where lang = 'en')),
t as (select *, row_number() over (order by sha256('5:' || key::varchar)) as r from j), m as (select 'u' || n_chars as url, min(doc_id % 3) as stable_id from documents group by 1 having min(doc_id % 3) = max(doc_id % 3)) select key, url, stable_id from t join m using (url) where r <= 100""")
def four_way(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("u"), F.col("n_chars").cast("string")).alias("url")
    a, c = d.select(F.col("doc_id").alias("key")), d.select(F.col("doc_id").alias("key"), url)
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    by_url = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.length("html").cast("string")).alias("url")).unionByName(d.where("lang = 'en'").select(url))
    return pairing.four_way(a, b, c, by_url, d.select(url, (F.col("doc_id") % 3).alias("stable_id")), 100, 5)


@register("select doc_id, case when text is not null then 'sha256:' || sha256(text) else 'url_sha256:' || sha256('http://a.example/' || doc_id::varchar) end as image_key from documents")
def image_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.image_key(F.sha2("text", 256), F.lit(None).cast("string"), F.concat(F.lit("HTTP://A.example/"), F.col("doc_id").cast("string"))).alias("image_key"))


_SHARD = r"regexp_extract(path, '(?:^|/)([^_/]+)__+([^/]+?)(\.(?:jpg|jpeg|png|webp))$', {k}, 'i')"


@register("with p as (select doc_id, 'data/' || source || '__' || doc_id || case when lang = 'en' then '.JPG' when lang = 'de' then '.png' else '.txt' end as path from documents) select doc_id, " + ", ".join(f"nullif({v}, '') as {n}" for n, v in (("shard", _SHARD.format(k=1)), ("key", _SHARD.format(k=2)), ("suffix", f"lower({_SHARD.format(k=3)})"))) + " from p")
def shard_paths(spark, sf_dir):
    end = F.when(F.col("lang") == "en", ".JPG").when(F.col("lang") == "de", ".png").otherwise(".txt")
    d = table(spark, sf_dir, "documents").select("doc_id", X.shard_path(F.concat(F.lit("data/"), "source", F.lit("__"), F.col("doc_id").cast("string"), end)).alias("p"))
    return d.select("doc_id", "p.*")


@register(r"select doc_id::varchar as caption_id, 'local' as surface, doc_id as source_row, 32::int as token_budget, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x85\xa0]+'), lambda w: w <> '')[1:32], ' ') as caption from documents")
def request_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return requests.extraction_requests(d, 32, "local").drop("request_id")


@register("select count(distinct doc_id) as requests, count(distinct doc_id) as ids, true as right_length from documents")
def request_id_properties(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    r = requests.extraction_requests(d, 32, "local")
    return r.agg(F.count_distinct("source_row").alias("requests"), F.count_distinct("request_id").alias("ids"), F.min(F.length("request_id") == 32).alias("right_length"))


@register("select o_orderkey as request_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N')")
def resumed_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_returnflag") == "N").alias("ok"))
    return requests.resume(asked, log)


@register("select o_orderkey as source_row, o_custkey, c_name from orders join customer on o_custkey = c_custkey")
def rows_of_requests(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_row"), "o_custkey", F.col("o_orderkey").alias("order"))
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_row"), "c_name")
    return requests.at_rows(asked, source).select(F.col("order").alias("source_row"), "o_custkey", "c_name")


@register("with i as (select coalesce(nullif(trim(p_brand), ''), 'row:' || p_partkey) as image, p_partkey from part) select image, 'Describe' as prompt from i group by 1" )
def caption_request_images(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("image_path"), F.lit(None).cast("string").alias("image_url"), F.col("p_partkey").alias("row"))
    return requests.caption_requests(rows, "Describe").select("image", "prompt")


@register("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def rows_where_in(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return io.read_where_in(spark, f"{sf_dir}/customer.parquet", "c_custkey", keys).select("c_custkey", "c_name")


@register(r"select p_partkey, len(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w <> '')) as tags from part")
def tag_counts(spark, sf_dir):
    return io.tag_columns(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"]).select("p_partkey", F.size("p_name").cast("long").alias("tags"))


@register(f"with {ASG}, w as (select *, case when phase = 'caption' then 0 else 1 end as ph from asg where participant = 3 and status <> 'complete') select position, phase from w order by ph, position limit 1")
def study_next_task(spark, sf_dir):
    return study.next_task(study_frames(spark, sf_dir)[1], 3).select("position", "phase")


_EXPORT = """base as (select l_partkey as item_id, l_suppkey as participant, case when l_linenumber % 2 = 0 then 'caption' else 'image' end as phase, l_returnflag as label from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0),
panel as (select item_id, phase from base group by 1, 2 having count(distinct participant) >= 3 and count(distinct label) > 1),
adj as (select p_partkey as item_id, 'image' as phase, 'A' as adjudicated from part where p_size > 25), rows as (select base.*, adjudicated from base left join (select adj.* from adj join panel using (item_id, phase)) using (item_id, phase))"""


def _export(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    a = li.select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("participant"), F.when(F.col("l_linenumber") % 2 == 0, "caption").otherwise("image").alias("phase"), F.col("l_returnflag").alias("label"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("participant"), (F.col("s_acctbal") > 0).alias("eligible"))
    adj = part.where("p_size > 25").select(F.col("p_partkey").alias("item_id"), F.lit("image").alias("phase"), F.lit("A").alias("adjudicated"))
    return study.export_rows(a, part.select(F.col("p_partkey").alias("item_id")), people, adj, 3, ["label"])


@register(f"with {_EXPORT} select item_id, phase, participant, label, adjudicated from rows")
def study_export(spark, sf_dir):
    return _export(spark, sf_dir).select("item_id", "phase", "participant", "label", "adjudicated")


@register(f"with {_EXPORT}, n as (select item_id, phase, label, count(*) as n, max(adjudicated) as adjudicated from rows group by 1, 2, 3), g as (select item_id, phase, max(adjudicated) as adjudicated, sum(n) as raters, max_by(label, n) as top, max(n) as most from n group by 1, 2) select item_id, phase, coalesce(adjudicated, case when raters >= 2 and 2 * most > raters then top end) as value from g")
def study_consensus(spark, sf_dir):
    return study.consensus_or_adjudicated(_export(spark, sf_dir), "label")


_CODES = ["caption", "image", "other"]


@register("""with e as (select event_id, ['caption','image','other'][event_id % 3 + 1] as phase, case when value > 50 then 'correct' when value > 20 then 'incorrect' end as chk, case when user_id % 2 = 0 then 'object' end as corrected, case when user_id % 3 = 0 then 'yes' end as support, (event_id % 7)::int as conf from events)
select event_id, list_filter([case when phase not in ('caption','image') then 'phase' end, case when phase = 'caption' and chk is null then 'category_check' end, case when phase = 'caption' and chk = 'incorrect' and corrected is null then 'corrected_category' end,
case when phase = 'caption' and coalesce(chk, '') <> 'incorrect' and corrected is not null then 'needless_correction' end, case when phase = 'image' and support is null then 'image_support' end, case when phase = 'image' and conf not between 1 and 5 then 'confidence' end], lambda x: x is not null) as problems from e""")
def study_label_problems(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    phase = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % 3 + 1).cast("int"))
    payload = {
        "category_check": F.when(F.col("value") > 50, "correct").when(F.col("value") > 20, "incorrect"), "corrected_category": F.when(F.col("user_id") % 2 == 0, "object"),
        "image_support": F.when(F.col("user_id") % 3 == 0, "yes"), "confidence": (F.col("event_id") % 7).cast("int"),
    }
    return e.select("event_id", study.annotation_problems(phase, payload, ("object",)).alias("problems"))


@register("with r as (select o_orderpriority as surface, o_orderstatus <> 'P' as ok, case when o_orderkey % 5 = 0 then null else o_orderkey % 3 end as k, case when o_totalprice > 200000 then 'length' else 'stop' end as finish from orders), v as (select *, ok and k is not null as valid from r) select surface, count(*) as responses, count(*) filter (valid) as valid, count(*) filter (not valid) as invalid, count(*) filter (finish = 'length') as truncated, count(*) filter (valid and k = 0) as valid_zero_claims from v group by 1")
def request_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    units = F.when(F.col("o_orderkey") % 5 != 0, F.array_repeat(F.struct(F.lit("x").alias("unit")), (F.col("o_orderkey") % 3).cast("int")))
    rows = o.select(F.col("o_orderpriority").alias("surface"), (F.col("o_orderstatus") != "P").alias("ok"), F.struct(units.alias("claimed_units")).alias("parsed"), F.when(F.col("o_totalprice") > 200000, "length").otherwise("stop").alias("finish"))
    return requests.extraction_status(rows)


@register("with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 1 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts) as s from g) select user_id, min(ts) as session_start, max(ts) + interval 1 hour as session_end, count(*) as n from s group by user_id, s")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "1 hour", "1 hour")


@register("select (l_returnflag)::varchar as g, count(*) as n, round(100 * sum(l_discount) / sum(l_quantity), 6) as estimate from lineitem group by 1")
def ratio_estimates(spark, sf_dir):
    """The estimates of a ratio; its resampled interval has no SQL form."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_suppkey").agg(F.sum("l_discount").alias("a"), F.sum("l_quantity").alias("b"), F.count("*").alias("rows"))
    est = resample.bootstrap(li, "g", ["a", "b"], resample.ratio_statistic, reps=50).select("g", "estimate")
    return rounded(est.join(li.groupBy("g").agg(F.sum("rows").alias("n")), "g").select("g", "n", "estimate"))


_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"


@register(f"with v as (select vec_id, coalesce(label::varchar, '?') as label, embedding::double[] as v from embeddings), p as (select a.label, avg({_COS}) as c from v a join v b on a.label = b.label and a.vec_id <> b.vec_id group by 1), n as (select label, count(*) as n from v group by 1) select label, n, round(coalesce(c, 0), 6) as pairwise_cosine from n left join p using (label)")
def embed_pairwise_cosine(spark, sf_dir):
    return rounded(embed.geometry(vectors(spark, sf_dir), "label").select("label", "n", "pairwise_cosine"))


@register("with r as (select vec_id, (row_number() over (order by sha256('0' || chr(0) || vec_id::varchar), vec_id) - 1)::bigint as i, count(*) over () as n from embeddings) select vec_id, least(i // 64, greatest(0, n // 64 - case when 2 * (n % 64) < 64 then 1 else 0 end))::bigint as block from r")
def embed_blocks(spark, sf_dir):
    return embed.block_numbers(vectors(spark, sf_dir), 64).select(F.col("id").alias("vec_id"), "block")


@register("with s as (select doc_id, coalesce(lang, '?') as lang, count(*) over (partition by coalesce(lang, '?')) as population, row_number() over (partition by coalesce(lang, '?') order by sha256('7' || chr(0) || doc_id::varchar), doc_id) as r from documents), t as (select lang, doc_id::varchar as doc_id, population / least(population, 20) as weight from s where r <= 20), q as (select *, row_number() over (partition by lang order by sha256('7:repeat' || chr(0) || doc_id), doc_id) as r, count(*) over (partition by lang) as n from t) select lang, doc_id, null::varchar as repeat_of, round(weight, 6) as weight from t union all select lang, doc_id || ':repeat', doc_id, 0 from q where r <= ceil(n * 0.1)")
def sample_repeats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    s = resample.stratified(d, ["lang"], 20, 7, "doc_id").select("lang", "doc_id", "weight")
    return rounded(resample.with_repeats(s, 0.1, 7, "doc_id", ["lang"]).select("lang", "doc_id", "repeat_of", "weight"))


_STUDY = "st as (select l_partkey as item_id, l_partkey % 40 as item_group, l_suppkey as participant, case when l_linenumber % 2 = 0 then 'caption' else 'image' end as phase, l_returnflag as label, case when l_linestatus = 'F' then 'x' end as repeat_of from lineitem)"


def _study_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("item_id"), (F.col("l_partkey") % 40).alias("item_group"), F.col("l_suppkey").alias("participant"), F.when(F.col("l_linenumber") % 2 == 0, "caption").otherwise("image").alias("phase"),
        F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "F", "x").alias("repeat_of"),
    )


@register(f"""with {_STUDY}, l as (select item_group, item_id, participant, max(label) as label from st where phase = 'image' and repeat_of is null and label is not null group by 1, 2, 3), p as (select a.item_group, a.item_id, a.label = b.label as same from l a join l b on a.item_id = b.item_id and a.participant < b.participant)
select 'label' as field, 'image' as phase, count(distinct item_id) as items, count(*) as pairs, count(distinct item_group) as clusters, round(avg(same::int), 6) as exact from p""")
def study_field_agreement(spark, sf_dir):
    return rounded(agreement.field_agreement(_study_rows(spark, sf_dir), "label", "image", reps=200).drop("low", "high"))


@register(f"with {_STUDY} select phase, count(*) as annotations, count(distinct case when repeat_of is null then item_id end) as items, count(distinct case when repeat_of is not null then item_id end) as repeats, count(distinct participant) as participants, count(distinct item_group) as clusters from st group by rollup (phase)")
def study_sample_summary(spark, sf_dir):
    return agreement.sample_summary(_study_rows(spark, sf_dir))


@register(f"with {RATERS}, g as (select category, count(*) as n from rt group by 1) select category, n, (row_number() over (order by case category when 'fr' then 0 when 'de' then 1 else 2 end, category))::int as place from g")
def report_order(spark, sf_dir):
    g = two_raters(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    # a report's few rows, numbered in their order
    return agreement.ordered(g, "category", ("fr", "de")).withColumn("one", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("one"))).drop("one")
