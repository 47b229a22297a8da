"""Registered queries: pairing, claims, agreement, embeddings, samples, study analytics, requests and relational parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agreement, claims, embed, pairing, requests, resample, study
from ..sources import io
from . import queries as core
from .queries import TOKENS, register, rounded, table

# ---- Keys and predicates -----------------------------------------------------------------------------------------
NORM_URL = r"""case when regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)', 1), '\?$', '') else trim(url) end"""


@register(f"select page_id, {NORM_URL} as url_key, case when length(page_id::varchar) < 9 then lpad(page_id::varchar, 9, '0') else page_id::varchar end as zero_key, sha1('pages' || chr(0) || page_id::varchar || chr(0) || url) as pair_id, page_id % 16 as shard from pages")
def key_forms(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ident = F.col("page_id").cast("string")
    return p.select("page_id", X.normalize_key(F.col("url"), "url").alias("url_key"), X.normalize_key(ident, "zfill9").alias("zero_key"), X.pair_id(F.lit("pages"), ident, F.col("url")).alias("pair_id"), X.shard_of(ident, 16).alias("shard"))


@register(r"""with p as (select page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) as t from pages)
select page_id, length(t) as chars, not (regexp_matches(t, '(?i)https?://|www\.') or regexp_matches(t, '(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}') or regexp_matches(t, '(^|[^0-9])\+?[0-9][0-9\s().-]{7,}[0-9]($|[^0-9])')
or regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(""" + "|".join(X.UNSAFE_WORDS) + r""")($|[^\p{L}\p{N}_])')) as safe, array_to_string(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')[1:16], ' ') as window16 from p""")
def prompt_forms(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", X.normalize_prompt(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), X.is_safe_prompt(F.col("t")).alias("safe"), X.word_budget(F.col("t"), 16).alias("window16"))


@register(r"""with d as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*') as t, lang || ' ' as s from documents), e as (select *, split_part(text, ' ', 1) as span from d)
select doc_id, len(t) as tokens, case when len(t) > 8 then regexp_extract_all(regexp_extract(text, '^(?s:(?:[^\p{L}\p{N}]*[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*){8})'), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*') else t end as window_tokens,
case when span = '' then 'missing' when instr(text, span) = 0 then 'not_found' when instr(text[instr(text, span) + 1:], span) > 0 then 'ambiguous' else 'exact_unique_text' end as span_status from e""")
def text_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    window = X.lexical_budget(F.col("text"), 8)
    return d.select("doc_id", X.token_count(F.col("text")).alias("tokens"), X.tokens(window, lower=False).alias("window_tokens"), X.exact_span(F.col("text"), F.split_part("text", F.lit(" "), F.lit(1)))["status"].alias("span_status"))


# ---- Pairing and deduplication -----------------------------------------------------------------------------------
@register(f"""with p as (select page_id, {NORM_URL} as k from pages), r as (select regexp_replace(k, '[0-9]+.*$', '') as k, page_id from p where k <> ''), f as (select k, min(page_id) as page_id, count(*) as n from r group by 1) select k as key, page_id, n from f""")
def pair_first_wins(spark, sf_dir):
    """The first page of each URL family."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(X.normalize_url(F.col("url")), r"[0-9]+.*$", "").alias("key"), "page_id", F.lit(1).alias("one")).where("key <> ''")
    sizes = p.groupBy("key").agg(F.count("*").alias("n"))
    return pairing.first_by(p, ["key"], "page_id").join(sizes, "key").select("key", "page_id", "n")


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("lookup"), F.col("o_orderkey").alias("pos"))


@register("""with m as (select l_orderkey as key, floor(l_quantity)::int as width, l_linenumber::int * 10 as height, l_linenumber::bigint * 10000000 + l_partkey as pos from lineitem), f as (select key, min_by(width, pos) as width, min_by(height, pos) as height from m group by 1),
j as (select f.key is not null as found, coalesce(least(width, height) >= 10, false) as ok from orders left join f on o_orderkey = f.key)
select count(*) filter (found and ok) as matched, count(*) filter (not found) as missing, count(*) filter (found and not ok) as rejected from j""")
def pair_manifest_counts(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.floor("l_quantity").cast("int").alias("width"), (F.col("l_linenumber").cast("int") * 10).alias("height"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("pos"))
    return pairing.attach_manifest(_local(spark, sf_dir), m, 10)[1]


@register("""with l as (select o_custkey as lookup, max(o_orderkey) as key from orders group by 1), p as (select c_custkey as lookup, min_by(c_name, c_custkey) as cap from customer where trim(coalesce(c_name, '')) <> '' group by 1)
select lookup, key, cap as public_caption from l join p using (lookup)""")
def pair_public(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lookup"), F.col("c_name").alias("caption"), F.col("c_custkey").alias("pos"))
    return pairing.attach_public(_local(spark, sf_dir), c).select("lookup", "key", "public_caption")


@register("""select o_orderkey as key from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 40) and o_orderkey in (select l_orderkey from lineitem where l_discount > 0.05) group by 1""")
def pair_common_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key")
    return pairing.common_keys(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), li.where("l_quantity > 40"), li.where("l_discount > 0.05"))


@register("""with w as (select o_orderkey as key, o_custkey as a, o_orderstatus as b from orders), c as (select l_orderkey as key, l_linenumber as cand, l_suppkey as a, l_linestatus as b from lineitem),
s as (select w.key, cand, (case when w.a = c.a then 2 else 0 end + case when w.b = c.b then 1 else 0 end) as score from w join c using (key)), g as (select key, score, count(*) as n, min(cand) as cand from s group by 1, 2),
m as (select *, row_number() over (partition by key order by score desc) as r from g) select key, cand, score::int as score from m where r = 1 and score > 0 and n = 1""")
def pair_scored_match(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("cand"), F.col("l_suppkey").alias("a"), F.col("l_linestatus").alias("b"))
    return pairing.scored_match(w, c, {"a": 2, "b": 1})


@register("""with x as (select l_orderkey as sample_id, count(*) as n, min(l_linestatus) as u, min(l_returnflag) as s from lineitem group by 1), i as (select o_orderkey as sample_id, 'O' as url, 'N' as suffix from orders)
select sample_id, case when n is null then 'missing' when n > 1 then 'repeated' when url is distinct from u then 'url' when suffix is distinct from s then 'suffix' end as reason from i left join x using (sample_id)""")
def pair_exactly_one(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("O").alias("url"), F.lit("N").alias("suffix"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("url"), F.col("l_returnflag").alias("suffix"))
    return pairing.exactly_one(items, m)


@register("select c_custkey as image_id from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
def pending_work(spark, sf_dir):
    return pairing.pending(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id")), table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("image_id")))


@register("select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def latest_by_request(spark, sf_dir):
    return pairing.last_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@register("select user_id, max_by(event_id, (case when event_type = 'purchase' then 1 else 0 end, event_id)) as event_id from events where user_id is not null group by 1")
def latest_answered(spark, sf_dir):
    return pairing.latest_answered(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@register(r"""with r as (select coalesce(source, '?') as source, trim(regexp_replace(text, '\s+', ' ', 'g')) as prompt, doc_id as raw_index from documents), f as (select source, lower(prompt) as l, min(raw_index) as raw_index, min_by(prompt, raw_index) as prompt from r where prompt <> '' group by 1, 2),
t as (select source, sha256(l) as prompt_hash, len(regexp_extract_all(prompt, '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*'))::int as tokens_lexical, raw_index, prompt as p from f)
select source, prompt_hash, tokens_lexical, raw_index from t where tokens_lexical between 5 and 600 and not (regexp_matches(p, '(?i)https?://|www\.') or regexp_matches(p, '(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}')
or regexp_matches(p, '(^|[^0-9])\+?[0-9][0-9\s().-]{7,}[0-9]($|[^0-9])') or regexp_matches(p, '(?i)(^|[^\p{L}\p{N}_])(""" + "|".join(X.UNSAFE_WORDS) + r""")($|[^\p{L}\p{N}_])'))""")
def prompt_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.col("text").alias("prompt"), F.col("doc_id").alias("raw_index"))
    return pairing.prompt_pool(d, 5, 600).select("source", "prompt_hash", "tokens_lexical", "raw_index")


@register("""with a as (select distinct o_custkey % 100 as v from orders), b as (select distinct c_custkey % 90 as v from customer) select v, 'expected' as side from (select v from a except select v from b) union all select v, 'observed' from (select v from b except select v from a)""")
def set_differences(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("v"))
    return pairing.set_difference(a, table(spark, sf_dir, "customer").select((F.col("c_custkey") % 90).alias("v")))


@register("select l_partkey, count(distinct l_suppkey) as groups from lineitem group by 1 having count(distinct l_suppkey) > 1")
def group_overlaps(spark, sf_dir):
    return pairing.overlaps(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


# ---- Claims and judges -------------------------------------------------------------------------------------------
#: Lines of a document stand for claims: category by place, unit the line's first three words, target its fourth.
def claim_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n")
    cats = F.array(*[F.lit(c) for c in X.CATEGORIES])
    made = F.transform(lines, lambda t, i: F.struct(F.element_at(cats, (i % 8 + 1).cast("int")).alias("category"), F.array_join(F.slice(F.split(t, " "), 1, 3), " ").alias("unit"), F.get(F.split(t, " "), F.lit(3)).alias("target")))
    return d.select(F.col("doc_id").alias("caption_id"), F.coalesce("lang", F.lit("?")).alias("surface"), X.token_count(F.col("text")).alias("tokens"), made.alias("claims"))


_ART = "['a','an','the']"
_TK = r"regexp_extract_all(lower(coalesce({c},'')), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)*')"
_NORM = lambda c: f"(case when coalesce(list_position(list_transform({_TK.format(c=c)}, lambda t: not list_contains({_ART}, t)), true), 0) > 0 then array_to_string({_TK.format(c=c)}[list_position(list_transform({_TK.format(c=c)}, lambda t: not list_contains({_ART}, t)), true):], ' ') else '' end)"
CLAIMS = f"""ln as (select doc_id as caption_id, coalesce(lang, '?') as surface, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents where text is not null),
cl as (select caption_id, surface, idx, {core._in(X.CATEGORIES)}[idx % 8 + 1] as category, array_to_string(string_split(line, ' ')[1:3], ' ') as unit, string_split(line, ' ')[4] as target from ln),
ck as (select *, {_NORM("unit")} as norm, {_NORM("target")} as target_norm from cl),
per as (select caption_id, category, norm, target_norm, count(*) as n, category = 'text_rendering' and (contains(norm, 'no text') or contains(norm, 'no visible') or contains(norm, 'not visible') or contains(norm, 'without text')) as susp from ck group by 1, 2, 3, 4),
pc as (select caption_id, sum(n)::bigint as claimed, count(*) filter (norm <> '' and not susp) as deduped, count(*) filter (norm <> '') as deduped_all, sum(case when norm <> '' then n - 1 else 0 end)::bigint as duplicates, count(*) filter (norm <> '' and susp) as suspicious from per group by 1)"""


@register(f"with {CLAIMS} select caption_id, claimed, deduped, duplicates, suspicious from pc")
def claims_dedup_summary(spark, sf_dir):
    return claims.deduplicated(claims.explode_claims(claim_frame(spark, sf_dir)), ["caption_id"])


@register(f"with {CLAIMS} select caption_id, deduped_all as deduped from pc")
def claims_dedup_export(spark, sf_dir):
    return claims.deduplicated(claims.explode_claims(claim_frame(spark, sf_dir)), ["caption_id"], drop_absent_text=False).select("caption_id", "deduped")


@register(rf"""with {CLAIMS}, s as (select caption_id, category, idx, trim(regexp_replace(lower(coalesce(unit, '')), '\s+', ' ', 'g')) as unit, trim(regexp_replace(lower(coalesce(target, '')), '\s+', ' ', 'g')) as target from cl)
select caption_id, category, unit, target, min(idx)::int as idx from s where unit <> '' group by 1, 2, 3, 4""")
def claims_dedup_builder(spark, sf_dir):
    return claims.builder_dedup(claims.explode_claims(claim_frame(spark, sf_dir)), ["caption_id"])


@register(f"""with {CLAIMS}, c as (select doc_id as caption_id, coalesce(lang, '?') as surface, len({TOKENS}) as tokens from documents where text is not null), j as (select c.*, coalesce(claimed, 0) as claimed, coalesce(deduped, 0) as deduped, coalesce(duplicates, 0) as duplicates, coalesce(suspicious, 0) as suspicious from c left join pc using (caption_id)),
k as (select * from j union all select caption_id, '__all__', tokens, claimed, deduped, duplicates, suspicious from j)
select surface, count(*) as captions, sum(tokens)::bigint as tokens, sum(claimed)::bigint as claimed, sum(deduped)::bigint as deduped, sum(duplicates)::bigint as duplicates, sum(suspicious)::bigint as suspicious, count(*) filter (duplicates > 0) as rows_with_duplicate, count(*) filter (suspicious > 0) as rows_with_suspicious,
round(sum(claimed) / count(*), 6) as claimed_per_caption, round(sum(deduped) / count(*), 6) as deduped_per_caption, round(100 * sum(deduped) / sum(tokens), 6) as deduped_per_100 from k group by 1""")
def claims_summary(spark, sf_dir):
    frame = claim_frame(spark, sf_dir)
    per = claims.deduplicated(claims.explode_claims(frame), ["caption_id"])
    return rounded(claims.claimed_summary(frame.select("caption_id", "surface", "tokens"), per))


@register("""with l as (select event_id, ['grounded','unsupported','uncertain'][event_id % 3 + 1] as verdict, event_type as surface from events)
select surface, count(*) as claimed, count(*) filter (verdict = 'grounded') as grounded, count(*) filter (verdict = 'unsupported') as unsupported, count(*) filter (verdict = 'uncertain') as uncertain, round(count(*) filter (verdict = 'grounded') / count(*), 6) as precision, round(count(*) filter (verdict = 'unsupported') / count(*), 6) as unsupported_rate, round(count(*) filter (verdict = 'uncertain') / count(*), 6) as uncertain_rate from l group by 1""")
def claims_grounded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("surface"), F.element_at(F.array(F.lit("grounded"), F.lit("unsupported"), F.lit("uncertain")), (F.col("event_id") % 3 + 1).cast("int")).alias("verdict"))
    return rounded(claims.grounded_summary(e))


_ST = core._in(claims.STATUSES)


@register(f"""with l as (select event_type as surface, 'c' || (user_id % 4) as category, {_ST}[event_id % 6 + 1] as status from events), g as (select surface, category, count(*) as units, count(*) filter (status <> 'not_visual') as visual, """ + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in claims.STATUSES) + " from l group by 1, 2) select *, " + ", ".join(f"round({s} / units, 6) as {s}_rate, round(case when visual > 0 then {s} / visual else 0 end, 6) as {s}_visual_rate" for s in claims.STATUSES) + " from g")
def claims_statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("surface"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("category"), F.element_at(F.array(*[F.lit(s) for s in claims.STATUSES]), (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    return rounded(claims.status_rates(e))


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as questions: two judges (by flag and mode), slices by status, requests by order."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda c: F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("uncertain")), (c % 3 + 1).cast("int"))
    base = li.select(F.col("l_linestatus").alias("slice"), F.col("l_orderkey").alias("request_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("question_id"), F.element_at(F.array(*[F.lit(c) for c in X.CATEGORIES]), (F.col("l_linenumber") % 8 + 1).cast("int")).alias("category"), F.col("l_returnflag").alias("surface"), "l_partkey", "l_suppkey", "l_discount")
    one = base.withColumn("judge", F.lit("j1")).withColumn("answer", pick(F.col("l_partkey")))
    two = base.where("l_discount > 0").withColumn("judge", F.lit("j2")).withColumn("answer", pick(F.col("l_suppkey")))
    return one.unionByName(two).drop("l_partkey", "l_suppkey", "l_discount")


_ANS = "['yes','no','uncertain']"
JUDGES = f"""jb as (select l_linestatus as slice, l_orderkey as request_id, l_orderkey || ':' || l_linenumber as question_id, {core._in(X.CATEGORIES)}[l_linenumber % 8 + 1] as category, l_returnflag as surface, l_partkey as pk, l_suppkey as sk, l_discount as disc from lineitem),
ja as (select slice, request_id, question_id, category, surface, 'j1' as judge, {_ANS}[pk % 3 + 1] as answer from jb union all select slice, request_id, question_id, category, surface, 'j2', {_ANS}[sk % 3 + 1] from jb where disc > 0)"""
_CNT = ", ".join(f"count(*) filter (answer = '{a}') as {a}" for a in claims.ANSWERS)


@register(f"with {JUDGES}, g as (select judge, surface, category, count(*) as questions, {_CNT} from ja group by 1, 2, 3) select *, round(yes / questions, 6) as yes_rate, round(no / questions, 6) as no_rate, round(uncertain / questions, 6) as uncertain_rate from g")
def judge_rates(spark, sf_dir):
    return rounded(claims.answer_rates(judge_answers(spark, sf_dir), ["judge", "surface", "category"]))


@register(f"""with {JUDGES}, r as (select slice, judge, surface, count(distinct request_id) as responses from ja group by 1, 2, 3), g as (select slice, judge, surface, count(*) as questions, {_CNT}, count(*) filter (category not in ('count','relation')) as questions_excl, count(*) filter (category not in ('count','relation') and answer = 'yes') as yes_excl, count(*) filter (category not in ('count','relation') and answer = 'no') as no_excl from ja group by 1, 2, 3)
select r.*, questions, yes, no, uncertain, questions_excl, yes_excl, no_excl, round(yes / responses, 6) as supported_cap, round(no / questions, 6) as risk, round(yes_excl / responses, 6) as supported_cap_excl, round(case when questions_excl > 0 then no_excl / questions_excl else 0 end, 6) as risk_excl from r join g using (slice, judge, surface)""")
def judge_cells(spark, sf_dir):
    ans = judge_answers(spark, sf_dir)
    return rounded(claims.cells(ans, ans.select("slice", "judge", "surface", "request_id").distinct()))


@register(f"""with {JUDGES}, f as (select slice, request_id from ja group by 1, 2 having count(distinct judge) = 2) select slice, judge, count(*) as answers, count(distinct request_id) as requests from ja where (slice, request_id) in (select slice, request_id from f) group by 1, 2""")
def judge_common_requests(spark, sf_dir):
    return claims.common_requests(judge_answers(spark, sf_dir)).groupBy("slice", "judge").agg(F.count("*").alias("answers"), F.count_distinct("request_id").alias("requests"))


@register(f"""with {JUDGES}, j as (select a.category, a.answer = b.answer as same from ja a join ja b on a.question_id = b.question_id and a.judge = 'j1' and b.judge = 'j2'), k as (select * from j union all select '__all__', same from j) select category, count(*) as questions, sum(same::int)::bigint as same, round(sum(same::int) / count(*), 6) as agreement from k group by 1""")
def judge_agreement(spark, sf_dir):
    ans = judge_answers(spark, sf_dir)
    return rounded(claims.judge_agreement(ans.where("judge = 'j1'"), ans.where("judge = 'j2'")))


@register("""with a as (select o_custkey as request_id, array_agg(distinct o_orderpriority) as k from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as request_id, array_agg(distinct o_orderpriority) as k from orders where o_orderkey % 2 = 1 group by 1),
j as (select len(list_intersect(a.k, b.k)) as bo, len(list_distinct(list_concat(a.k, b.k))) as either from a join b using (request_id)) select count(*) as requests, count(*) filter (bo = either) as exact, round(avg(case when either = 0 then 1 else bo / either end), 6) as jaccard from j""")
def rerun_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("request_id")).agg(F.collect_set("o_orderpriority").alias("keys"))
    return rounded(claims.rerun_overlap(side(0), side(1)))


@register("""with p as (select c_custkey as k, round(c_acctbal) as up, c_nationkey as down from customer) select k, up, down, not exists (select 1 from p q where q.up >= p.up and q.down <= p.down and (q.up > p.up or q.down < p.down)) as frontier from p""")
def pareto_frontier(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal").alias("up"), F.col("c_nationkey").alias("down"))
    return claims.pareto(p, "k", "up", "down").select("k", "up", "down", "frontier")


@register("""with r as (select l_returnflag as g, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
select g, max(v) filter (i = round_even((n - 1) * 0.95, 0)) as value, round(avg(v) filter (i >= floor(n * 0.1) and i < n - floor(n * 0.1)), 4) as trimmed from r group by 1""")
def rank_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    a = claims.nearest_rank(li, ["g"], "v", 0.95)
    return a.join(claims.trimmed_mean(li, ["g"], "v").select("g", F.round("value", 4).alias("trimmed")), "g")


# ---- Agreement ---------------------------------------------------------------------------------------------------
def two_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, category, weight): the two labels of a document as raters."""
    la, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    return la.join(d, "doc_id").select("doc_id", yes("quality").alias("a"), yes("toxic").alias("b"), F.coalesce("lang", F.lit("?")).alias("category"), (F.col("doc_id") % 4 + 1).cast("double").alias("weight"))


RATERS = "rt as (select l.doc_id, case when quality = 1 then 'yes' else 'no' end as a, case when toxic = 1 then 'yes' else 'no' end as b, coalesce(lang, '?') as category, (l.doc_id % 4 + 1)::double as weight from labels l join documents d using (doc_id))"


@register(f"with {RATERS} select category, a, b, sum(weight) as w from rt group by 1, 2, 3")
def agree_confusion(spark, sf_dir):
    return agreement.confusion(two_raters(spark, sf_dir), ["category"], weight="weight")


_NOMINAL = """, t as (select category, sum(w) as total, sum(case when a = b then w else 0 end) as same from m group by 1), s as (select category, c, sum(r) as r, sum(s) as s from (select category, a as c, w as r, 0 as s from m union all select category, b, 0, w from m) group by 1, 2),
ch as (select category, sum(r / total * s / total) as pe, sum((r + s) / (2 * total) * (1 - (r + s) / (2 * total))) as spread from s join t using (category) group by 1)
select category, total, round(same / total, 6) as exact, round((same / total - pe) / (1 - pe), 6) as kappa, round((same / total - spread) / (1 - spread), 6) as ac1 from t join ch using (category)"""


@register(f"with {RATERS}, m as (select category, a, b, count(*)::double as w from rt group by 1, 2, 3)" + _NOMINAL)
def agree_nominal(spark, sf_dir):
    return rounded(agreement.nominal(agreement.confusion(two_raters(spark, sf_dir), ["category"]), ["category"], 2))


@register(f"with {RATERS}, m as (select category, a, b, sum(w) as w from (select category, a, b, 0.5::double as w from rt union all select category, b, a, 0.5::double from rt) group by 1, 2, 3)" + _NOMINAL)
def agree_symmetrized(spark, sf_dir):
    return rounded(agreement.nominal(agreement.symmetrized(two_raters(spark, sf_dir), ["category"]), ["category"], 2))


@register(f"""with {RATERS}, x as (select category, a, case when doc_id % 7 = 0 then 'uncertain' else b end as b, weight as w from rt), g as (select category, count(*) as pairs, count(*) filter (b <> 'uncertain') as decided, 0::bigint as abstained_a, count(*) filter (b = 'uncertain') as abstained_b, 0::bigint as abstained_both,
sum(case when a = 'yes' and b = 'yes' then w else 0 end) as pp, sum(case when a = 'yes' and b = 'no' then w else 0 end) as pn, sum(case when a = 'no' and b = 'yes' then w else 0 end) as np, sum(case when a = 'no' and b = 'no' then w else 0 end) as nn from x group by 1)
select *, round((pp + nn) / (pp + pn + np + nn), 6) as exact, round(case when 2 * pp + pn + np > 0 then 2 * pp / (2 * pp + pn + np) end, 6) as positive_agreement, round(case when 2 * nn + pn + np > 0 then 2 * nn / (2 * nn + pn + np) end, 6) as negative_agreement from g""")
def agree_binary(spark, sf_dir):
    p = two_raters(spark, sf_dir).withColumn("b", F.when(F.col("doc_id") % 7 == 0, "uncertain").otherwise(F.col("b")))
    return rounded(agreement.binary(p, ["category"], weight="weight"))


@register("""with n as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2), g as (select l_orderkey, sum(n)::bigint as raters, max(n) as top, max_by(l_returnflag, n) as w from n group by 1) select l_orderkey, raters, case when raters >= 2 and 2 * top > raters then w end as consensus from g""")
def agree_consensus(spark, sf_dir):
    return agreement.consensus(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@register(f"with {RATERS} select category, count(*) as n, sum(weight) as weight, sum(case when a = 'yes' then weight else 0 end) as positive_weight, round(sum(case when a = 'yes' then weight else 0 end) / sum(weight), 6) as proportion from rt group by 1")
def agree_weighted_support(spark, sf_dir):
    return rounded(agreement.weighted_proportion(two_raters(spark, sf_dir), ["category"], F.col("a") == "yes", "a", "weight"))


_PANEL = "r as (select distinct event_id // 4 as item_id, 'u' || (user_id % 5) as rater, max(event_type) over (partition by event_id // 4, user_id % 5) as label from events)"


@register(f"with {_PANEL} select x.item_id, x.rater as rater_a, y.rater as rater_b, x.label as a, y.label as b from r x join r y on x.item_id = y.item_id and x.rater < y.rater")
def agree_rater_pairs(spark, sf_dir):
    return agreement.rater_pairs(_panel(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("item_id"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("rater"), "event_type")
    return e.groupBy("item_id", "rater").agg(F.max("event_type").alias("label"))


@register(f"""with {_PANEL}, p as (select x.rater || '|' || y.rater as category, x.label as a, y.label as b from r x join r y on x.item_id = y.item_id and x.rater < y.rater), m as (select category, a, b, count(*)::double as w from p group by 1, 2, 3)""" + _NOMINAL.replace("spread) / (1 - spread)", "spread / 4) / (1 - spread / 4)"))
def agree_pairwise(spark, sf_dir):
    k = agreement.pairwise_kappa(agreement.rater_pairs(_panel(spark, sf_dir)), 5)
    return rounded(k.where("rater_a is not null").select(F.concat_ws("|", "rater_a", "rater_b").alias("category"), "total", "exact", "kappa", "ac1"))


_JH = "count(*) as n, count(*) filter (a = 'yes' and b = 'yes') as tp, count(*) filter (a = 'no' and b = 'yes') as fp, count(*) filter (a = 'yes' and b = 'no') as fn, count(*) filter (a = 'no' and b = 'no') as tn, sum(weight) as w, sum(case when a = b then weight else 0 end) as w_same"


@register(f"""with {RATERS}, x as (select *, 's' || (doc_id % 3) as surface from rt), g as (select category, surface, grouping(category, surface)::bigint as level, {_JH} from x group by grouping sets ((category, surface), (category), (surface), ()))
select *, round((tp + tn) / n, 6) as agreement, round(w_same / w, 6) as weighted_agreement, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall, round(case when tn + fp > 0 then tn / (tn + fp) end, 6) as specificity, round(case when tn + fn > 0 then tn / (tn + fn) end, 6) as npv from g""")
def agree_judge_human(spark, sf_dir):
    rows = two_raters(spark, sf_dir).withColumn("surface", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    return rounded(agreement.judge_human(rows, "a", "b"))


@register(f"with {RATERS}, g as (select category, count(*) filter (b = 'yes') as y, count(*) as n from rt group by 1) select count(*) as cells, count(*) as filled, round(avg(y / n), 6) as macro from g")
def agree_macro(spark, sf_dir):
    r = two_raters(spark, sf_dir)
    return rounded(agreement.equal_cell_macro(r.withColumnRenamed("b", "label"), r.select("category"), ["category"]))


@register("""with v as (select c_mktsegment as g, c_nationkey as v, sum(c_custkey) as w from customer group by 1, 2), r as (select *, sum(w) over (partition by g order by v) as run, sum(w) over (partition by g) as total from v) select g, min(v) as median from r where 2 * run >= total group by 1""")
def agree_weighted_median(spark, sf_dir):
    return agreement.weighted_median(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("v"), F.col("c_custkey").alias("w")), ["g"], "v", "w")


@register("""with p as (select l_returnflag as g, abs(l_linenumber - (l_suppkey % 7)) as d from lineitem) select g, count(*) as pairs, count(*) filter (d = 0) as exact, count(*) filter (d <= 1) as within_one, quantile_cont(d, 0.5) as median_difference, round(count(*) filter (d = 0) / count(*), 6) as exact_share, round(count(*) filter (d <= 1) / count(*), 6) as within_one_share from p group by 1""")
def agree_ordinal(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 7).alias("b"))
    return rounded(agreement.ordinal_agreement(p, ["g"]))


@register("""with m as (select 'segment' as field, c_mktsegment as value, count(*) as n from customer group by 2 union all select 'cell', c_nationkey || '/' || c_mktsegment || '/' || floor(c_acctbal / 1000)::bigint, count(*) from customer group by 2), l as (select field, min(n) as low from m group by 1) select field, value, case when low >= 3 then n end as n from m join l using (field)""")
def privacy_marginals(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = c.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).select(F.lit("segment").alias("field"), "value", "n")
    cell = F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string"))
    n = c.groupBy(cell.alias("value")).agg(F.count("*").alias("n")).select(F.lit("cell").alias("field"), "value", "n")
    return agreement.suppress_small(m.unionByName(n))


# ---- Embeddings --------------------------------------------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(F.col("label").cast("string"), F.lit("?")).alias("label"))
    return e.where(part) if part is not None else e


_COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
VECS = "vq as (select vec_id as id, embedding::double[] as v from embeddings), vg as (select * from vq)"
SIMS = f"s as (select vq.id as q_id, vg.id as g_id, {_COS.format(a='vq.v', b='vg.v')} as sim from vq, vg where vq.id <> vg.id)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors(spark, sf_dir, F.col("vec_id") % 2 == 1), vectors(spark, sf_dir, F.col("vec_id") % 2 == 0)


@register(f"with {VECS}, {SIMS}, r as (select *, row_number() over (partition by q_id order by sim desc, g_id) as rank from s) select q_id, g_id, round(sim, 6) as sim, rank::int as rank from r where rank <= 5")
def embed_neighbours(spark, sf_dir):
    return rounded(embed.neighbours(vectors(spark, sf_dir), vectors(spark, sf_dir), 5, skip_self=True))


@register(f"with {VECS}, {SIMS} select q_id, round(max(sim), 6) as sim from s group by 1")
def embed_nearest(spark, sf_dir):
    return rounded(embed.nearest_cosine(vectors(spark, sf_dir), vectors(spark, sf_dir), skip_self=True))


@register(f"""with {VECS}, {SIMS}, gg as (select a.id, row_number() over (partition by a.id order by {_COS.format(a='a.v', b='b.v')} desc) as r, {_COS.format(a='a.v', b='b.v')} as sim from vg a join vg b on a.id <> b.id), rad as (select id, sim as radius from gg where r = 10)
select q_id, sum((sim >= radius)::int) > 0 as covered, round(sum((sim >= radius)::int) / 10, 6) as density, round(max(sim), 6) as nn from s join rad on g_id = rad.id group by 1""")
def embed_support(spark, sf_dir):
    return rounded(embed.support(vectors(spark, sf_dir), vectors(spark, sf_dir), 10, skip_self=True))


@register(f"""with a as (select vec_id as id, embedding::double[] as v from embeddings where vec_id % 2 = 0), b as (select vec_id - 1 as id, embedding::double[] as v from embeddings where vec_id % 2 = 1), p as (select a.id as i, b.id as j, {_COS.format(a='a.v', b='b.v')} as s from a, b),
d as (select i, s from p where i = j), x as (select 'a2b' as direction, p.i as id, max(d.s) as pos, max(case when i <> j then p.s end) as best, sum((i <> j and p.s > d.s)::int) as higher from p join d using (i) group by 2 union all
select 'b2a', p.j, max(d.s), max(case when p.i <> j then p.s end), sum((p.i <> j and p.s > d.s)::int) from p join d on p.j = d.i group by 2)
select direction, count(*) as n, round(avg(pos), 6) as positive, round(avg(pos - best), 6) as margin, round(avg((higher < 1)::int), 6) as r_at_1, round(avg((higher < 5)::int), 6) as r_at_5, round(avg(higher + 1), 6) as mean_rank from x group by 1""")
def embed_retrieval(spark, sf_dir):
    b, a = _halves(spark, sf_dir)
    return rounded(embed.retrieval_summary(embed.retrieval(a, b.withColumn("id", F.col("id") - 1))))


@register()
def embed_vendi(spark, sf_dir):
    return rounded(embed.vendi(vectors(spark, sf_dir), "label"))


@register()
def embed_geometry(spark, sf_dir):
    return rounded(embed.geometry(vectors(spark, sf_dir), "label"))


# ---- Resampling and samples --------------------------------------------------------------------------------------
@register()
def bootstrap_means(spark, sf_dir):
    p = core.turn_pairs(spark, sf_dir).select(F.pmod("pair", F.lit(4)).alias("g"), X.token_count(F.col("local")).cast("double").alias("x"))
    return resample.bootstrap(p, "g", ["x"], resample.mean_statistic, reps=500)


@register()
def bootstrap_clusters(spark, sf_dir):
    rows = two_raters(spark, sf_dir).select((F.col("doc_id") % 30).alias("cluster"), ((F.col("a") == F.col("b")).cast("double") * F.col("weight")).alias("same"), "weight")
    return spark.createDataFrame(resample.cluster_bootstrap(rows, "cluster", ["same", "weight"], lambda s: s[0] / s[1] if s[1] else None, reps=500))


_HASH = lambda seed, key: f"sha256('{seed}' || chr(0) || {key}::varchar)"


@register(f"with r as (select doc_id, coalesce(lang, '?') as lang, count(*) over (partition by coalesce(lang, '?')) as population, row_number() over (partition by coalesce(lang, '?') order by {_HASH(7, 'doc_id')}, doc_id) as r from documents) select lang, doc_id, population, round(population / least(population, 25), 6) as weight from r where r <= 25")
def sample_strata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    return rounded(resample.stratified(d, ["lang"], 25, 7, "doc_id").select("lang", "doc_id", "population", "weight"))


@register(f"select doc_id from documents order by {_HASH(3, 'doc_id')}, doc_id limit 100")
def sample_hash(spark, sf_dir):
    return resample.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), 100, 3, "doc_id", restore="doc_id")


@register("""with p as (select n_name as participant from nation), r as (select s_suppkey as item, participant, row_number() over (partition by s_suppkey order by sha256('9' || chr(0) || s_suppkey::varchar || chr(0) || participant)) as r from supplier, p) select item, participant from r where r <= 3""")
def sample_assign(spark, sf_dir):
    return resample.assign(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("participant")), 3, 9)


@register()
def queue_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("participant"), F.lit("image").alias("phase"), F.col("s_suppkey").cast("string").alias("item"))
    tasks = s.withColumn("repeat_of", F.lit(None).cast("string")).unionByName(s.where("item % 10 = 0").withColumn("repeat_of", F.col("item")).withColumn("item", F.concat("item", F.lit("r"))))
    return resample.spaced_order(tasks, ["participant", "phase"], 1477)


# ---- Study -------------------------------------------------------------------------------------------------------
def study_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as items, line items as assignments of suppliers."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.lit(None).cast("long").alias("repeat_of"), F.col("p_partkey").alias("position"), (F.col("p_partkey") % 7).alias("stratum"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("participant"), F.when(F.col("l_linenumber") % 2 == 0, "caption").otherwise("image").alias("phase"), F.when(F.col("l_returnflag") == "N", "complete").otherwise("open").alias("status"), F.col("l_orderkey").alias("position"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("repeat_of"))
    return items, a


ASG = "asg as (select l_partkey as item_id, l_suppkey as participant, case when l_linenumber % 2 = 0 then 'caption' else 'image' end as phase, case when l_returnflag = 'N' then 'complete' else 'open' end as status, l_orderkey as position, case when l_linestatus = 'O' then l_partkey end as repeat_of from lineitem)"


@register(f"with {ASG}, g as (select p_partkey as item_id, phase from part, (select unnest(['caption','image']) as phase)), h as (select item_id, phase, count(distinct participant) as raters from asg group by 1, 2) select item_id, phase, coalesce(raters, 0) as raters from g left join h using (item_id, phase) where coalesce(raters, 0) <> 12")
def study_coverage(spark, sf_dir):
    return study.label_coverage(*study_frames(spark, sf_dir), 12)


@register(f"with {ASG} select distinct position as participant from asg where position not in (select position from asg where status <> 'complete')")
def study_completed(spark, sf_dir):
    a = study_frames(spark, sf_dir)[1]
    return study.completed_participants(a.withColumn("participant", F.col("position")))


@register(f"with {ASG} select phase, count(*) as assignments, count(*) filter (status = 'complete') as complete, count(distinct participant) as participants, count(distinct item_id) as items, count(*) filter (repeat_of is not null) as repeats from asg group by 1")
def study_status(spark, sf_dir):
    return study.status_summary(study_frames(spark, sf_dir)[1])


@register(f"with {ASG}, d as (select item_id, count(distinct participant) as done from asg where status = 'complete' group by 1) select p_partkey as item_id, coalesce(done, 0) as done from part left join d on p_partkey = item_id where coalesce(done, 0) < 15")
def study_pool_incomplete(spark, sf_dir):
    return study.pool_incomplete(*study_frames(spark, sf_dir), 15)


@register(f"with {ASG} select participant, phase, max(position) + 1 as position from asg group by 1, 2")
def study_next_position(spark, sf_dir):
    return study.next_position(study_frames(spark, sf_dir)[1])


@register(f"""with {ASG}, p as (select item_id, count(distinct participant) as assigned from asg group by 1), j as (select p_partkey as item_id, p_partkey % 7 as stratum, p_partkey as position, coalesce(assigned, 0) as assigned from part left join p on p_partkey = item_id), o as (select stratum, sum(greatest(assigned - 1, 0)) as overlap from j group by 1)
select item_id, assigned from j join o using (stratum) where assigned < 40 and item_id not in (select item_id from asg where participant = 3) order by assigned, overlap, position, item_id limit 1""")
def study_claim_next(spark, sf_dir):
    items, a = study_frames(spark, sf_dir)
    return study.remaining_first(items, a, 3, 40).select("item_id", "assigned")


@register(f"""with {ASG}, g as (select item_id, phase from asg group by 1, 2 having count(distinct participant) >= 3 and count(distinct status) > 1) select item_id, phase from g where item_id % 5 <> 0""")
def study_adjudication(spark, sf_dir):
    items, a = study_frames(spark, sf_dir)
    done = items.where("item_id % 5 = 0").select("item_id", F.explode(F.array(F.lit("caption"), F.lit("image"))).alias("phase"))
    return study.adjudication_candidates(a, done, 3, ["status"]).select("item_id", "phase")


@register(f"""with {ASG}, o as (select participant, phase, item_id, position from asg), x as (select a.participant, a.phase, a.item_id, a.position - o.position as distance from asg a join o on a.participant = o.participant and a.phase = o.phase and a.repeat_of = o.item_id) select participant, phase, count(*) as pairs, sum(distance)::bigint as distance from x group by 1, 2""")
def study_repeat_spacing(spark, sf_dir):
    return study.repeat_spacing(study_frames(spark, sf_dir)[1]).groupBy("participant", "phase").agg(F.count("*").alias("pairs"), F.sum("distance").alias("distance"))


@register("select c_nationkey as participant, c_mktsegment as item_group, 's' as surface, min(c_custkey) as item_id, min_by(c_name, c_custkey) as name from customer group by 1, 2")
def study_salient(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("participant"), F.col("c_mktsegment").alias("item_group"), F.lit("s").alias("surface"), F.col("c_custkey").alias("item_id"), F.col("c_name").alias("name"))
    return study.salient_rows(c)


# ---- Requests ----------------------------------------------------------------------------------------------------
@register()
def request_ids(spark, sf_dir):
    """Extraction requests; ids are BLAKE2b digests, which SQL lacks."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return requests.extraction_requests(d, 64, "documents")


@register(f"""with {CLAIMS}, q as (select caption_id, caption_id || ':u' || lpad(idx::varchar, 4, '0') as question_id, category, trim(coalesce(unit, '')) as u, trim(coalesce(target, '')) as t from cl)
select caption_id, question_id, category, case when category = 'text_rendering' then 'Is the rendered text claim ''' || u || ''' visibly supported by the image?' when t <> '' then 'Is the visual claim ''' || t || ': ' || u || ''' supported by the image?' else 'Is the visual claim ''' || u || ''' supported by the image?' end as question from q""")
def request_questions(spark, sf_dir):
    return requests.question_list(claim_frame(spark, sf_dir)).select("caption_id", F.explode("questions").alias("q")).select("caption_id", "q.*")


@register("""select event_id, json_extract(props, '$.k')::bigint as k, props is not null and json_valid(props) as ok from events""")
def request_parse(spark, sf_dir):
    e = requests.parse(table(spark, sf_dir, "events").select("event_id", "props"), "k long", "props")
    return e.select("event_id", "parsed.k", (F.col("parsed").isNotNull()).alias("ok"))


# ---- Relational parity -------------------------------------------------------------------------------------------
@register("""select l_returnflag, l_linestatus, count(*) as count_order, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def relational_aggregate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("count_order"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"))


@register("""select n_name, r_name, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def relational_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"))


@register("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) select o_custkey, o_orderkey, rank::int as rank from r where rank <= 3""")
def relational_top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@register("""select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2""")
def event_windows(spark, sf_dir):
    """Tumbling windows; the same expression runs on streams."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@register("""select event_type as surface, 'n' as metric, count(*)::double as value from events group by 1 union all select event_type, 'users', count(distinct user_id)::double from events group by 1""")
def export_long_form(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("surface")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return io.long_form(g, ["surface"], ["n", "users"])


@register("""select doc_id, row_number() over (order by doc_id) - 1 as global_index from (select distinct doc_id from documents)""")
def source_index(spark, sf_dir):
    return io.discover(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@register("""select 'text' as used_field, count(*) as n from documents where trim(coalesce(text, '')) <> ''""")
def source_fields(spark, sf_dir):
    return io.load_captions(table(spark, sf_dir, "documents")).groupBy("used_field").agg(F.count("*").alias("n"))


# ---- More of the above -------------------------------------------------------------------------------------------
@register(f"""with {JUDGES}, k as (select judge, request_id as question_id, answer, question_id || answer as pos from ja) select judge, question_id, max_by(answer, pos) as answer, count(*) as rows, count(distinct answer) > 1 as conflict from k group by 1, 2""")
def judge_records(spark, sf_dir):
    ans = judge_answers(spark, sf_dir).select("judge", F.col("request_id").alias("question_id"), "answer", F.concat("question_id", "answer").alias("pos"))
    return claims.judge_records(ans)


@register(f"""with {JUDGES}, r as (select judge, question_id, max(answer) as answer, max(case when judge = 'j1' then request_id % 50 else request_id % 51 end)::varchar as img from ja group by 1, 2),
w as (select question_id, max(answer) filter (judge = 'j1') as j1, max(answer) filter (judge = 'j2') as j2, count(distinct img) as images from r group by 1), c as (select distinct question_id from jb),
j as (select coalesce(j1 is not null and j2 is not null, false) as f, coalesce(images = 1, false) as s from c left join w using (question_id)) select count(*) as claims, count(*) filter (f and s) as joined, count(*) filter (not f) as missing_answer, count(*) filter (f and not s) as image_differs from j""")
def judge_candidate_pool(spark, sf_dir):
    ans = judge_answers(spark, sf_dir)
    img = F.when(F.col("judge") == "j1", F.col("request_id") % 50).otherwise(F.col("request_id") % 51).cast("string")
    rec = ans.withColumn("img", img).groupBy("judge", "question_id").agg(F.max("answer").alias("answer"), F.max("img").alias("image_key"))
    return claims.candidate_pool(ans.select("question_id").distinct(), rec, ("j1", "j2"))[1]


@register(f"""with {core.CAP}, r as (select surface, len(toks) as n from cap), q as (select *, row_number() over (partition by surface order by n) - 1 as i, count(*) over (partition by surface) as c from r)
select surface, count(*) as captions, max(n)::int as max_n, """ + ", ".join(f"max(n) filter (i = round_even((c - 1) * {q}, 0))::int as p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", " + ", ".join(f"round(count(*) filter (n > {b}) / count(*), 6) as over_{b}" for b in (77, 248, 512)) + " from q group by 1")
def survey_truncation(spark, sf_dir):
    from ..operators import survey

    return rounded(survey.truncation(core.by_lang(spark, sf_dir).select("surface", F.size("toks").alias("n")), (77, 248, 512)))


@register(rf"""with {core.CAP}, r as (select surface, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n from cap) select surface, count(*) as captions, round(avg(n), 6) as mean_words, quantile_cont(n, 0.5) as median_words, min(n)::int as min_words, max(n)::int as max_words from r where n > 0 group by 1""")
def survey_word_lengths(spark, sf_dir):
    from ..operators import survey

    return rounded(survey.word_lengths(core.by_lang(spark, sf_dir)))


@register("""with m as (select l_orderkey as key, floor(l_quantity)::int as width, l_linenumber::int * 10 as height, l_linenumber::bigint * 10000000 + l_partkey as pos from lineitem), f as (select key, min_by(width, pos) as width, min_by(height, pos) as height from m group by 1),
g as (select o_orderkey as key, o_custkey as lookup, width, height from orders join f on o_orderkey = key where least(width, height) >= 10), h as (select lookup, max(key) as key from g group by 1)
select sha1('pairs' || chr(0) || h.key::varchar || chr(0) || h.lookup::varchar) as pair_id, h.key, h.lookup, c_name as public_caption from h join customer on c_custkey = h.lookup""")
def pair_build(spark, sf_dir):
    local = _local(spark, sf_dir).withColumn("caption", F.lit("x"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.floor("l_quantity").cast("int").alias("width"), (F.col("l_linenumber").cast("int") * 10).alias("height"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("pos"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lookup"), F.col("c_name").alias("caption"), F.col("c_custkey").alias("pos"))
    return pairing.build_pairs(local, m, c, 10)[0].select("pair_id", "key", "lookup", "public_caption")
