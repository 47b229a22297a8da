"""Registered queries of the core operators: name -> (function, DuckDB SQL or None).

Every query runs over whole tables. Doubles whose last digits depend on the order of a sum are rounded in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import survey, support

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.captions(table(spark, sf_dir, "documents"), surface=F.coalesce("lang", F.lit("?")))


TOKENS = r"regexp_extract_all(lower(coalesce(text,'')), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*')"
CAP = f"cap as (select coalesce(lang,'?') as surface, doc_id as id, coalesce(text,'') as text, {TOKENS} as toks from documents)"
LEADING = "[" + ",".join(f"'{w}'" for w in X.LEADING_WORDS) + "]"


def grams(n: int, toks: str = "toks", source: str = "cap") -> str:
    """SQL rows (surface, id, pos, item)."""
    return f"select surface, id, i - 1 as pos, array_to_string({toks}[i:i+{n - 1}], ' ') as item from (select *, unnest(range(1, greatest(len({toks}) - {n - 1}, 0) + 1)) as i from {source})"


def concentration_sql(items: str, top_ks=(10, 100, 1000)) -> str:
    """SQL of survey.concentration over rows (surface, item)."""
    tops = ", ".join(f"sum(case when r <= {k} then cnt else 0 end)::bigint as top{k}" for k in top_ks)
    mass = ", ".join(f"round(top{k} / total::double, 6) as top{k}_mass" for k in top_ks)
    keep = ", ".join(f"top{k}" for k in top_ks)
    return f"""items as ({items}), c as (select surface, item, count(*) as cnt from items group by 1, 2),
r as (select *, row_number() over (partition by surface order by cnt desc) as r, sum(cnt) over (partition by surface) as n from c),
g as (select surface, sum(cnt)::bigint as total, count(*) as distinct_items, -sum(cnt / n * ln(cnt / n)) as h, sum(cnt * cnt)::bigint as squares, {tops} from r group by 1)
select surface, total, distinct_items, squares, {keep}, round(distinct_items / greatest(total, 1), 6) as distinct_share, round(h, 6) as entropy, round(h + (distinct_items - 1) / (2 * total::double), 6) as entropy_mm,
round(exp(h), 3) as effective_vocab, round(squares / (total::double * total), 6) as hhi, round(total::double * total / squares, 3) as effective_simpson, {mass} from g"""


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("effective_vocab", F.round("effective_vocab", 3)).withColumn("effective_simpson", F.round("effective_simpson", 3)))


# ---- Survey ------------------------------------------------------------------------------------------------------
@register(f"""with {CAP}, b as (select unnest([16,32,64,128,248,256,320]) as budget), r as (select surface, budget, len(toks) as n from cap, b),
g as (select surface, budget, count(*) as captions, sum(least(n, budget))::bigint as budget_tokens, sum((n >= budget)::int)::bigint as meeting, sum((n > budget)::int)::bigint as truncated, avg(least(n, budget) / greatest(n, 1)) as retained from r group by 1, 2),
a as (select *, round(budget_tokens / captions, 2) as two from g)
select surface, budget, captions, budget_tokens, meeting, truncated, round(retained, 6) as retained, round(budget_tokens / captions, 6) as avg_tokens, round(meeting / captions, 6) as coverage_rate, round(truncated / captions, 6) as truncation_rate,
round((two - lag(two) over w) / greatest(budget - lag(budget) over w, 1), 6) as marginal_gain from a window w as (partition by surface order by budget)""")
def survey_budget(spark, sf_dir):
    return rounded(survey.budget_survey(by_lang(spark, sf_dir)))


@register(f"""with {CAP}, r as (select surface, len(toks) as n, len(text) as chars from cap)
select surface, count(*) as captions, sum(n)::bigint as tokens, sum(chars)::bigint as chars, quantile_cont(n, 0.5) as p50, round(quantile_cont(n, 0.95), 6) as p95, min(n)::int as min_tokens, max(n)::int as max_tokens,
sum((n > 64)::int)::bigint as gt64, sum((n > 128)::int)::bigint as gt128, sum((n > 248)::int)::bigint as gt248, sum((n > 320)::int)::bigint as gt320, round(sum(n) / count(*), 6) as avg_tokens, round(sum(chars) / count(*), 6) as avg_chars from r group by 1""")
def survey_lengths(spark, sf_dir):
    return rounded(survey.lengths(by_lang(spark, sf_dir)))


def _grams(n: int, budget: int):
    def run(spark, sf_dir):
        return shown(survey.concentration(survey.gram_counts(survey.at_budget(by_lang(spark, sf_dir), budget), n)))

    run.__name__ = f"survey_distinct_{n}"
    return run


for _n in (1, 2, 3):
    register(f"with {CAP}, " + concentration_sql(grams(_n, "toks[1:64]")))(_grams(_n, 64))


@register(f"with {CAP}, " + concentration_sql("select surface, array_to_string(toks[1:5], ' ') as item from cap where len(toks) > 0"))
def survey_prefix_raw(spark, sf_dir):
    return shown(survey.concentration(survey.raw_prefix_counts(by_lang(spark, sf_dir))))


_CONTENT = f"list_filter(toks, lambda t: not list_contains({LEADING}, t))"
_AT = f"list_position(list_transform(toks, lambda t: not list_contains({LEADING}, t)), true)"
CONTENT_CAP = f"{CAP}, con as (select *, {_AT} as at, case when coalesce({_AT}, 0) > 0 then toks[{_AT}:] else [] end as content from cap)"


@register(f"with {CONTENT_CAP}, " + concentration_sql("select surface, array_to_string(content[1:5], ' ') as item from con where len(content) > 0"))
def survey_prefix_content(spark, sf_dir):
    return shown(survey.concentration(survey.content_prefix_counts(by_lang(spark, sf_dir))))


@register(f"""with {CONTENT_CAP}, o as (select surface, id, array_to_string(case when len(content) > 0 then content[1:3] else toks[1:3] end, ' ') as item from con where len(toks) > 0),
c as (select surface, item, count(*) as cnt, min(id) as first_id from o group by 1, 2), r as (select *, row_number() over (partition by surface order by cnt desc, first_id) as rank from c)
select surface, item, cnt, rank::int as rank from r where rank <= 10""")
def survey_openings(spark, sf_dir):
    return survey.top_items(survey.opening_counts(by_lang(spark, sf_dir)), 10).select("surface", "item", "cnt", "rank")


@register(f"""with {CAP}, g as ({grams(4)}), c as (select surface, id, item, count(*) as n from g group by 1, 2, 3), p as (select surface, id, count(*) as d, sum(n) as total, max(n) as top from c group by 1, 2),
r as (select cap.surface, len(toks) >= 4 as eligible, d, total, coalesce(top, 0) as top from cap left join p on cap.surface = p.surface and cap.id = p.id where len(toks) > 0)
select surface, count(*) as captions, sum(eligible::int)::bigint as eligible, sum((top >= 2)::int)::bigint as repeated, round(avg(case when eligible then d / total end), 6) as mean_distinct, round(avg(case when eligible then top end), 6) as mean_max_repeat,
round(sum((top >= 2)::int) / count(*), 6) as rate_all, round(sum((top >= 2)::int) / sum(eligible::int), 6) as rate_eligible from r group by 1""")
def survey_repetition(spark, sf_dir):
    return rounded(survey.repetition(by_lang(spark, sf_dir), 4))


@register(f"""with {CAP}, g as ({grams(3, "toks[1:64]")}), c as (select surface, item, count(*) as cnt, min((id, pos)) as first from g group by 1, 2),
t as (select surface, item from (select *, row_number() over (partition by surface order by cnt desc, first) as r from c) where r <= 100),
p as (select g.surface, g.id, count(*) as total, count(t.item) as hits from g left join t on g.surface = t.surface and g.item = t.item group by 1, 2)
select surface, count(*) as captions, round(avg(hits / total), 6) as balanced_mass from p group by 1""")
def survey_balanced_topmass(spark, sf_dir):
    return rounded(survey.balanced_top_mass(survey.at_budget(by_lang(spark, sf_dir), 64), 3, 100))


@register(f"""with {CAP}, c as (select surface, array_to_string(toks, ' ') as k, count(*) as n from cap where len(toks) > 0 group by 1, 2)
select surface, sum(n)::bigint as captions, count(*) as unique_captions, sum(case when n > 1 then n else 0 end)::bigint as duplicated, max(n) as max_count, round(count(*) / sum(n), 6) as unique_rate, round(1 - count(*) / sum(n), 6) as duplicate_rate,
round(sum(case when n > 1 then n else 0 end) / sum(n), 6) as duplicate_mass from c group by 1""")
def survey_dedup(spark, sf_dir):
    return rounded(survey.duplicates(by_lang(spark, sf_dir)))


def _sql_regex(p: str) -> str:
    """A Java pattern as DuckDB has it: look-arounds that do not change whether something occurs go."""
    p = p.replace(r"(?<![\p{L}\p{N}_])", "").replace(r"(?![\p{L}\p{N}_])", "").replace("'", "''")
    return p.replace("\\x{3400}-\\x{9fff}", "㐀-鿿")


def _flags_sql(tests: dict[str, str], source: str = "cap", extra: str = "") -> str:
    rows = " union all ".join(f"select surface, '{n}' as name, ({t}) as hit from {source} where len(toks) > 0" for n, t in tests.items())
    return f"select surface, name, sum(hit::int)::bigint as hits, count(*) as captions, round(sum(hit::int) / count(*), 6) as rate{extra} from ({rows}) group by surface, name"


@register(f"with {CAP} " + _flags_sql({n: f"regexp_matches(text, '{_sql_regex(p)}')" for n, p in X.FORMATTING.items()}))
def survey_formatting(spark, sf_dir):
    return rounded(survey.formatting(by_lang(spark, sf_dir)))


@register(f"with {CAP} " + _flags_sql({n: f"regexp_matches(text, '{_sql_regex(p)}')" for n, p in X.SCRIPTS.items()}))
def survey_script(spark, sf_dir):
    return rounded(survey.scripts(by_lang(spark, sf_dir)))


_WORDS5 = r"wg as (select id, array_to_string(w[i:i+4], ' ') as item from (select id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) as i from (select id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from cap))), rep as (select distinct id from (select id, item, count(*) as n from wg group by 1, 2) where n >= 10)"


def _code_test(code: str) -> str:
    if code.startswith("F_"):
        return "id in (select id from rep)"
    return " or ".join(f"regexp_matches(text, '(?m){_sql_regex(p)}')" for p in X.VIOLATIONS[code][1])


@register(f"with {CAP}, {_WORDS5} " + _flags_sql({c: _code_test(c) for c in X.VIOLATIONS}, extra=", case name " + " ".join(f"when '{c}' then '{s}'" for c, (s, _) in X.VIOLATIONS.items()) + " end as severity"))
def survey_violations(spark, sf_dir):
    return rounded(survey.violations(by_lang(spark, sf_dir)))


_CODES = " + ".join(f"({_code_test(c)})::int" for c in X.VIOLATIONS)


@register(f"""with {CAP}, {_WORDS5}, r as (select surface, len(toks) as n, {_CODES} as codes from cap where len(toks) > 0)
select surface, count(*) as captions, sum((codes > 0)::int)::bigint as violated, round(avg((codes > 0)::int * 64 / n), 6) as indicator_per_64, round(avg(codes * 64 / n), 6) as codes_per_64 from r group by 1""")
def survey_violation_summary(spark, sf_dir):
    return rounded(survey.violation_summary(by_lang(spark, sf_dir)))


def _in(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


_LEX = {k: f"len(list_filter(toks, lambda t: list_contains({_in(v)}, t)))" for k, v in X.LEXICONS.items()} | {"count": rf"len(list_filter(toks, lambda t: regexp_full_match(t, '\p{{Nd}}+') or list_contains({_in(X.NUMBER_WORDS)}, t)))", "text_rendering": f"len(list_filter(toks, lambda t: list_contains({_in(X.TEXT_WORDS)}, t)))"}


@register(f"with {CAP}, r as (" + " union all ".join(f"select surface, '{k}' as category, {v} as hits, len(toks) as n from cap where len(toks) > 0" for k, v in _LEX.items()) + ") select surface, category, sum(hits)::bigint as token_hits, sum((hits > 0)::int)::bigint as caption_hits, count(*) as captions, round(sum(hits) / greatest(sum(n), 1) * 64, 6) as per_64 from r group by 1, 2")
def survey_lexicon(spark, sf_dir):
    return rounded(survey.lexicons(by_lang(spark, sf_dir)))


@register(f"with {CAP} select surface, name, sum(hit::int)::bigint as hits, count(*) as captions, round(sum(hit::int) / count(*), 6) as rate from (" + " union all ".join(f"select surface, '{p.replace(' ', '_')}' as name, contains(lower(text), '{p}') as hit from cap" for p in X.PHRASES) + ") group by 1, 2")
def survey_phrases(spark, sf_dir):
    return rounded(survey.phrase_rates(by_lang(spark, sf_dir)))


@register(f"""with {CAP}, b as (select unnest([16,32,64,128,248,256,320]) as budget), v as (select surface, budget, sum((len(toks) >= budget)::int) / count(*) as value from cap, b group by 1, 2),
p as (select *, min(value) over (partition by surface) as best, max(value) over (partition by surface) as worst from v),
q as (select *, case when best = worst then 0.0 else (value - worst) / (best - worst) end as progress from p),
s as (select *, lag(budget) over w as b0, lag(progress) over w as p0 from q window w as (partition by surface order by budget)),
t as (select *, (budget - b0) * (progress + p0) / 2 as area from s)
select surface, round(sum(area) / greatest(max(budget) - min(budget), 1), 6) as auc,
""" + ", ".join(f"min_by(case when progress >= {t} then case when b0 is null or progress = p0 then budget::double else round(b0 + ({t} - p0) / (progress - p0) * (budget - b0), 2) end end, case when progress >= {t} then budget end) as budget_at_{int(t * 100)}" for t in (0.5, 0.75, 0.9)) + ", round(max(best), 6) as best, round(max(worst), 6) as worst from t group by 1")
def survey_curve_auc(spark, sf_dir):
    """How fast coverage falls along the budgets, from its worst to its best direction downwards."""
    points = survey.budget_survey(by_lang(spark, sf_dir)).select("surface", "budget", F.col("coverage_rate").alias("value"))
    return rounded(survey.curve_features(points, up=False))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, local, reference): assistant turns and the user turns before them."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("local"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "local", "reference")


PAIRS = "prs as (select a.conv_id * 1000 + a.turn as pair, coalesce(a.text, '') as local, coalesce(u.text, '') as reference from conversations a join conversations u on a.conv_id = u.conv_id and a.turn = u.turn + 1 where a.role = 'assistant' and u.role = 'user')"
_J = " or ".join(f"regexp_matches(text, '{_sql_regex(p)}')" for p in X.VIOLATIONS["J_meta_statement"][1])
_I = " or ".join(f"regexp_matches(text, '{_sql_regex(p)}')" for p in X.VIOLATIONS["I_overlay_meta_leak"][1])


@register(f"""with {PAIRS}, sides as (select pair as id, 'local' as surface, local as text from prs union all select pair, 'reference', reference from prs),
f as (select surface, id, text, {TOKENS} as full_toks from sides), cap as (select *, full_toks[1:64] as toks from f),
pre as (select *, array_to_string(case when coalesce({_AT}, 0) > 0 then toks[{_AT}:{_AT} + 4] else [] end, ' ') as item from cap),
pc as (select surface, item, count(*) as cnt, min(id) as first from pre group by 1, 2), tp as (select surface, item from (select *, row_number() over (partition by surface order by cnt desc, first) as r from pc) where r <= 100),
g as ({grams(3)}), gc as (select surface, item, count(*) as cnt, min((id, pos)) as first from g group by 1, 2), tg as (select surface, item from (select *, row_number() over (partition by surface order by cnt desc, first) as r from gc) where r <= 100),
fr as (select g.surface, g.id, count(tg.item) / count(*) as fraction from g left join tg on g.surface = tg.surface and g.item = tg.item group by 1, 2),
g4 as ({grams(4)}), r4 as (select distinct surface, id from (select surface, id, item, count(*) as n from g4 group by 1, 2, 3) where n >= 2),
w as (select pre.surface, pre.id, len(full_toks)::double as avg_lexical_tokens, (len(full_toks) >= 64)::int::double as elig64, (len(full_toks) >= 128)::int::double as elig128, (r4.id is not null)::int::double as rep4_at64, ({_J})::int::double as fast_full_j_meta_statement, ({_I})::int::double as fast_full_i_overlay_meta_leak,
(tp.item is not null)::int::double as content_prefix_top100_hit, coalesce(fraction, 0) as m3_top100_fraction_at64 from pre left join tp on pre.surface = tp.surface and pre.item = tp.item left join fr on pre.surface = fr.surface and pre.id = fr.id left join r4 on pre.surface = r4.surface and pre.id = r4.id),
l as (unpivot w on avg_lexical_tokens, elig64, elig128, rep4_at64, fast_full_j_meta_statement, fast_full_i_overlay_meta_leak, content_prefix_top100_hit, m3_top100_fraction_at64 into name metric value value),
d as (select metric, id, sum(case when surface = 'local' then value else -value end) as delta from l group by 1, 2), s as (select metric, count(*) as n, avg(delta) as mean, coalesce(stddev_samp(delta), 0) as sd from d group by 1)
select metric, n, round(mean, 6) as mean, round(mean - case when n > 1 then 1.96 * sd / sqrt(n) else 0 end, 6) as low, round(mean + case when n > 1 then 1.96 * sd / sqrt(n) else 0 end, 6) as high from s""")
def paired_delta_ci(spark, sf_dir):
    return rounded(survey.paired_deltas(turn_pairs(spark, sf_dir)))


# ---- Support -----------------------------------------------------------------------------------------------------
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.captions(table(spark, sf_dir, "benchmark"), id_col="item_id", surface=F.lit("benchmark"))


BENCH = f"bench as (select 'benchmark' as surface, item_id as id, {TOKENS} as toks from benchmark)"


def _support(spark, sf_dir, buckets=None):
    frame = by_lang(spark, sf_dir)
    return rounded(support.compare(support.histogram(frame, 2, 64, buckets=buckets), support.histogram(prompts(spark, sf_dir), 2, buckets=buckets), buckets=buckets), 5)


@register(f"""with {CAP}, {BENCH}, a as (select surface, item, count(*) as a from ({grams(2, "toks[1:64]")}) group by 1, 2), p as (select item, count(*) as p from ({grams(2, source="bench")}) group by 1),
s as (select surface, sum(a) as an, count(*) as ak from a group by 1), pt as (select sum(p) as pt, count(*) as pk from p),
u as (select s.surface, item from s, p union select surface, item from a), j as (select u.surface, u.item, coalesce(a, 0) as a, coalesce(p, 0) as p from u left join a on u.surface = a.surface and u.item = a.item left join p on u.item = p.item),
z as (select surface, count(*) as size, sum((a > 0 and p > 0)::int) as bo, sum(case when p > 0 then a else 0 end) as a_on, sum(case when a > 0 then p else 0 end) as p_on from j group by 1),
q as (select j.surface, (a + 1e-12::double) / (an + size * 1e-12::double) as q, (p + 1e-12::double) / (pt + size * 1e-12::double) as r from j join z using (surface) join s using (surface), pt),
d as (select surface, sum(q * ln(q / r)) as ap, sum(r * ln(r / q)) as pa, sum(0.5 * q * ln(q / ((q + r) / 2)) + 0.5 * r * ln(r / ((q + r) / 2))) as js from q group by 1)
select surface, an::bigint as caption_total, pt::bigint as prompt_total, ak as caption_unique, pk as prompt_unique, bo::bigint as overlap, round((a_on + 1e-12::double * pk) / (an + size * 1e-12::double), 5) as caption_mass_on_prompt, round((p_on + 1e-12::double * ak) / (pt + size * 1e-12::double), 5) as prompt_mass_on_caption,
round(ap, 5) as kl_caption_to_prompt, round(pa, 5) as kl_prompt_to_caption, round(js, 5) as jsd from s join z using (surface) join d using (surface), pt""")
def support_exact(spark, sf_dir):
    return _support(spark, sf_dir)


@register()
def support_bucket(spark, sf_dir):
    """The same over CRC-32 buckets; tested against a dense histogram."""
    return _support(spark, sf_dir, support.BUCKETS)


@register(f"""with {CAP}, b as (select surface, id // 500 as block, toks from cap), g as (select surface, block, array_to_string(t[i:i+1], ' ') as item from (select surface, block, toks[1:64] as t, unnest(range(1, greatest(len(toks[1:64]) - 1, 0) + 1)) as i from b))
select surface, block, count(*) as total, count(distinct item) as distinct_items from g group by 1, 2""")
def support_blocks(spark, sf_dir):
    hist = support.histogram(support.blocks(by_lang(spark, sf_dir), 500), 2, 64, by=("surface", "block"))
    return hist.groupBy("surface", "block").agg(F.sum("cnt").alias("total"), F.count("*").alias("distinct_items"))


@register()
def support_pools(spark, sf_dir):
    """Divergence of disjoint hash pools from the prompt pool, by surface and pool."""
    frame = support.pools(by_lang(spark, sf_dir), "documents", 7, 4, 0.2)
    return rounded(support.compare(support.histogram(frame, 2, 64, by=("surface", "pool")), support.histogram(prompts(spark, sf_dir), 2), by=("surface", "pool")))


from . import more, rest  # noqa: E402,F401  registers the other families
