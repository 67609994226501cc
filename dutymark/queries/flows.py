"""Sources, cascades and event tables over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, text
from dutymark.operators import lookups as L
from dutymark.operators import similarity as S
from dutymark.plans import cascade as W
from dutymark.queries.lookups import ALIASES, CANON, CHAPTER, DIG, EXACT, FOOD, KEY, WORD_ROWS, WORDS, as_queries, rule_table
from dutymark.queries.scalars import NAME_SQL, NO_SIZE, NOISE, POS_SQL, R1_TRI, SAC, SYN_SQL, TYPOS_SQL, chain_sql, listed, squeeze, tokens_sql
from dutymark.queries.similarity import SCOPE, SIM, fts_sql
from dutymark.registry import query
from dutymark.sources import files
from dutymark.streaming import events as E

C = F.col
canon = codes.canonicalize_hsn
DEC = r"try_cast(nullif(regexp_extract(gst_raw, '(\d+(?:\.\d+)?)', 1), '') as double)"


@query("s2_longest_descriptions", "v_catalog", f"select {DIG('raw_code')} as raw_hsn_code, id as ord, description from v_catalog where {DIG('raw_code')} <> '' qualify row_number() over (partition by {DIG('raw_code')} order by len(coalesce(description, '')) desc, id) = 1")
def _(c):
    return files.longest_descriptions(c.select(codes.digits(C("raw_code")).alias("raw_hsn_code"), C("id").alias("ord"), "description"))


@query("s3_load_verified", "v_catalog", f"""with d as (select id, description, upper(trim(description)) as key, raw_code from v_catalog)
select id, description, key, case when len({DIG('raw_code')}) < 8 then lpad({DIG('raw_code')}, 8, '0') else {DIG('raw_code')} end as hsn_code, {NO_SIZE('description')} as no_size from d qualify row_number() over (partition by key order by id) = 1""")  # fmt: skip
def _(c):
    sheet = c.select(C("description").alias("Item Description"), C("raw_code").alias("HSN_SAC (As per The GST)"), "id")
    return files.load_verified(files.resolve_columns(sheet, {"description": ("item description",), "hsn": ("HSN_SAC (As per The GST)",), "id": ()}), "id").drop("hsn")


@query("s5_load_pending", "v_catalog", f"""with p as (select trim(description) as product_name, min(case when {DIG('raw_code')} = '' then null when len({DIG('raw_code')}) < 8 then lpad({DIG('raw_code')}, 8, '0') else {DIG('raw_code')} end) as hsn_code from v_catalog where id % 3 = 0 group by 1)
select product_name, hsn_code, 'pending' as status from p where product_name not in (select description from v_catalog where id % 2 = 0)""")  # fmt: skip
def _(c):
    rows = c.filter("id % 3 = 0").select(C("description").alias("name"), C("raw_code").alias("hsn"))
    return files.load_pending(rows, c.filter("id % 2 = 0").select(C("description").alias("product_name")))


CELLS = "select id as ord, raw_code || ' to ' || brand || ' ' || (1000 + id % 300) as cell, case id % 6 when 0 then 'Nil' when 1 then null when 2 then 'EXEMPT' else gst_raw end as rate_text from v_catalog"


@query("s6_schedule_prefix_rates", "v_catalog", f"""with c as ({CELLS}), e as (select unnest(regexp_extract_all(cell, '\\b(\\d{{2,8}})\\b', 1)) as prefix, case when upper(trim(rate_text)) in ('NIL', 'EXEMPT', 'NA', '-') then 0.0 else {DEC.replace('gst_raw', 'rate_text')} end as rate, ord from c)
select prefix, arg_max(rate, ord) as rate from e where rate is not null group by 1""")  # fmt: skip
def _(c):
    return files.schedule_prefix_rates(c.selectExpr("id as ord", "raw_code || ' to ' || brand || ' ' || (1000 + id % 300) as cell", "case id % 6 when 0 then 'Nil' when 1 then null when 2 then 'EXEMPT' else gst_raw end as rate_text"))


@query("s7_master_report", "v_tariff", "select hsn_code[1:2] as chapter, hsn_code, coalesce(description, '') as description, cast(cast(gst_rate as int) as varchar) || '%' as gst_rate, case when hsn_code[1:2] in ('22', '24', '27', '87') then 'Yes' else 'No' end as cess from v_tariff")
def _(t):
    return files.master_report(t)


BULK = "select id as row_id, name as query, case id % 4 when 0 then null else code end as hsn_code, cast(id % 101 as int) as confidence, id % 6 = 0 as review from v_codes"


@query("s8_bulk_report", "v_codes", f"with b as ({BULK}) select row_id, query, case when hsn_code <> '' then case when len(hsn_code) > 8 then hsn_code[1:8] else lpad(hsn_code, 8, '0') end end as hsn_code, confidence || '%' as confidence, case when hsn_code is null then 'Not found' when review then 'Needs review' else 'Matched' end as status from b")
def _(c):
    return files.bulk_report(c.selectExpr("id as row_id", "name as query", "case id % 4 when 0 then null else code end as hsn_code", "cast(id % 101 as int) as confidence", "id % 6 = 0 as review"))


@query("s9_audit_events", "v_search_events", "select event_id, ts, product_name, source, confidence, sha256(cast(api_key as varchar))[1:16] as api_key_hash from v_search_events")
def _(e):
    return files.audit_events(e)


@query("s10_intake", "v_codes", "select id as row_id, trim(coalesce(category, '')) as text, trim(coalesce(category, '')) = '' as failed from v_codes")
def _(c):
    return files.intake(c, "category", "id")


@query("s12_prediction_rows", "v_codes", f"with b as ({BULK}) select sha256('run1|' || row_id || '|' || query) as request_id, query as input_text, hsn_code as predicted_hsn, confidence, confidence < 70 as needs_review from b")
def _(c):
    return files.prediction_rows(c.selectExpr("id as row_id", "name as query", "case id % 4 when 0 then null else code end as hsn_code", "cast(id % 101 as int) as confidence"), "run1")


MISS = "select *, case when event_id % 3 = 0 then lower(product_name) || event_id % 5 end as normalized from v_search_events"


@query("e1_miss_counts", "v_search_events", f"with e as ({MISS}) select product_name as name, count(*) as n, arg_max(normalized, (ts, event_id)) filter (normalized is not null) as normalized, split_part(product_name, ' ', 1) as first_word, max(ts) as updated from e group by product_name")
def _(e):
    marked = e.withColumn("normalized", F.when(C("event_id") % 3 == 0, F.concat(F.lower("product_name"), (C("event_id") % 5).cast("string"))))
    return E.miss_counts(marked).drop("normalized_at")


@query("e2_cache_state", "v_search_events", """with s as (select * from v_search_events where confidence >= 70 qualify row_number() over (partition by product_name order by ts desc, event_id desc) = 1), h as (select product_name, count(*) as hits from v_search_events group by 1)
select product_name as key, source, confidence, hits, ts + interval 30 day as expires_at from s join h using (product_name) where ts + interval 30 day > timestamp '2024-01-31 12:00:00'""")  # fmt: skip
def _(e):
    return E.cache_state(e, "2024-01-31 12:00:00")


@query("e3_calls_per_minute", "v_search_events", "select api_key, date_trunc('minute', ts) as minute, count(*) as calls, count(*) > 1 as over from v_search_events group by 1, 2")
def _(e):
    return E.calls_per_minute(e, 1)


@query("e4_warm_list", "v_search_events", """with n as (select * from v_search_events where source in ('click', 'view') and confidence >= 65 order by ts desc, event_id desc limit 5000) select * from n qualify row_number() over (partition by product_name order by ts desc, event_id desc) = 1""")
def _(e):
    return E.warm_list(e, ["click", "view"])


PREDICTED = "lpad(cast(1 + event_id % 97 as {0}), 2, '0') || lpad(cast(1 + event_id % 50 as {0}), 2, '0') || case when event_id % 3 = 0 then '' else '1090' end"


@query("e4_warm_cache", "v_search_events v_tariff", f"""with e as (select *, {PREDICTED.format('varchar')} as raw_code from v_search_events), n as (select * from e where source in ('click', 'view') and confidence >= 65 order by ts desc, event_id desc limit 5000), w as (select *, {CANON('raw_code')} as code from n qualify row_number() over (partition by product_name order by ts desc, event_id desc) = 1),
t as (select hsn_code, description, gst_rate from v_tariff qualify row_number() over (partition by hsn_code order by description, gst_rate) = 1)
select product_name, code as hsn_code, coalesce(nullif(trim(t.description), ''), 'HSN ' || code) as description, t.gst_rate, code[1:2] as chapter, confidence / 100.0::double as score, case when confidence / 100.0::double >= 0.80 then 'high' when confidence / 100.0::double >= 0.55 then 'medium' else 'low' end as label, confidence / 100.0::double < 0.55 as review from w left join t on t.hsn_code = code""")  # fmt: skip
def _(e, t):
    return E.warm_cache(e.withColumn("raw_code", F.expr(PREDICTED.format("string"))), t, ["click", "view"]).drop("cache_key")


CANDS = f"""select id % 700 as query_id, cast(id % 6 as int) as tier, {CANON('raw_code')} as hsn_code, cast(40 + (id * 7) % 60 as int) as confidence, case id % 3 when 0 then 'exact' else 'late' end as layer, case id % 4 when 0 then 'curated' when 1 then 'verified' else 'tariff' end as trust, id % 5 = 0 as review from v_catalog"""
CASCADE = "select *, confidence >= 70 and not review as accepted from cands qualify row_number() over (partition by query_id order by confidence >= 70 and not review desc, case when confidence >= 70 and not review then tier else -confidence end, tier, confidence desc, hsn_code) = 1"


def cands(c):
    return c.select((C("id") % 700).alias("query_id"), (C("id") % 6).cast("int").alias("tier"), canon(C("raw_code")).alias("hsn_code"), (40 + (C("id") * 7) % 60).cast("int").alias("confidence"), F.expr("case id % 3 when 0 then 'exact' else 'late' end").alias("layer"), F.expr("case id % 4 when 0 then 'curated' when 1 then 'verified' else 'tariff' end").alias("trust"), (C("id") % 5 == 0).alias("review"))


@query("w1_resolve_cascade", "v_catalog", f"with cands as ({CANDS}) {CASCADE}")
def _(c):
    return W.resolve_cascade(cands(c))


GOODS = "select hsn_code, min(gst_rate) as gst_rate, case when cast(hsn_code[1:2] as int) % 3 = 0 then 12.0 end::double as cess_rate, case cast(hsn_code[1:2] as int) % 4 when 0 then 'combined' end as rate_semantics from v_tariff where cast(hsn_code[3:4] as int) % 2 = 0 group by 1"
TAX = f"""goods as ({GOODS}), rates as (select hsn_code, gst_rate from v_tariff where gst_rate is not null qualify row_number() over (partition by hsn_code order by description) = 1), hist as (select chapter, gst_rate as h from v_rate_history where effective_to is null qualify row_number() over (partition by chapter order by effective_from desc, gst_rate) = 1)"""


def taxed(source: str) -> str:
    return f"""select r.*, case when regexp_full_match({DIG('r.hsn_code')}, '99[0-9]{{2}}([0-9]{{2}})?') then 'SAC' else 'HSN' end as code_type, case when sv is not null then 'combined' when g.gst_rate is not null then coalesce(g.rate_semantics, 'igst_only') when coalesce(t.gst_rate, {CHAPTER(DIG('r.hsn_code'))}) is not null then 'combined' else 'unknown' end as semantics,
coalesce(sv, g.gst_rate, t.gst_rate, {CHAPTER(DIG('r.hsn_code'))}) as gst_rate, case when sv is null then g.cess_rate end as cess_rate,
case when sv is not null then sv when g.gst_rate is not null then case when coalesce(g.rate_semantics, 'igst_only') = 'igst_only' and coalesce(g.cess_rate, 0) <> 0 then round(g.gst_rate + g.cess_rate, 4) when coalesce(g.rate_semantics, 'igst_only') = 'combined' then g.gst_rate else greatest(g.gst_rate, coalesce(h, g.gst_rate)) end when t.gst_rate is not null then coalesce(h, t.gst_rate) else {CHAPTER(DIG('r.hsn_code'))} end as effective_tax,
coalesce(sv is null and g.gst_rate is not null and h is not null and abs(h - g.gst_rate) > 0.01 and not (coalesce(abs(h - g.gst_rate - g.cess_rate) < 0.02, false) and g.cess_rate <> 0) and not (g.gst_rate = 0 and h = 5), false) as rate_conflict,
case when sv is not null then 'service_master' when g.gst_rate is not null then 'hsn_master' when t.gst_rate is not null then 'hsn_codes' when {CHAPTER(DIG('r.hsn_code'))} is not null then 'chapter' end as rate_table
from (select *, case when regexp_full_match({DIG('hsn_code')}, '99[0-9]{{2}}([0-9]{{2}})?') and cast({DIG('hsn_code')}[3:4] as int) % 2 = 0 then 18.0::double end as sv from {source}) r left join goods g on g.hsn_code = {DIG('r.hsn_code')} left join rates t on t.hsn_code = {DIG('r.hsn_code')} left join hist on hist.chapter = {DIG('r.hsn_code')}[1:2]"""


def goods(t):
    ch = F.substring("hsn_code", 1, 2).cast("int")
    g = t.filter(F.substring("hsn_code", 3, 2).cast("int") % 2 == 0).groupBy("hsn_code").agg(F.min("gst_rate").alias("gst_rate"))
    return g.select("hsn_code", "gst_rate", F.when(ch % 3 == 0, 12.0).alias("cess_rate"), F.when(ch % 4 == 0, "combined").alias("rate_semantics"))


def services(spark):
    return spark.range(0, 100, 2).select(F.concat(F.lit("99"), F.lpad(C("id").cast("string"), 2, "0")).alias("sac_code"), F.lit(18.0).alias("gst_rate"))


@query("j17_enrich_tax", "v_codes v_tariff v_rate_history", f"with {TAX}, src as (select id, coalesce(code, '') as hsn_code from v_codes union all select null, hsn_code from v_tariff) select * exclude (sv) from ({taxed('src')})")
def _(c, t, h):
    # the tariff's codes join the codes of all shapes
    more = t.select(F.lit(None).cast("long").alias("id"), "hsn_code")
    return W.enrich_tax(c.select("id", F.coalesce("code", F.lit("")).alias("hsn_code")).union(more), goods(t), services(t.sparkSession), t, h)


SHOW = f"case when regexp_full_match({DIG('hsn_code')}, '99[0-9]{{2}}([0-9]{{2}})?') then {DIG('hsn_code')}[1:6] when len({DIG('hsn_code')}) < 8 then rpad({DIG('hsn_code')}, 8, '0') else {DIG('hsn_code')} end"
FINAL = "review or (rate_conflict and not (confidence >= 70 and tier <= 4 and trust in ('curated', 'verified', 'fuzzy'))) or (confidence < 70 and tier >= 5)"


@query("w3_finalize", "v_catalog v_tariff v_rate_history", f"with cands as ({CANDS}), w as ({CASCADE}), {TAX}, x as ({taxed('w')}) select * exclude (sv) replace ({FINAL} as review, {SHOW} as hsn_code) from x")
def _(c, t, h):
    return W.finalize(W.enrich_tax(W.resolve_cascade(cands(c)), goods(t), services(t.sparkSession), t, h))


@query("w4_to_review", "v_catalog", f"with cands as ({CANDS}), w as ({CASCADE}) select query_id, hsn_code, least(confidence, 40) as confidence, 'Needs manual review' as description, true as review from w where not accepted")
def _(c):
    return W.to_review(W.resolve_cascade(cands(c)).filter(~C("accepted"))).select("query_id", "hsn_code", "confidence", "description", "review")


def keywords(spark):
    return spark.createDataFrame(list(WORDS), "keyword string, code string, priority int")


# the distinct texts of all rows, and words of the tariff as short texts; they take the place of the rows in the SQL of the single tiers
ONCE = "v_asked as materialized (select distinct upper(trim(regexp_replace(query, '\\s+', ' ', 'g'))) as query from (select query from v_queries union all select category from v_tariff union all select split_part(description, ' ', 3) from v_tariff)), v_open0 as (select query from v_asked where query <> '')"


def swap(sql: str, step: int) -> str:
    """SQL of a tier over the texts that are open before step."""
    return sql.replace("row_id as query_id", "query as query_id").replace("from v_queries", f"from v_open{step}")


def opened(step: int) -> str:
    """The texts open after step."""
    return f"v_open{step + 1} as materialized (select query from v_open{step} where query not in (select query_id from t{step} where confidence >= 70 and not review))"


def tier(step: int, body: str) -> str:
    return f"t{step} as materialized ({body}), {opened(step)}"


TOP = lambda by: f"qualify row_number() over (partition by query_id order by {by}) = 1"
QUERY_GRAMS = lambda step: f"g{step} as materialized (select query as query_id, {R1_TRI('query')} as ta from v_open{step})"
# every catalog row is in one reference table, by its first word: cache OLD, verified RED and SMALL, aliases BLUE, brand terms COLD, regional HOT, brands LARGE, curated NEW
CURATED = "v_catalog where starts_with(description, 'NEW ')"
SAID = f"(select query as query_id, {squeeze('lower(query)')} as p from v_open4)"
OPEN_WORDS = f"""kw1 as (select query as query_id, {TYPOS_SQL.replace('(text)', '(query)')} as fixed from v_open9), kw2 as (select query_id, regexp_extract_all(upper(fixed), '([A-Z0-9_]+|[^A-Z0-9_]+)') as w from kw1), kw3 as (select query_id, {POS_SQL} as text from kw2),
kw4 as (select query_id, list_filter(string_split({squeeze(chain_sql('upper(text)', NOISE))}, ' '), lambda x: x <> '') as w from kw3), kw5 as (select query_id, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: not list_contains({listed([b.upper() for b in fixed.BRANDS])}, w[i]))), len(w) + 1) as first from kw4),
kw6 as (select query_id, w, case when first > len(w) then w[greatest(len(w) - 1, 1):] else w[first:] end as rest from kw5), kw7 as (select query_id, array_to_string(case when len(w) = 0 then [] when len(rest) >= 2 and len(rest[-1]) >= 5 then [rest[-1]] when len(rest) >= 2 then [rest[-2] || ' ' || rest[-1]] else rest[1:1] end, ' ') as kw from kw6),
kw8 as (select query_id, {R1_TRI('kw')} as ta from kw7 where kw <> '')"""
MERGED = f"""v8 as (select query as query_id, {KEY('query')} as k, {NO_SIZE('query')} as b from v_open8), c8 as (select id, {CANON('raw_code')} as code, {KEY('description')} as dk, {NO_SIZE('description')} as db from v_catalog), v9 as materialized (select *, {R1_TRI('k')} as tk, {R1_TRI('b')} as tb from v8), c9 as materialized (select *, {R1_TRI('dk')} as uk, {R1_TRI('db')} as ub from c8),
s9 as materialized (select query_id, id, code, k = dk as same, b = db as bare, {SIM('tk', 'uk')} as s1, {SIM('tb', 'ub')} as s2 from v9, c9), m1 as (select query_id, id, code, round(s1, 9) as score from s9 where s1 > 0.5 {TOP('s1 desc, id')}), m2 as (select query_id, id, code, round(s2, 9) as score from s9 where s2 > 0.5 {TOP('s2 desc, id')}),
m3 as (select query_id, id, code, max(score) as score from (select query_id, id, code, 1.0::double as score from s9 where same union all select query_id, id, code, 0.94::double from s9 where bare union all from m1 union all from m2) group by 1, 2, 3), early as (select query_id, code as hsn_code, 'L6_verified_products' as method, score from (select * from m3 {TOP('score desc, id')}) where score >= 0.94),
one as materialized (select hsn_code, min(description) as description, min(category) as category from v_tariff group by 1), w8 as (select query as query_id, list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '') as l from v_open8 where query not in (select query_id from early)), d8 as (select query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] as l from w8), e8 as (select query_id, len(l) as n, unnest(range(1, len(l) + 1)) as pos, unnest(l) as word from d8),
k8 as (select hsn_code, token, max(weight) as weight from (select hsn_code, unnest(string_split_regex(lower(description), '[^a-z0-9]+')) as token, 1.0 as weight from one union all select hsn_code, unnest(string_split_regex(lower(category), '[^a-z0-9]+')), 0.4 from one) where token <> '' group by 1, 2),
p8 as (select query_id, hsn_code, pos, max(weight) as weight from e8 join k8 on word = token or (pos = n and len(word) >= 2 and starts_with(token, word)) group by 1, 2, 3), f8 as (select query_id, hsn_code, round(sum(weight) / (1 + sum(weight)), 9)::double as score from p8 group by 1, 2), words8 as (select query_id, hsn_code, 'L2_inverted_index' as method, score from f8 {TOP('score desc, hsn_code')}),
one8 as materialized (select hsn_code, {R1_TRI('description')} as tb from one), near8 as (select query_id, hsn_code, 'L3_pg_trgm_fuzzy' as method, round({SIM('ta', 'tb')}, 9) as score from g8, one8 where query_id not in (select query_id from early) and {SIM('ta', 'tb')} > 0.3 {TOP(SIM('ta', 'tb') + ' desc, hsn_code')}),
pool8 as (select *, score + case method when 'L6_verified_products' then 0.18 when 'L2_inverted_index' then 0.10 else 0.05 end::double as adjusted from (from early union all from words8 union all from near8) where hsn_code not in ('', '99999999', '00000000')),
multi8 as (select query_id, hsn_code, cast(least(90, greatest(40, floor(round(least(1.0, greatest(0.0, adjusted)), 4) * 100))) as int) as confidence from pool8 {TOP('adjusted desc, hsn_code')})"""
STEPS = f"""{ONCE}, cache as (select upper(trim(regexp_replace(description, '\\s+', ' ', 'g'))) as key, min({CANON('raw_code')}) as code from v_catalog where starts_with(description, 'OLD ') group by 1),
{tier(0, "select query as query_id, 0 as step, code as hsn_code, 100 as confidence, 'L0_cache' as layer, 'curated' as trust, false as review from v_open0 join cache on query = key")},
{swap(EXACT, 1).replace('from v_catalog)', "from v_catalog where starts_with(description, 'RED ') or starts_with(description, 'SMALL '))")}, {tier(1, f"select query_id, 1 as step, {CANON('raw_code')} as hsn_code, case when priority = 0 then 99 else 88 end as confidence, 'L0_verified_product' as layer, 'verified' as trust, false as review from exact")},
{swap(ALIASES, 2).replace('join v_alias on', "join (select * from v_alias where starts_with(alias, 'blue ')) on")}, {tier(2, f"select query_id, 2 as step, {CANON('code')} as hsn_code, 98 as confidence, 'L0_alias_dict' as layer, 'curated' as trust, false as review from alias_hits")},
terms as (select {NO_SIZE('description')} as term, min({CANON('raw_code')}) as code, max(1.0 + (id % 10) / 8.0) as weight from v_catalog where starts_with(description, 'COLD ') group by 1), bt as (select query as query_id, {NO_SIZE('query')} as n from v_open3), bk as (select query_id, unnest([0, 1]) as pos, unnest([coalesce(list_filter(string_split(n, ' '), lambda w: len(w) >= 2 and not list_contains({listed([x.upper() for x in fixed.STOPWORDS])}, w))[1], ''), array_to_string(string_split(n, ' ')[1:2], ' ')]) as term from bt),
bh as (select query_id, code, least(1.0, weight / 2) as score from bk join terms using (term) where term <> '' {TOP('pos, weight desc, code')}), {tier(3, f"select query_id, 3 as step, {CANON('code')} as hsn_code, cast(round(score * 100) as int) as confidence, 'L1_brand_lookup' as layer, 'curated' as trust, false as review from bh where score >= 0.65")},
ra as (select query_id, alias, code, p from {SAID} join (select * from v_alias where starts_with(alias, 'hot ')) on starts_with(p, alias) or (len(alias) >= 10 and starts_with(p, alias[1:8])) where len(p) >= 3 {TOP('p = alias desc, len(alias) desc, alias')}), {tier(4, f"select query_id, 4 as step, {CANON('code')} as hsn_code, case when p = alias then 96 else 92 end as confidence, 'L0_kerala_retail' as layer, 'curated' as trust, false as review from ra")},
brands as (select description as brand, min({CANON('raw_code')}) as code from v_catalog where starts_with(description, 'LARGE ') group by 1), {tier(5, "select query as query_id, 5 as step, code as hsn_code, 99 as confidence, 'L1_brand_alias' as layer, 'curated' as trust, false as review from v_open5 join brands on query = brand")},
{QUERY_GRAMS(6)}, cur as materialized (select id, {CANON('raw_code')} as code, id % 3 as scope, {R1_TRI('description')} as tb from {CURATED}), ch as (select query_id, code, round({SIM('ta', 'tb')}, 9) as s from g6, cur where {SIM('ta', 'tb')} > 0.38 {TOP(f"scope, round({SIM('ta', 'tb')}, 9) desc, id")}), {tier(6, "select query_id, 6 as step, code as hsn_code, cast(case when s > 0.5 then 80 else greatest(65, floor(s * 100)) end as int) as confidence, 'L3_curated_master' as layer, 'curated' as trust, false as review from ch")},
kwm(keyword, code, priority) as (values {WORD_ROWS}), {tier(7, f"select query as query_id, 7 as step, code as hsn_code, 75 as confidence, 'L4_keyword_category' as layer, 'curated' as trust, false as review from v_open7 join kwm on contains(query, upper(keyword)) {TOP('len(keyword) desc, priority desc, keyword, code')}")},
{QUERY_GRAMS(8)}, {MERGED}, late8 as (select query_id, hsn_code, cast(least(75, greatest(55, floor(round({SIM('ta', 'tb')}, 9) * 100))) as int) as confidence from g8, one8 where {SIM('ta', 'tb')} > 0.32 {TOP(SIM('ta', 'tb') + ' desc, hsn_code')}),
c8g as materialized (select id, {CANON('raw_code')} as hsn_code, {R1_TRI('description')} as tb from v_catalog), fuzzy8 as (select query_id, hsn_code, case when round({SIM('ta', 'tb')}, 9) >= 0.6 then 85 else 70 end as confidence from g8, c8g where {SIM('ta', 'tb')} > 0.45 {TOP(SIM('ta', 'tb') + ' desc, id')}),
{tier(8, f"select query_id, 8 as step, hsn_code, confidence, layer, trust, layer = 'L5_multi' and confidence < 70 as review from (select *, 'L4_tariff_fallback' as layer, 'tariff' as trust from late8 union all select *, 'L5_fuzzy', 'fuzzy' from fuzzy8 union all select *, 'L5_multi', 'fuzzy' from multi8) {TOP('confidence desc, layer, hsn_code')}")},
{OPEN_WORDS}, kh as (select query_id, code, round({SIM('ta', 'tb')}, 9) as s from kw8, cur where {SIM('ta', 'tb')} > 0.25 {TOP(SIM('ta', 'tb') + ' desc, id')}), {tier(9, "select query_id, 9 as step, code as hsn_code, case when s >= 0.7 then 82 when s >= 0.5 then 75 when s >= 0.35 then 68 else 60 end as confidence, 'L5_keyword_fallback' as layer, 'fuzzy' as trust, false as review from kh")},
every as (select *, confidence >= 70 and not review as accepted from ({' union all '.join(f'from t{n}' for n in range(10))})), best as (select * from every {TOP('accepted desc, case when accepted then step else -confidence end, step, confidence desc, hsn_code')}),
work as materialized (select a.query as query_id, case when coalesce(accepted, false) then cast([0, 2, 1, 1, 3, 1, 3, 4, 5, 5][step + 1] as int) else 6 end as tier, hsn_code, case when coalesce(accepted, false) then confidence else least(coalesce(confidence, 0), 40) end as confidence, case when coalesce(accepted, false) then layer else 'L6_pending_review' end as layer, coalesce(trust, 'none') as trust,
not coalesce(accepted, false) as review, coalesce(accepted, false) as accepted from v_open0 a left join best on best.query_id = a.query)"""


def refs(c, a, t, h):
    code = F.min(canon(C("raw_code"))).alias("code")
    opens = lambda df, column, word: df.filter(F.startswith(column, F.lit(word)))
    return {
        "cache": opens(c, "description", "OLD ").groupBy(text.query_key(C("description")).alias("key")).agg(code), "verified": opens(c, "description", "RED ").unionByName(opens(c, "description", "SMALL ")), "catalog": c, "aliases": opens(a, "alias", "blue "), "regional": opens(a, "alias", "hot "),
        "brand_terms": opens(c, "description", "COLD ").groupBy(text.strip_sizes(C("description")).alias("term")).agg(code, F.max(1.0 + (C("id") % 10) / 8.0).alias("weight")), "brands": opens(c, "description", "LARGE ").groupBy(C("description").alias("brand")).agg(code),
        "curated": opens(c, "description", "NEW ").selectExpr("id", "description", "raw_code", SCOPE), "keywords": keywords(c.sparkSession), "tariff": t, "goods": goods(t), "services": services(c.sparkSession), "history": h,
    }


def asked(q, t):
    short = t.select(C("category").alias("query")).union(t.select(F.split_part("description", F.lit(" "), F.lit(3))))
    every = q.select("query").union(short).select(text.query_key(C("query")).alias("query_id")).distinct().filter("query_id <> ''")
    return every.withColumn("text", C("query_id"))


@query("w2_classify_distinct", "v_queries v_catalog v_alias v_tariff", f"with {STEPS} select * from work")
def _(q, c, a, t):
    return W.classify_distinct(asked(q, t), refs(c, a, t, None))


@query("w9_classify_bulk", "v_queries v_catalog v_alias v_tariff v_rate_history", f"""with {STEPS}, {TAX}, x as (select * exclude (sv) replace ({FINAL} as review, {SHOW} as hsn_code) from ({taxed('work')}))
select row_id, v_queries.query, hsn_code, confidence, tier, layer, gst_rate, effective_tax, coalesce(review, true) as review from v_queries left join x on x.query_id = upper(trim(regexp_replace(v_queries.query, '\\s+', ' ', 'g')))""")  # fmt: skip
def _(q, c, a, t, h):
    return W.classify_bulk(q, refs(c, a, t, h))


@query("w10_to_bulk_result", "v_codes", f"""with b as ({BULK}), r as (select *, case row_id % 3 when 0 then null else 18.0 end as gst_rate from b),
e as (select id as row_id, unnest([1, 2, 3, 4]) as pos, unnest([code, '99999999', substr(code, 1, 4), name[1:0]]) as code, unnest([id % 150, 90, 0.62, null]) as s from v_codes where id % 4 <> 0 and id % 10 <> 0),
o as (select row_id, pos, code as raw, case when {SAC} then substr({DIG('code')}, 1, 6) when len({DIG('code')}) < 8 then rpad({DIG('code')}, 8, '0') else {DIG('code')} end as code, coalesce(nullif(s::double, 0), 0.5) as s from e),
l as (select row_id, list(code order by pos) as alternate_codes, list(round(case when s > 1 then s / 100.0 else s end, 4)::double order by pos) as alternate_scores from o where coalesce(raw, '') not in ('', '99999999', '00000000') and code not in ('', '99999999', '00000000') group by 1)
select row_id, query, hsn_code, case when hsn_code is null then 'empty' when regexp_full_match(hsn_code, '[0-9]{{4}}|[0-9]{{6}}|[0-9]{{8}}') and hsn_code not in ('99999999', '00000000') and gst_rate is not null and confidence >= 70 and not review then 'ok' else 'needs review' end as state, round(confidence / 100.0, 4)::double as score, case when confidence >= 80 then 'high' when confidence >= 55 then 'medium' else 'low' end as label,
case when hsn_code is null then [] else coalesce(alternate_codes, []) end as alternate_codes, case when hsn_code is null then [] else coalesce(alternate_scores, []) end as alternate_scores from r left join l using (row_id)""")  # fmt: skip
def _(c):
    listed = "array(struct(code as hsn_code, cast(id % 150 as double) as score), struct('99999999' as hsn_code, 90D as score), struct(substring(code, 1, 4) as hsn_code, 0.62D as score), struct('' as hsn_code, cast(null as double) as score))"
    rows = c.selectExpr("id as row_id", "name as query", "case id % 4 when 0 then null else code end as hsn_code", "cast(id % 101 as int) as confidence", "id % 6 = 0 as review", "case id % 3 when 0 then null else 18.0D end as gst_rate", f"case when id % 10 <> 0 then {listed} end as alternates")
    return W.to_bulk_result(rows)


def tariff_matcher(t, floor=0.3):
    one = t.groupBy(C("hsn_code").alias("id")).agg(F.min("description").alias("description"))
    return lambda q: S.trgm_topk(q, one, floor, 1).select("query_id", C("id").alias("hsn_code"), C("similarity").alias("score"))


@query("w11_analyze_pending", "v_text v_tariff", f"""with names as ({NAME_SQL}), v as (select id, 0 as variant, text from v_text union all select id, 1, case when regexp_matches(text, '[^\\x00-\\x7F]') then trim(text) else name end from v_text left join names using (id)),
u as (select text, {R1_TRI('text')} as ta from (select distinct text from v)), t as (select hsn_code, {R1_TRI('min(description)')} as tb from v_tariff group by 1), b as (select text, hsn_code, round({SIM('ta', 'tb')}, 9) as score from u, t where {SIM('ta', 'tb')} > 0.3 qualify row_number() over (partition by text order by {SIM('ta', 'tb')} desc, hsn_code) = 1)
select id, cast(variant as int) as variant, hsn_code, score, case when score >= 0.80 then 'update' else 'review' end as action from v join b using (text) qualify row_number() over (partition by id order by score desc, variant, hsn_code) = 1""")  # fmt: skip
def _(x, t):
    return W.analyze_pending(x.select("id", "text"), tariff_matcher(t))


@query("w12_match_query", "v_text v_tariff v_catalog")
def _(x, t, c):
    return W.match_query(x.select(C("id").alias("query_id"), F.when(C("id") % 5 == 0, F.lpad((1 + C("id") % 97).cast("string"), 4, "0")).otherwise(C("text")).alias("text")), t, 5, c)


@query("w13_search_products", "v_text v_tariff v_catalog")
def _(x, t, c):
    return W.search_products(x.select(C("id").alias("query_id"), F.when(C("id") % 5 == 0, F.lpad((1 + C("id") % 97).cast("string"), 2, "0")).otherwise(C("text")).alias("text")), t, 5, c)


BRANDED = "upper(split_part(description, ' ', 1)) || case when len(split_part(description, ' ', 1)) >= 5 then 'S' else '' end"
CATEGORIES = ("anvil", "ring", "new")
STOP_LIST = listed([x.upper() for x in fixed.STOPWORDS])
BRAND_SQL = f"""c as (select id, description, raw_code, {BRANDED} as brand from v_catalog), known as (select *, {CANON('raw_code')} as code from c where coalesce(raw_code, '') not in ('', '99999999', '00000000')),
a as (select {NO_SIZE('description')} as term, min({CANON('raw_code')}) as code, case when len({NO_SIZE('description')}) % 2 = 0 then 2.0 else 0.6 end::double as weight from c group by 1), q as (select distinct row_id as query_id, query, {NO_SIZE('query')} as n from v_queries),
b as (select *, coalesce(list_filter(string_split(n, ' '), lambda w: len(w) >= 2 and not list_contains({STOP_LIST}, w))[1], '') as token from q), k as (select query_id, unnest([0, 1]) as pos, unnest([token, array_to_string(string_split(n, ' ')[1:2], ' ')]) as term from b),
s1 as (select query_id, code, least(1.0, weight / 2) as score, 1 as step from k join a using (term) where term <> '' {TOP('pos, weight desc, code')}), m as (select brand, code from (select brand, code, count(*) as n from known group by 1, 2) qualify row_number() over (partition by brand order by n desc, code) = 1),
s2 as (select query_id, code, 0.85 as score, 2 as step from b join m on brand = token), t3 as (select distinct token, {R1_TRI('token')} as ta from b where len(token) >= 4), m3 as (select code, {R1_TRI('brand')} as tb from m),
b3 as (select token, code, {SIM('ta', 'tb')} as s from t3, m3 where {SIM('ta', 'tb')} >= 0.35 qualify row_number() over (partition by token order by s desc, code) = 1), s3 as (select query_id, code, round(round(s, 9) * 0.9, 6) as score, 3 as step from b join b3 using (token)),
cat as (select unnest({listed(CATEGORIES)}) as keyword), cm as (select keyword, code from (select keyword, code, count(*) as n from known join cat on contains(lower(description), keyword) group by 1, 2) qualify row_number() over (partition by keyword order by n desc, code) = 1),
s4 as (select query_id, code, 0.65 as score, 4 as step from (select query_id, list_filter({listed(CATEGORIES)}, lambda x: contains(lower(query), x))[1] as keyword from b) join cm using (keyword))
select query_id, code, score::double as score, cast(step as int) as step from (from s1 union all from s2 union all from s3 union all from s4) where score >= 0.5 {TOP('step, score desc, code')}"""


@query("w15_brand_lookup", "v_queries v_catalog", f"with {BRAND_SQL}")
def _(q, c):
    first = F.upper(F.substring_index("description", " ", 1))
    own = c.withColumn("brand", F.when(F.length(first) >= 5, F.concat(first, F.lit("S"))).otherwise(first))
    term = text.strip_sizes(C("description"))
    aliases = c.groupBy(term.alias("term")).agg(F.min(canon(C("raw_code"))).alias("code")).withColumn("weight", F.when(F.length("term") % 2 == 0, 2.0).otherwise(0.6))
    return W.brand_lookup(as_queries(q), aliases, own, 0.5, ["oil"], CATEGORIES, 4)


@query("w6_multi_search", "v_text v_catalog v_tariff")
def _(x, c, t):
    return W.multi_search(as_queries(x, "id", "text"), c, t, x.select(C("id").alias("query_id"), F.array(F.lit("10")).alias("codes")))


@query("w6_expanded_search", "v_text v_catalog v_tariff")
def _(x, c, t):
    terms = x.sparkSession.createDataFrame([("vellam", "jaggery", 2.0), ("podi", "powder", 1.0), ("biscuit", "anvil", 1.0)], "term string, english string, weight double")
    term = text.strip_sizes(C("description"))
    brands = c.groupBy(term.alias("term")).agg(F.min(canon(C("raw_code"))).alias("code")).withColumn("weight", F.when(F.length("term") % 2 == 0, 2.0).otherwise(0.6))
    hints = x.select(C("id").alias("query_id"), F.when(C("id") % 2 == 0, F.array(F.lit("10"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    return W.expanded_search(as_queries(x, "id", "text"), c, t, hints, terms, brands, c, 5, ["oil"], {"min_score": 0.2})


ONE_TARIFF = f"one as (select hsn_code, min(description) as description, min(category) as category, {R1_TRI('min(description)')} as tb from v_tariff group by 1)"
NEAREST = lambda asked, floor: f"(select query_id, hsn_code, round({SIM('ta', 'tb')}, 9) as score from {asked}, one where {SIM('ta', 'tb')} {floor} {TOP(SIM('ta', 'tb') + ' desc, hsn_code')})"


@query("r17_retry_with_core", "v_text v_tariff", f"""with {ONE_TARIFF}, q as (select id as query_id, {R1_TRI('text')} as ta from v_text), whole as {NEAREST('q', '> 0.2')},
weak as (select id as query_id, coalesce({tokens_sql('text')}[-1], '') as core from v_text where id not in (select query_id from whole where score >= 0.35)), k as (select query_id, {R1_TRI('core')} as ta from weak where core <> ''), again as {NEAREST('k', '> 0.2')}
select query_id, hsn_code, score from (from whole union all from again) {TOP('score desc, hsn_code')}""")  # fmt: skip
def _(x, t):
    return W.retry_with_core(as_queries(x, "id", "text"), tariff_matcher(t, 0.2))


KNOWN = (("blue", "azure", "32041100", 2.0), ("blue", "navy", "32041200", 1.0), ("gear", "cog", "84834000", 1.0), ("steel", "metal", None, 1.5))
KNOWN_ROWS = ", ".join(f"('{t}', '{e}', {'null' if c is None else repr(c)}, {w})" for t, e, c, w in KNOWN)


@query("r19_expansions", "v_text", f"""with a(term, english, code, weight) as (values {KNOWN_ROWS}), g as (select *, row_number() over (partition by term order by weight desc, english) as r from a qualify r <= 4),
q as (select id as query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as l from v_text), w as (select query_id, unnest(range(len(l))) as pos, unnest(l) as word from q),
e as (select query_id, pos, r, english, code from w join g on term = word union all select query_id, pos, 100 + i, s[i + 1], null from (select query_id, pos, coalesce({SYN_SQL}[word], [])[1:3] as s, unnest(range(len(coalesce({SYN_SQL}[word], [])[1:3]))) as i from w)),
f as (select query_id, english, min((pos, r)) as first from e group by 1, 2), h as (select query_id, code, min((pos, r)) as first from e where code is not null group by 1, 2), c as (select query_id, list(code order by first)[1:8] as codes from h group by 1)
select query_id, list(english order by first)[1:12] as expanded, coalesce(any_value(codes), []) as codes from f left join c using (query_id) group by 1""")  # fmt: skip
def _(x):
    return S.expansions(as_queries(x, "id", "text"), x.sparkSession.createDataFrame(list(KNOWN), "term string, english string, code string, weight double"))


SAME = EXACT.replace("row_id as query_id", "id as query_id").replace("upper(query)", "upper(text)").replace("from v_queries", "from v_text")


@query("r20_layered_search", "v_text v_catalog v_tariff", f"""with {SAME}, l1 as (select query_id, {CANON('raw_code')} as hsn_code, 1.0::double as score, 'exact' as layer from exact), {ONE_TARIFF}, near as materialized (select id as query_id, {R1_TRI('text')} as ta from v_text where id not in (select query_id from l1)),
ct as (select id, {CANON('raw_code')} as hsn_code, {R1_TRI('description')} as tb from v_catalog), l2 as materialized (select query_id, hsn_code, round({SIM('ta', 'tb')}, 9) as score, 'catalog' as layer from near, ct where {SIM('ta', 'tb')} >= 0.35 {TOP(SIM('ta', 'tb') + ' desc, id')}),
found as (with {fts_sql('select id as query_id, text from v_text where id not in (select query_id from l1 union all select query_id from l2)', 'or', 1, 'one')}), l3 as (select query_id, hsn_code, score, 'words' as layer from found), open as (select * from near where query_id not in (select query_id from l2 union all select query_id from l3)), l4 as {NEAREST('open', '>= 0.35')}
from l1 union all from l2 union all from l3 union all select *, 'tariff' from l4""")  # fmt: skip
def _(x, c, t):
    return W.layered_search(as_queries(x, "id", "text"), c, t)


EXTRACTED = OPEN_WORDS.replace("query as query_id", "id as query_id").replace("upper(query)", "upper(text)").replace("from v_open9", "from v_text")


@query("r21_match_extracted_keyword", "v_text v_catalog", f"""with {EXTRACTED}, c as (select id, {R1_TRI('description')} as tb from v_catalog), h as (select query_id, id, round({SIM('ta', 'tb')}, 9) as similarity from kw8, c where {SIM('ta', 'tb')} > 0.25 {TOP(SIM('ta', 'tb') + ' desc, id')})
select *, case when similarity >= 0.7 then 82 when similarity >= 0.5 then 75 when similarity >= 0.35 then 68 else 60 end as confidence from h""")  # fmt: skip
def _(x, c):
    return S.match_extracted_keyword(as_queries(x, "id", "text"), c)


WORDS_ALL = """with q as (select id as query_id, list_distinct(list_filter({tok}, lambda w: len(w) >= 3)) as w from v_text), h as (select query_id, id, len(description) as size from q join v_catalog on len(list_filter(w, lambda x: contains(lower(description), x))) = len(w) where len(w) > 0)
select query_id, id, cast(row_number() over (partition by query_id order by size, id) as int) as rank from h qualify rank <= 5""".replace("{tok}", tokens_sql("text"))


@query("j21_match_words", "v_text v_catalog", WORDS_ALL)
def _(x, c):
    return L.match_words(as_queries(x, "id", "text"), c, "all", 5)


#: Distinct words of three letters or more of each text, longest first, of equally long ones in their order.
LONGEST = f"""t as (select distinct id as query_id, list_filter({tokens_sql('text')}, lambda w: len(w) >= 3) as l from v_text), u as (select query_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from t),
q as (select query_id, list_transform(list_sort(list_transform(l, lambda x, i: {{'n': -len(x), 'i': i, 'w': x}})), lambda s: s.w) as w from u where len(l) > 0), c as (select id, lower(description) as d, len(description) as size from v_catalog)"""


@query("j21_match_most_words", "v_text v_catalog", f"""with {LONGEST}, p as (select query_id, w[1:greatest(1, cast(round(len(w) * 0.6) as int))] as w from q where len(w) >= 2), h as (select query_id, id, size from p join c on len(list_filter(w, lambda x: contains(d, x))) = len(w))
select query_id, id, cast(row_number() over (partition by query_id order by size, id) as int) as rank from h qualify rank <= 5""")  # fmt: skip
def _(x, c):
    return L.match_words(as_queries(x, "id", "text"), c, "most", 5)


@query("j21_match_one_word", "v_text v_catalog", f"""with {LONGEST}, s as (select query_id, list_concat(w[1:1], list_filter(list_filter(coalesce({SYN_SQL}[w[1]], []), lambda y: len(y) >= 3 and not contains(y, ' ')), lambda y: y <> w[1])[1:3]) as o from q),
e as (select query_id, unnest(range(len(o))) as place, unnest(o) as word from s), h as (select query_id, place, id, size from e join c on contains(d, word)), b as (select * from h qualify place = min(place) over (partition by query_id))
select query_id, id, cast(row_number() over (partition by query_id order by size, id) as int) as rank from b qualify rank <= 5""")  # fmt: skip
def _(x, c):
    return L.match_words(as_queries(x, "id", "text"), c, "one", 5)


@query("j23_match_brand_type", "v_text v_catalog")
def _(x, c):
    return S.match_brand_type(as_queries(x, "id", "text"), c)


@query("w8_match_regional", "v_text v_alias v_catalog")
def _(x, a, c):
    terms = x.sparkSession.createDataFrame([("vellam", "jaggery", 2.0), ("podi", "powder", 1.0)], "term string, english string, weight double")
    foods = x.sparkSession.createDataFrame(list(FOOD), "hint string, words string")
    return W.match_regional(as_queries(x, "id", "text"), a, terms, c, ["blue"], foods)


W14_SQL = f"""d as materialized (select id, {CANON('raw_code')} as hsn_code, (id % 4) / 100.0::double as bonus, {KEY('description')} as dk, {NO_SIZE('description')} as db, list_distinct({tokens_sql('description')}) as d, description from v_catalog),
x as materialized (select id as query_id, {CANON('text')} as code, {KEY('text')} as qk, {NO_SIZE('text')} as qb, list_distinct({tokens_sql('text')}) as q, coalesce({tokens_sql('text')}[-1], '') as core from v_asked14),
settled as materialized (select query_id, hsn_code, 1.0::double as score from x join (select distinct hsn_code from d) on hsn_code = code where code <> '' union all select query_id, hsn_code, 0.82 + max(bonus) from x join d on qk = dk group by 1, 2 union all select query_id, hsn_code, 0.76 + max(bonus) from x join d on qb = db group by 1, 2),
l as (select * from x where query_id not in (select query_id from settled)), r as (select *, len(list_intersect(q, d)) / len(q) * 0.68 + len(list_intersect(q, d)) / len(d) * 0.20 + case when list_contains(d, core) then 0.10 else 0.0 end + bonus as raw from l, d where len(list_intersect(q, d)) > 0),
s as (select query_id, hsn_code, round(least(1.0, case when qk = dk then greatest(raw, 0.95) when contains(dk, qk) or contains(qk, dk) then greatest(raw, 0.80) else raw end), 9)::double as score from r), g as (select query_id, hsn_code, max(score) as score, count(*) as support from s group by 1, 2),
w as (select query_id, hsn_code, score from g qualify row_number() over (partition by query_id order by score desc, support desc, hsn_code) <= 5)"""
W14_BEST = "select query_id, hsn_code, score, cast(row_number() over (partition by query_id order by score desc, hsn_code) as int) as rank from (select query_id, hsn_code, round(max(score), 9)::double as score from ({}) group by 1, 2) qualify rank <= 5"
ASKED14 = "v_asked14 as (select id, case id % 10 when 0 then text when 1 then text when 2 then description when 3 then coalesce(raw_code, '') else description || ' ' || (id % 90) || ' ML' end as text from v_text join v_catalog using (id))"


def asked14(x, c):
    return x.join(c.select("id", "description", "raw_code"), "id").selectExpr("id as query_id", "case id % 10 when 0 then text when 1 then text when 2 then description when 3 then coalesce(raw_code, '') else description || ' ' || (id % 90) || ' ML' end as text")


def dataset14(c):
    return c.select("id", canon(C("raw_code")).alias("hsn_code"), "description", (C("id") % 4 / 100.0).alias("bonus"))


@query("w14_hybrid_cascade", "v_text v_catalog", f"with {ASKED14}, {W14_SQL} {W14_BEST.format('from settled union all from w')}")
def _(x, c):
    return W.hybrid_cascade(asked14(x, c), dataset14(c), 5)


@query("w14_hybrid_vectors", "v_text v_catalog embeddings")
def _(x, c, e):
    # texts and catalog rows have the vectors of their ids; every text that no exact step settles asks all of them
    def near(q):
        asked = e.select(C("vec_id").alias("query_id"), C("embedding").alias("vector")).join(q, "query_id", "left_semi")
        return S.vector_topk(asked, e.select("vec_id", C("embedding").alias("vector")), 10).select("query_id", C("vec_id").alias("id"), "score")

    return W.hybrid_cascade(asked14(x, c), dataset14(c), 5, near)


@query("w5_predict_catalog", "v_queries v_catalog v_alias v_tariff")
def _(q, c, a, t):
    terms = c.sparkSession.createDataFrame([("promo", "gear", 2.0), ("small", "little", 1.0)], "term string, english string, weight double")
    return W.predict_catalog(asked(q, t), refs(c, a, t, None) | {"terms": terms})


@query("w7_match_catalog_v3", "v_text v_catalog v_tariff v_alias")
def _(x, c, t, a):
    return W.match_catalog_v3(as_queries(x, "id", "text"), c, t, a, rule_table(c.sparkSession))
