"""Master building, corrections and audits over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, text
from dutymark.operators import master as M
from dutymark.operators import similarity as S
from dutymark.queries.lookups import CANON, CHAPTER, DIG, KEY, PREFIXES, RULE_ROWS, rule_table
from dutymark.queries.scalars import NO_SIZE, R1_TRI, SLABS
from dutymark.queries.similarity import SIM
from dutymark.registry import query

C = F.col
canon = codes.canonicalize_hsn
SLAB = lambda x: f"coalesce(len(list_filter({SLABS}, lambda s: abs({x} - s) < 0.01)) > 0, false)"
NUM = r"try_cast(nullif(regexp_extract(gst_raw, '(\d+(?:\.\d+)?)', 1), '') as double)"
EVID = f"select id as ord, raw_code as raw_hsn_code, {CANON('raw_code')} as hsn_code, description, {NUM} as gst_rate from v_catalog"
OFFI = "select cast('0x' || substr(md5(hsn_code || description), 1, 12) as bigint) as ord, case cast(hsn_code[1:2] as int) % 4 when 0 then hsn_code when 1 then hsn_code[1:6] when 2 then hsn_code[1:4] else hsn_code[1:2] end as raw_hsn_code, hsn_code, description, case when len(description) % 3 = 0 then null else gst_rate end as gst_rate from v_tariff"


def evidence(c):
    return c.select(C("id").alias("ord"), C("raw_code").alias("raw_hsn_code"), canon(C("raw_code")).alias("hsn_code"), "description", codes.parse_rate(C("gst_raw")).alias("gst_rate"))


def official(t):
    part = F.expr("case cast(substring(hsn_code, 1, 2) as int) % 4 when 0 then hsn_code when 1 then substring(hsn_code, 1, 6) when 2 then substring(hsn_code, 1, 4) else substring(hsn_code, 1, 2) end")
    # a hash stands for the line numbers of an official file, which a real reader supplies
    order = F.conv(F.substring(F.md5(F.concat("hsn_code", "description").cast("binary")), 1, 12), 16, 10)
    return t.select(order.cast("long").alias("ord"), part.alias("raw_hsn_code"), "hsn_code", "description", F.when(F.length("description") % 3 != 0, C("gst_rate")).alias("gst_rate"))


VOTES = f"ev as ({EVID}), vo as (select hsn_code, gst_rate, count(*) as votes, min(ord) as ord from ev where gst_rate is not null group by 1, 2), vr as (select * from (select *, count(*) over (partition by hsn_code) as kinds, row_number() over (partition by hsn_code order by votes desc, ord) as n from vo) where n = 1 and (votes >= 2 or kinds = 1))"


@query("a1_majority_rate", "v_catalog", f"with {VOTES} select hsn_code, gst_rate from vr")
def _(c):
    return M.majority_rate(evidence(c))


@query("a2_build_master", "v_tariff v_catalog", f"""with {VOTES}, ofc as ({OFFI}), al as (select hsn_code, cast(least(max(len(raw_hsn_code)), 8) as int) as significance from (select hsn_code, raw_hsn_code from ofc union all select hsn_code, raw_hsn_code from ev) where hsn_code <> '' group by 1),
tx as (select raw_hsn_code as p, description as d from ofc qualify row_number() over (partition by raw_hsn_code order by len(description) desc, ord) = 1), rt as (select hsn_code, gst_rate from ofc where gst_rate is not null qualify row_number() over (partition by hsn_code order by ord) = 1)
select a.hsn_code, significance, (select arg_max(d, len(p)) from tx where starts_with(a.hsn_code, p) and len(p) <= significance) as description, h.d as heading_text, coalesce(rt.gst_rate, vr.gst_rate, {CHAPTER('a.hsn_code')}) as gst_rate,
case when rt.gst_rate is not null then 'official' when vr.gst_rate is not null then 'vote' when {CHAPTER('a.hsn_code')} is not null then 'chapter' end as rate_from from al a left join tx h on h.p = a.hsn_code[1:4] left join rt on rt.hsn_code = a.hsn_code left join vr on vr.hsn_code = a.hsn_code""")  # fmt: skip
def _(t, c):
    return M.build_master(official(t), evidence(c))


MARKED = "case id % 4 when 0 then description || ' branded' when 1 then description || ' commercial use' else description end"


@query("a3_choose_official", "v_catalog", f"""with o as (select id as ord, {CANON('raw_code')} as hsn_code, {MARKED} as description, case id % 3 when 0 then 18.0 else 5.0 end::double as gst_rate from v_catalog)
select * from o qualify row_number() over (partition by hsn_code order by contains(lower(description), 'commercial use'), case when gst_rate > 0 and gst_rate <= 5 and contains(lower(description), 'branded') then 0 else 1 end, ord) = 1""")  # fmt: skip
def _(c):
    return M.choose_official(c.select(C("id").alias("ord"), canon(C("raw_code")).alias("hsn_code"), F.expr(MARKED).alias("description"), F.expr("case id % 3 when 0 then 18.0D else 5.0D end").alias("gst_rate")))


@query("a4_build_release", "v_codes v_tariff", f"""with p as ({PREFIXES}), r as (select coalesce(code, '') as hsn_code, name as description, id as ord, case id % 2 when 0 then cast(rate as double) end as raw_rate from v_codes), l as (select hsn_code, min(gst_rate) as legacy from v_tariff group by 1),
o as (select hsn_code, description, raw_rate from r where regexp_full_match(hsn_code, '[0-9]{{8}}') and not starts_with(hsn_code, '99') qualify row_number() over (partition by hsn_code order by len(description) desc, ord) = 1),
x as (select o.hsn_code, description, coalesce(raw_rate, legacy, (select max(rate) from p where starts_with(o.hsn_code, p.prefix)), {CHAPTER('o.hsn_code')}) as rate from o left join l on l.hsn_code = o.hsn_code)
select hsn_code, description, case when {SLAB('rate')} then rate end as gst_rate, rate is not null and not {SLAB('rate')} as bad_rate from x""")  # fmt: skip
def _(c, t):
    raw = c.select(F.coalesce("code", F.lit("")).alias("hsn_code"), C("name").alias("description"), C("id").alias("ord"), F.when(C("id") % 2 == 0, C("rate").cast("double")).alias("gst_rate"))
    sizes = t.select("hsn_code", F.explode(F.array(*[F.lit(n) for n in (2, 4, 6, 8)])).alias("n")).filter(F.substring("hsn_code", 1, 4).cast("int") % C("n") < 2)
    p = sizes.select(F.expr("substring(hsn_code, 1, n)").alias("prefix"), C("n").cast("double").alias("rate")).distinct()
    return M.build_release(raw, t.groupBy("hsn_code").agg(F.min("gst_rate").alias("gst_rate")), p)


@query("a5_dedupe_dataset", "v_catalog", f"""with d as (select id, {CANON('raw_code')} as hsn_code, {KEY('description')} as key, {NUM} as gst_rate, nullif(category, 'Other_Unclassified') as category, cast(id % 3 as int) as source_rank from v_catalog)
select hsn_code, key, id, source_rank, first_value(gst_rate ignore nulls) over w as gst_rate, first_value(category ignore nulls) over w as category from d window w as (partition by hsn_code, key order by source_rank desc, id rows between unbounded preceding and unbounded following) qualify row_number() over (partition by hsn_code, key order by source_rank desc, id) = 1""")  # fmt: skip
def _(c):
    d = c.select("id", canon(C("raw_code")).alias("hsn_code"), "description", codes.parse_rate(C("gst_raw")).alias("gst_rate"), F.expr("nullif(category, 'Other_Unclassified')").alias("category"), (C("id") % 3).cast("int").alias("source_rank"))
    return M.dedupe_dataset(d).drop("description")


@query("a6_attach_aliases", "v_catalog", f"""with d as (select distinct lpad(cast(1 + id % 40 as varchar), 2, '0') as hsn_code, {KEY('description')} as key from v_catalog)
select d.hsn_code, d.key, list_filter((select list(key order by key)[1:13] from d e where e.hsn_code = d.hsn_code), lambda x: x <> d.key)[1:12] as aliases from d""")  # fmt: skip
def _(c):
    return M.attach_aliases(c.select(F.lpad((1 + C("id") % 40).cast("string"), 2, "0").alias("hsn_code"), text.text_key(C("description")).alias("key")).distinct())


HITS = f"select id % 300 as query_id, substr({CANON('raw_code')}, 1, 2) as hsn_code, description, id, (id % 16) / 16.0::double as score from v_catalog"


def hits(c):
    return c.select((C("id") % 300).alias("query_id"), F.substring(canon(C("raw_code")), 1, 2).alias("hsn_code"), "description", "id", (C("id") % 16 / 16.0).alias("score"))


@query("a7_majority_code", "v_catalog", f"""with h as ({HITS}), n as (select query_id, hsn_code, count(*) as n, min(len(description)) as l from h group by 1, 2), r as (select *, row_number() over (partition by query_id order by n desc, l, hsn_code) as r from n)
select query_id, max(case when r = 1 then hsn_code end) as hsn_code, max(case when r = 1 then n end) as n, round(0.7 + least(0.02 * max(case when r = 1 then n end), 0.08), 4)::double as confidence, coalesce(list(hsn_code order by r) filter (r between 2 and 4), []) as alternates from r group by 1""")  # fmt: skip
def _(c):
    return M.majority_code(hits(c), 0.7)


@query("a8_rank_grouped", "v_catalog", f"""with h as ({HITS}), g as (select query_id, hsn_code, arg_max(id, (score, -id)) as id, max(score) as score, count(*) as support, round(avg(score), 9) as mean from h group by 1, 2)
select *, cast(row_number() over (partition by query_id order by score desc, support desc, mean desc, hsn_code) as int) as rank from g qualify rank <= 3""")  # fmt: skip
def _(c):
    return M.rank_grouped(hits(c), 3)


@query("a9_dataset_version", "v_catalog", f"""with d as (select {CANON('raw_code')} as hsn_code, {KEY('description')} as key, cast(id % 3 as varchar) as source from v_catalog),
v as (select count(*) || '-' || sum(cast(cast('0x' || substr(md5(coalesce(hsn_code, '?') || '|' || coalesce(key, '?') || '|' || coalesce(source, '?')), 1, 15) as bigint) as hugeint)) as version from d)
select version, source, count(*) as n from d, v group by 1, 2""")  # fmt: skip
def _(c):
    return M.dataset_version(c.select(canon(C("raw_code")).alias("hsn_code"), text.text_key(C("description")).alias("key"), (C("id") % 3).cast("string").alias("source")))


CORPUS = """select id as ord, case id % 5 when 0 then 'ml' when 1 then 'ml-roman' when 2 then 'hi' when 3 then 'en' else 'xx' end as language, case id % 17 when 0 then ' ' else lower(split_part(description, ' ', cast(1 + id % 2 as int))) || case when id % 3 = 0 then ' ' || lower(brand) else '' end end as term,
case id % 4 when 0 then null when 1 then raw_code else raw_code || '1' end as hsn_code, case id % 6 when 0 then null else upper(brand) end as english, cast(id % 90 as int) as priority, id % 9 = 0 as ambiguous, case id % 8 when 0 then 'seen' end as notes, cast(id % 7 as double) as weight from v_catalog"""


def corpus(c):
    return c.selectExpr(*[
        "id as ord", "case id % 5 when 0 then 'ml' when 1 then 'ml-roman' when 2 then 'hi' when 3 then 'en' else 'xx' end as language", "case id % 17 when 0 then ' ' else lower(split_part(description, ' ', cast(1 + id % 2 as int))) || case when id % 3 = 0 then ' ' || lower(brand) else '' end end as term",
        "case id % 4 when 0 then null when 1 then raw_code else raw_code || '1' end as hsn_code", "case id % 6 when 0 then null else upper(brand) end as english", "cast(id % 90 as int) as priority", "id % 9 = 0 as ambiguous", "case id % 8 when 0 then 'seen' end as notes", "cast(id % 7 as double) as weight",
    ])


@query("a10_merge_corpus", "v_catalog", f"""with c as ({CORPUS}), b as (select *, ord % 2 as o from c) select * exclude (o) from b qualify row_number() over (partition by language, term order by ambiguous desc, case when ambiguous then priority else -priority end, o desc, ord desc) = 1""")
def _(c):
    x = corpus(c)
    return M.merge_corpus(x.filter("ord % 2 = 0"), x.filter("ord % 2 = 1"))


@query("a11_validate_corpus", "v_catalog", f"""with c as ({CORPUS}) select *, case when trim(coalesce(term, '')) = '' then 'missing term' when language not in ('ml', 'ml-roman', 'hi', 'en') then 'unknown language' when hsn_code is not null and not regexp_full_match(hsn_code, '[0-9]{{4}}|[0-9]{{6}}|[0-9]{{8}}') then 'bad code' when not weight > 0 then 'bad weight'
when row_number() over (partition by language, term order by ord) > 1 then 'duplicate key' end as reason from c""")  # fmt: skip
def _(c):
    return M.validate_corpus(corpus(c))


@query("a12_dedupe_last", "v_catalog", f"with c as ({CORPUS}) select * from c qualify row_number() over (partition by language, term, hsn_code order by ord desc) = 1")
def _(c):
    return M.dedupe_last(corpus(c), ["language", "term", "hsn_code"], "ord")


@query("a13_ambiguous_terms", "v_catalog", f"with c as ({CORPUS}) select term, min(priority) as lowest, max(priority) as highest, bool_or(coalesce(notes <> '', false)) as noted from c group by 1 having not contains(term, ' ') and (min(priority) < 50 or bool_or(coalesce(notes <> '', false)) or min(priority) < max(priority))")
def _(c):
    return M.ambiguous_terms(corpus(c))


@query("a14_derive_maps", "v_catalog", f"""with c as ({CORPUS}), o(kind, term, value) as (values ('alias', 'blue', '999'), ('joined', 'x', 'y')), d as (select 'joined' as kind, replace(term, ' ', '') as term, term as value from c where contains(term, ' ') union all select 'translit', term, english from c where english is not null and language <> 'en' union all select 'alias', term, hsn_code from c where hsn_code is not null
union all select 'food', term, lower(english) || '|' || case when len(hsn_code) in (4, 6, 8) then hsn_code else '' end from c where term <> ' ' and not contains(term, ' ') and english is not null and term not in (select term from c where ambiguous and ord % 360 = 0)),
m as (select kind, term, min(value) as value from d group by 1, 2), n as (from m union all select 'rate', term, case when value[1:2] in ('19', '21') then '18%' when value[1:2] = '20' then '12%' else '5%' end from m where kind = 'alias' and len(value) in (4, 6, 8))
select kind, term, value from n where (kind, term) not in (select (kind, term) from o) union all select * from o""")  # fmt: skip
def _(c):
    x = corpus(c)
    return M.derive_maps(x, c.sparkSession.createDataFrame([("alias", "blue", "999"), ("joined", "x", "y")], "kind string, term string, value string"), x.filter("ambiguous and ord % 360 = 0"))


@query("a15_merge_curated", "v_alias v_catalog", f"""with d as (select lower(split_part(description, ' ', 1) || ' ' || split_part(description, ' ', 2)) as term, min({CANON('raw_code')}[1:6]) as value from v_catalog where id % 2 = 0 group by 1), c as (select alias as term, code as value from v_alias where cast(code[1:2] as int) < 60)
select coalesce(c.term, d.term) as term, coalesce(c.value, d.value) as value, coalesce(c.value <> d.value, false) as conflict from c full join d on c.term = d.term""")  # fmt: skip
def _(a, c):
    derived = c.filter("id % 2 = 0").groupBy(F.lower(F.substring_index("description", " ", 2)).alias("term")).agg(F.min(F.substring(canon(C("raw_code")), 1, 6)).alias("value"))
    return M.merge_curated(a.filter("cast(substring(code, 1, 2) as int) < 60").select(C("alias").alias("term"), C("code").alias("value")), derived)


@query("a16_seed_brands", "v_catalog", """with m as (select distinct description as name, split_part(description, ' ', 1) as brand from v_catalog), n as (select brand, count(*) as n from m group by 1), r as (select name, brand, row_number() over (partition by brand order by len(name), name) as r, n from m join n using (brand) where n >= 2)
select brand, n, max(case when r = floor(n / 2) + 1 then name end) as representative, list(name order by name) filter (r <= 50) as products from r group by 1, 2""")  # fmt: skip
def _(c):
    return M.seed_brands(c.select(C("description").alias("name")))


@query("a16_learn_brands", "v_catalog v_tariff", f"""with m as (select distinct description as name, split_part(description, ' ', 1) as brand from v_catalog), n as (select brand, count(*) as n from m group by 1), r as (select name, brand, row_number() over (partition by brand order by len(name), name) as r, n from m join n using (brand) where n >= 2),
g as (select brand, n, max(case when r = floor(n / 2) + 1 then name end) as representative, list(name order by name) filter (r <= 50) as products from r group by 1, 2), q as (select *, {R1_TRI('representative')} as ta from g), t as (select hsn_code, {R1_TRI('min(description)')} as tb from v_tariff group by 1),
b as (select brand, hsn_code, cast(round(round({SIM('ta', 'tb')}, 9) * 100) as int) as confidence, n, representative, products from q, t where {SIM('ta', 'tb')} > 0.3 qualify row_number() over (partition by brand order by {SIM('ta', 'tb')} desc, hsn_code) = 1) from b where confidence >= 40""")  # fmt: skip
def _(c, t):
    one = t.groupBy(C("hsn_code").alias("id")).agg(F.min("description").alias("description"))
    classify = lambda q: S.trgm_topk(q, one, 0.3, 1).select("query_id", C("id").alias("hsn_code"), F.round(C("similarity") * 100).cast("int").alias("confidence"))
    return M.learn_brands(c.select(C("description").alias("name")), classify, floor=40)


RESULTS = "select id, case id % 5 when 0 then null when 1 then '99999999' else code end as hsn_code, cast(rate as double) as gst_rate, cast(id % 100 as int) as confidence, id % 7 = 0 as review, case id % 3 when 0 then 'exact' when 1 then 'alias' else 'fuzzy' end as layer from v_codes"


def results(c):
    return c.selectExpr("id", "case id % 5 when 0 then null when 1 then '99999999' else code end as hsn_code", "cast(rate as double) as gst_rate", "cast(id % 100 as int) as confidence", "id % 7 = 0 as review", "case id % 3 when 0 then 'exact' when 1 then 'alias' else 'fuzzy' end as layer")


REASON = "case when hsn_code is null then 'no code' when hsn_code in ('', '99999999', '00000000') then 'placeholder' when gst_rate is null then 'no rate' when review then 'review' when confidence < 70 then 'low confidence' end"


@query("a17_split_hits", "v_codes", f"with r as ({RESULTS}) select *, {REASON} as reason, {REASON} is null as hit from r")
def _(c):
    return M.split_hits(results(c))


@query("u1_upsert_catalog", "v_catalog", f"""with o as (select {KEY('description')} as key, min(raw_code) as code, min(gst_raw) as rate, min(brand) as brand from v_catalog where id % 3 <> 0 group by 1), n as (select {KEY('description')} as key, max(raw_code) as code, max(gst_raw) as rate, max(case when id % 2 = 0 then brand end) as brand from v_catalog where id % 4 = 0 group by 1)
select coalesce(o.key, n.key) as key, case when n.key is not null then n.code else o.code end as code, case when n.key is not null then n.rate else o.rate end as rate, coalesce(n.brand, o.brand) as brand from o full join n on o.key = n.key""")  # fmt: skip
def _(c):
    k = text.text_key(C("description")).alias("key")
    old = c.filter("id % 3 <> 0").groupBy(k).agg(F.min("raw_code").alias("code"), F.min("gst_raw").alias("rate"), F.min("brand").alias("brand"))
    new = c.filter("id % 4 = 0").groupBy(k).agg(F.max("raw_code").alias("code"), F.max("gst_raw").alias("rate"), F.max(F.when(C("id") % 2 == 0, C("brand"))).alias("brand"))
    return M.upsert(old, new, ["key"], {"code": "replace", "rate": "replace"})


@query("u2_sync_tariff", "v_tariff", """with o as (select hsn_code, min(description) as description, min(gst_rate) as gst_rate from v_tariff where cast(hsn_code[3:4] as int) % 4 <> 0 group by 1), n as (select hsn_code, max(description) as description, min(gst_rate) as gst_rate from v_tariff where cast(hsn_code[3:4] as int) % 3 <> 0 group by 1)
select coalesce(n.hsn_code, o.hsn_code) as hsn_code, case when n.hsn_code is null then o.description else n.description end as description, case when n.hsn_code is null then o.gst_rate else n.gst_rate end as gst_rate,
case when o.hsn_code is null then 'added' when n.hsn_code is null then 'deleted' when o.description = n.description and o.gst_rate = n.gst_rate then 'same' else 'updated' end as action from o full join n on o.hsn_code = n.hsn_code""")  # fmt: skip
def _(t):
    k = F.substring("hsn_code", 3, 2).cast("int")
    old = t.filter(k % 4 != 0).groupBy("hsn_code").agg(F.min("description").alias("description"), F.min("gst_rate").alias("gst_rate"))
    new = t.filter(k % 3 != 0).groupBy("hsn_code").agg(F.max("description").alias("description"), F.min("gst_rate").alias("gst_rate"))
    return M.sync(old, new, "hsn_code", ["description", "gst_rate"])


@query("u3_upsert_aliases", "v_alias v_catalog", """with o as (select alias as term, 'en' as language, case when len(alias) % 2 = 0 then upper(alias) end as english, cast(len(alias) as double) as weight, len(alias) % 3 = 0 as is_active from v_alias where len(alias) > 8),
n as (select alias as term, 'en' as language, case when len(alias) % 5 = 0 then 'NEW' end as english, 10.0::double as weight, true as is_active from v_alias where len(alias) < 10)
select coalesce(o.term, n.term) as term, 'en' as language, coalesce(n.english, o.english) as english, greatest(o.weight, n.weight) as weight, coalesce(n.term is not null or null, o.is_active, case when n.term is not null then true else o.is_active end) as is_active from o full join n on o.term = n.term""")  # fmt: skip
def _(a, _c):
    base = a.select(C("alias").alias("term"), F.lit("en").alias("language"))
    size = F.length("term")
    old = base.filter("length(term) > 8").select("*", F.when(size % 2 == 0, F.upper("term")).alias("english"), size.cast("double").alias("weight"), (size % 3 == 0).alias("is_active"))
    new = base.filter("length(term) < 10").select("*", F.when(size % 5 == 0, "NEW").alias("english"), F.lit(10.0).alias("weight"), F.lit(True).alias("is_active"))
    return M.upsert(old, new, ["term", "language"], {"weight": "greatest", "is_active": "true"})


@query("u4_upsert_brands", "v_catalog", f"""with o as (select distinct brand, {CANON('raw_code')} as code, false as is_active from v_catalog where id % 2 = 0), n as (select distinct brand, {CANON('raw_code')} as code from v_catalog where id % 3 = 0)
select coalesce(o.brand, n.brand) as brand, coalesce(o.code, n.code) as code, n.brand is not null as is_active from o full join n on o.brand = n.brand and o.code = n.code""")  # fmt: skip
def _(c):
    pair = c.select("id", "brand", canon(C("raw_code")).alias("code"))
    old = pair.filter("id % 2 = 0").select("brand", "code").distinct().withColumn("is_active", F.lit(False))
    return M.upsert(old, pair.filter("id % 3 = 0").select("brand", "code").distinct().withColumn("is_active", F.lit(True)), ["brand", "code"], {"is_active": "true"})


@query("u5_insert_absent", "v_catalog", f"""with o as (select distinct {CANON('raw_code')} as code, 'old' as origin from v_catalog where id % 2 = 0), n as (select distinct {CANON('raw_code')} as code, 'new' as origin from v_catalog where id % 5 = 0) select * from o union all select * from n where code not in (select code from o)""")
def _(c):
    pick = lambda cond, name: c.filter(cond).select(canon(C("raw_code")).alias("code")).distinct().withColumn("origin", F.lit(name))
    return M.insert_absent(pick("id % 2 = 0", "old"), pick("id % 5 = 0", "new"), ["code"])


@query("u6_patch_descriptions", "v_catalog v_tariff", f"""with d as (select id, {CANON('raw_code')} as hsn_code, case id % 4 when 0 then ' ' when 1 then 'Description not available' when 2 then null else description end as description from v_catalog), p8 as (select hsn_code, min(description) as d from v_tariff group by 1), p6 as (select hsn_code[1:6] as c, max(description) as d from v_tariff group by 1)
select id, d.hsn_code, case when coalesce(trim(description), '') in ('', 'Description not available') then coalesce(p8.d, p6.d, description) else description end as description from d left join p8 on p8.hsn_code = d.hsn_code left join p6 on p6.c = d.hsn_code[1:6]""")  # fmt: skip
def _(c, t):
    d = c.select("id", canon(C("raw_code")).alias("hsn_code"), F.expr("case id % 4 when 0 then ' ' when 1 then 'Description not available' when 2 then null else description end").alias("description"))
    patch = t.groupBy(C("hsn_code").alias("code")).agg(F.min("description").alias("description")).union(t.groupBy(F.substring("hsn_code", 1, 6)).agg(F.max("description")))
    return M.patch_descriptions(d, patch)


@query("u7_correct_and_rollback", "v_catalog", f"""with d as (select id, {CANON('raw_code')} as hsn_code from v_catalog) select id, hsn_code as before, case when contains(hsn_code, '1090') then hsn_code[1:4] || '1011' else hsn_code end as after, contains(hsn_code, '1090') as logged, hsn_code as restored from d""")
def _(c):
    d = c.select("id", canon(C("raw_code")).alias("hsn_code"))
    new, log = M.correct(d, F.contains("hsn_code", F.lit("1090")), F.concat(F.substring("hsn_code", 1, 4), F.lit("1011")), "moved")
    restored = M.rollback(new, log)
    out = d.withColumnRenamed("hsn_code", "before").join(new.withColumnRenamed("hsn_code", "after"), "id").join(log.select("id", F.lit(True).alias("logged")), "id", "left").join(restored.withColumnRenamed("hsn_code", "restored"), "id")
    return out.withColumn("logged", F.coalesce("logged", F.lit(False)))


@query("u8_sync_rates", "v_catalog v_tariff", f"""with c as (select id, {CANON('raw_code')} as hsn_code, {NUM} as gst_rate from v_catalog), m as (select hsn_code, min(case cast(hsn_code[1:2] as int) % 5 when 0 then 40.0 else gst_rate end)::double as m from v_tariff group by 1)
select id, c.hsn_code, case when m is not null and {SLAB('m')} and m is distinct from gst_rate then m else gst_rate end as gst_rate, m is not null and {SLAB('m')} and m is distinct from gst_rate as changed from c left join m using (hsn_code)""")  # fmt: skip
def _(c, t):
    m = t.groupBy("hsn_code").agg(F.min(F.when(F.substring("hsn_code", 1, 2).cast("int") % 5 == 0, 40.0).otherwise(C("gst_rate"))).alias("gst_rate"))
    return M.sync_rates(c.select("id", canon(C("raw_code")).alias("hsn_code"), codes.parse_rate(C("gst_raw")).alias("gst_rate")), m)


@query("u9_backfill_no_size", "v_catalog", f"select id, description, case id % 3 when 0 then 'KEPT' else {NO_SIZE('description')} end as no_size from v_catalog")
def _(c):
    return M.backfill_no_size(c.select("id", "description", F.expr("case id % 3 when 0 then 'KEPT' when 1 then '' end").alias("no_size")))


@query("u10_decimal_rate", "v_codes", "select id, cast(coalesce(rate, 0) as decimal(5, 2)) as rate from v_codes")
def _(c):
    return c.select("id", codes.to_decimal_rate(C("rate").cast("double")).alias("rate"))


@query("u11_resolve_reviews", "v_codes", """with q as (select id, name as query, code as best_guess from v_codes), d as (select id, case id % 3 when 0 then 'approved' else 'rejected' end as s, case id % 4 when 0 then '19059090' end as c from v_codes where id % 2 = 0)
select query, coalesce(c, best_guess) as hsn_code from q join d using (id) where s = 'approved' and coalesce(c, best_guess) is not null""")  # fmt: skip
def _(c):
    queue = c.select("id", C("name").alias("query"), C("code").alias("best_guess"), F.lit("pending").alias("status"))
    decided = c.filter("id % 2 = 0").selectExpr("id", "case id % 3 when 0 then 'approved' else 'rejected' end as status", "case id % 4 when 0 then '19059090' end as code")
    return M.resolve_reviews(queue, decided)[1]


@query("u12_set_active", "v_catalog", "select id, case when brand like '%1%' then false else id % 2 = 0 end as is_active from v_catalog")
def _(c):
    return M.set_active(c.select("id", "brand", (C("id") % 2 == 0).alias("is_active")), C("brand").contains("1"), False).drop("brand")


ERRORS = f"list_filter([case when {DIG('code')} = '' then 'empty' end, case when {DIG('code')} <> '' and len({DIG('code')}) not in (2, 4, 6, 8) then 'length' end, case when {DIG('code')} in ('99999999', '00000000') then 'placeholder' end, case when len({DIG('code')}) >= 2 and {DIG('code')}[1:2] = '00' then 'chapter' end"
WARN = "case " + " ".join(f"when {DIG('code')} = '{a[0]}' then 'amended to {a[1]}'" for a in fixed.AMENDMENTS) + " end"


@query("q1_validate_code", "v_codes", f"select id, code, {ERRORS}], lambda x: x is not null) as errors, list_filter([{WARN}], lambda x: x is not null) as warnings from v_codes")
def _(c):
    return M.validate_code(c.select("id", "code"))


NEAR = f"(select min_by(s, (abs(s - cast(rate as double)), s)) from (select unnest({SLABS}) as s))"


@query("q2_validate_pair", "v_codes", f"""with n as (select *, case when rate is not null then {NEAR} end as near from v_codes)
select id, code, cast(rate as double) as rate, {ERRORS}, case when rate is null then 'no rate' when not {SLAB('cast(rate as double)')} then 'slab, closest ' || case when near = floor(near) then cast(cast(near as int) as varchar) else cast(cast(near as double) as varchar) end || '%' end], lambda x: x is not null) as errors,
list_filter([{WARN}, case when {DIG('code')}[1:2] in ('22', '24', '27', '87') then 'cess' end], lambda x: x is not null) as warnings from n""")  # fmt: skip
def _(c):
    return M.validate_pair(c.select("id", "code", C("rate").cast("double").alias("rate")))


@query("q3_validate_release", "v_codes", f"select count(*) as codes, count(*) filter (len({DIG('code')}) <> 8) as not_eight, count(*) filter (starts_with({DIG('code')}, '99') and len({DIG('code')}) not in (4, 6)) as bad_service, count(*) filter (rate is not null and not {SLAB('cast(rate as double)')}) as bad_rate from v_codes")
def _(c):
    return M.validate_release(c.select("code", C("rate").cast("double").alias("rate")))


@query("q4_audit_tariff", "v_codes", f"""with i as (select unnest(list_filter([case when {DIG('code')} = '' then 'empty code' end, case when {DIG('code')} <> '' and len({DIG('code')}) not in (2, 4, 6, 8) then 'odd code' end, case when len(coalesce(name, '')) < 9 then 'short text' end], lambda x: x is not null)) as issue from v_codes
union all select 'duplicate' from v_codes where {DIG('code')} <> '' group by case when len({DIG('code')}) < 8 then lpad({DIG('code')}, 8, '0') else {DIG('code')} end having count(*) > 1) select issue, count(*) as n from i group by 1""")  # fmt: skip
def _(c):
    return M.audit_tariff(c)


CODED = f"select id, description, {CANON('raw_code')} as hsn_code from v_catalog"


@query("q5_chapter_mismatch", "v_catalog", f"with r(rule_no, keyword, chapters) as (values {RULE_ROWS}), c as ({CODED}), h as (select id, hsn_code[1:2] as chapter, min(rule_no) as rule_no, arg_min(chapters, rule_no) as ch from c join r on contains(lower(description), keyword) group by 1, 2) select id, rule_no, chapter from h where not list_contains(ch, chapter)")
def _(c):
    return M.chapter_mismatch(c.select("id", "description", canon(C("raw_code")).alias("hsn_code")), rule_table(c.sparkSession))


@query("q6_chapter_violations", "v_catalog", f"with r(rule_no, keyword, chapters) as (values {RULE_ROWS}), c as ({CODED}) select rule_no, id, hsn_code[1:2] as chapter from c join r on contains(lower(description), keyword) where not list_contains(chapters, hsn_code[1:2])")
def _(c):
    return M.chapter_violations(c.select("id", "description", canon(C("raw_code")).alias("hsn_code")), rule_table(c.sparkSession))


@query("q7_compliance_stats", "v_tariff v_codes v_search_events", f"""with r as ({RESULTS}) select (select count(*) from v_tariff) as tariff_rows, (select count(distinct hsn_code) from v_tariff) as tariff_codes, (select count(*) from r where review) as pending, (select count(*) from r where gst_rate is null) as missing_rate, (select count(*) from v_search_events where confidence >= 70) as confident,
(select round(100.0 * avg(case when {REASON} is null then 1.0 else 0.0 end), 4) from r) as readiness""")  # fmt: skip
def _(t, c, e):
    r = M.split_hits(results(c)).agg(F.count_if("review").alias("pending"), F.count_if(C("gst_rate").isNull()).alias("missing_rate"), F.round(100.0 * F.avg(C("hit").cast("double")), 4).alias("readiness"))
    one = t.agg(F.count(F.lit(1)).alias("tariff_rows"), F.count_distinct("hsn_code").alias("tariff_codes"))
    # each side is one row
    return one.crossJoin(r).crossJoin(e.agg(F.count_if(C("confidence") >= 70).alias("confident")))


@query("q8_chapter_coverage", "v_codes", "with d as (select coalesce(code, '')[1:2] as chapter, rate from v_codes) select chapter, count(*) as total, count(rate) as with_rate, count(*) filter (chapter in ('22', '24', '27', '87')) as with_cess, round(100.0 * count(rate) / count(*), 2) as pct from d group by 1")
def _(c):
    return M.chapter_coverage(c.select(F.coalesce("code", F.lit("")).alias("hsn_code"), C("rate").alias("gst_rate")))


@query("q9_state_report", "v_codes", "select coalesce(code, '')[1:2] as chapter, count(*) as n from v_codes group by 1 order by n desc, chapter limit 20")
def _(c):
    return M.count_by(c.select(F.substring(F.coalesce("code", F.lit("")), 1, 2).alias("chapter")), "chapter").orderBy(F.desc("n"), "chapter").limit(20)


@query("q10_seed_report", "v_catalog", f"with c as ({CORPUS}) select language, count(*) as n, count(*) filter (hsn_code is not null) as coded, count(*) < greatest(410 - 5, 0.9 * 410) as under_seeded from c group by 1")
def _(c):
    return corpus(c).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("hsn_code").alias("coded")).withColumn("under_seeded", C("n") < max(410 - 5, 0.9 * 410))


@query("q11_detection_report", "v_codes", f"with r as ({RESULTS}) select case when hsn_code is null then 'undetected' else layer end as tier, count(*) as n, round(100.0 * count(*) / (select count(*) from r), 4) as percent, round(avg(confidence), 4) as mean_confidence from r group by 1")
def _(c):
    return M.detection_report(results(c))


@query("q12_regional_report", "v_text", """with t as (select id, text, (regexp_matches(text, '[^\\x00-\\x7F]') or contains(lower(text), 'vellam')) as regional, id % 101 as c from v_text) select regional, count(*) as n, count(*) filter (c >= 95) as exact, count(*) filter (c >= 70) as authoritative from t group by 1""")
def _(t):
    regional = ~text.is_plain(C("text")) | F.contains(F.lower("text"), F.lit("vellam"))
    return t.groupBy(regional.alias("regional")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C("id") % 101 >= 95).alias("exact"), F.count_if(C("id") % 101 >= 70).alias("authoritative"))


@query("q13_failure_reasons", "v_codes", f"with r as ({RESULTS}) select {REASON} as reason, count(*) as n from r where {REASON} is not null group by 1")
def _(c):
    return M.count_by(M.split_hits(results(c)).filter("not hit"), "reason")


@query("q14_compare_reports", "v_codes", f"with r as ({RESULTS}), b as (select layer, count(*) as n from r where confidence >= 70 group by 1), a as (select case when layer = 'fuzzy' then 'new' else layer end as layer, count(*) as n from r group by 1) select coalesce(a.layer, b.layer) as layer, b.n as before, a.n as after, coalesce(a.n, 0) - coalesce(b.n, 0) as change from a full join b on a.layer = b.layer")
def _(c):
    r = results(c)
    return M.compare_reports(M.count_by(r.filter("confidence >= 70"), "layer"), M.count_by(r.withColumn("layer", F.expr("case when layer = 'fuzzy' then 'new' else layer end")), "layer"), "layer", "n")


@query("q15_chapter_accuracy", "v_catalog", f"""with c as ({CODED}), e as (select id, hsn_code[1:2] as h, lpad(cast(1 + (id + id % 3) % 97 as varchar), 2, '0') as x from c), k as (select case when h in ('20', '21', '22') then 'food' else h end as h, case when x in ('20', '21', '22') then 'food' else x end as x from e)
select count(*) as compared, count(*) filter (h = x) as right_chapter, round(avg(case when h = x then 1.0 else 0.0 end), 6) as accuracy from k""")  # fmt: skip
def _(c):
    r = c.select(C("id").alias("query_id"), canon(C("raw_code")).alias("hsn_code"))
    e = c.select(C("id").alias("query_id"), F.lpad((1 + (C("id") + C("id") % 3) % 97).cast("string"), 2, "0").alias("chapter"))
    return M.chapter_accuracy(r, e, {"20": "food", "21": "food", "22": "food"})


@query("q17_rate_mismatches", "v_catalog v_tariff", f"with c as (select id, {CANON('raw_code')} as hsn_code, {NUM} as gst_rate from v_catalog), m as (select hsn_code, min(gst_rate) as master_rate from v_tariff group by 1) select * from c join m using (hsn_code) where gst_rate is distinct from master_rate")
def _(c, t):
    return M.rate_mismatches(c.select("id", canon(C("raw_code")).alias("hsn_code"), codes.parse_rate(C("gst_raw")).alias("gst_rate")), t.groupBy("hsn_code").agg(F.min("gst_rate").alias("gst_rate")))


@query("q18_count_by", "orders", "select o_orderstatus, count(*) as n from orders group by 1")
def _(o):
    return M.count_by(o, "o_orderstatus")


@query("q19_top_misses", "v_search_events", "select product_name, count(*) as hits, max(ts) as last_seen from v_search_events group by 1 having count(*) >= 3 order by hits desc, last_seen desc, product_name limit 15")
def _(e):
    g = e.groupBy("product_name").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_seen"))
    return g.filter("hits >= 3").orderBy(F.desc("hits"), F.desc("last_seen"), "product_name").limit(15)


@query("q21_corpus_stats", "v_catalog", f"with c as ({CORPUS}) select language, count(*) as n, count(distinct term) as terms, count(*) filter (ambiguous) as ambiguous from c group by 1")
def _(c):
    return corpus(c).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"), F.count_if("ambiguous").alias("ambiguous"))
