"""Lookup operators over the derived catalog, queries and tariff."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutymark.functions import fixed
from dutymark.operators import lookups as L
from dutymark.operators import similarity as S
from dutymark.queries.scalars import NO_SIZE, R1_TRI, SYN_SQL, chain_sql, listed, squeeze, tokens_sql
from dutymark.registry import query

C = F.col
as_queries = lambda t, key="row_id", text="query": t.select(C(key).alias("query_id"), C(text).alias("text"))
KEY = lambda x: squeeze(chain_sql(f"upper({x})", [("[^A-Z0-9\\s]", " ")]))
DIG = lambda x: f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
CANON = lambda x: f"case when len({DIG(x)}) = 0 then '' when len({DIG(x)}) >= 8 then substr({DIG(x)}, 1, 8) when len({DIG(x)}) in (2, 4, 6) then rpad({DIG(x)}, 8, '0') else lpad({DIG(x)}, 8, '0') end"
CHAPTER = lambda c: f"cast({list(map(float, fixed.CHAPTER_RATES))}[try_cast({c}[1:2] as int)] as double)"


@query("f1_search_tariff", "v_tariff", "select hsn_code, description, gst_rate, category from v_tariff where description ilike '%plate%' and abs(gst_rate - 18) < 0.01 and category ilike '%promo%'")
def _(t):
    return L.search_tariff(t, "plate", 18.0, "promo")


@query("f2_filter_candidates", "v_tariff", "select hsn_code, description, gst_rate, category, score from (select *, len(description) / 64.0 as score from v_tariff) where score >= 0.3 and upper(category) in ('ECONOMY', 'PROMO') and abs(gst_rate - 12) < 0.01")
def _(t):
    return L.filter_candidates(t.withColumn("score", F.length("description") / 64.0), 0.3, ["economy", "Promo"], 12.0)


@query("f4_match_code", "v_codes v_tariff", f"select c.id as query_id, t.* from (select id, {CANON('code')} as hsn from v_codes) c join v_tariff t on c.hsn = t.hsn_code where hsn <> ''")
def _(c, t):
    return L.match_code(as_queries(c, "id", "code"), t)


@query("f5_match_code_prefix", "v_codes v_tariff", f"""with q as (select id as query_id, {DIG('code')} as p from v_codes), o as (select hsn_code, min(description) as description from v_tariff group by 1),
h as (select query_id, hsn_code, description, greatest(0.45, round(1 - 0.05 * (len(hsn_code) - len(p)), 4)) as score from q join o on starts_with(hsn_code, p) where len(p) between 2 and 8)
select query_id, hsn_code, description, cast(score as double) as score, cast(row_number() over (partition by query_id order by score desc, hsn_code) as int) as rank from h qualify rank <= 5""")  # fmt: skip
def _(c, t):
    return L.match_code_prefix(as_queries(c, "id", "code"), t, 5)


@query("f6_match_embedded_code", "v_tariff v_text", """with q as (select id as query_id, regexp_extract(text || ' ' || lpad(cast(1 + id % 97 as varchar), 2, '0') || lpad(cast(1 + id % 50 as varchar), 2, '0') || ' end', '\\b(\\d{4,8})\\b', 1) as p from v_text), o as (select hsn_code, min(description) as d from v_tariff group by 1),
h as (select query_id, hsn_code, cast(row_number() over (partition by query_id order by hsn_code) as int) as rank from q join o on starts_with(hsn_code, p) where p <> '')
select query_id, hsn_code, cast(greatest(0.72, round(0.98 - 0.08 * (rank - 1), 4)) as double) as score, rank from h where rank <= 4""")  # fmt: skip
def _(t, x):
    q = x.selectExpr("id as query_id", "text || ' ' || lpad(cast(1 + id % 97 as string), 2, '0') || lpad(cast(1 + id % 50 as string), 2, '0') || ' end' as text")
    return L.match_embedded_code(q, t, 4)


RULE_ROWS = ", ".join(f"({n}, '{k}', {listed(c)})" for n, k, c in fixed.CATEGORY_RULES)


def rule_table(spark):
    return spark.createDataFrame([(n, k, list(c)) for n, k, c in fixed.CATEGORY_RULES], "rule_no int, keyword string, chapters array<string>")


@query("f7_chapter_hints", "v_catalog", f"""with r(rule_no, keyword, chapters) as (values {RULE_ROWS}), w as (select id as query_id, unnest({tokens_sql('description', True)}) as keyword from v_catalog)
select query_id, min_by(chapters, rule_no) as chapters from w join r using (keyword) group by 1""")  # fmt: skip
def _(t):
    return L.chapter_hints(as_queries(t, "id", "description"), rule_table(t.sparkSession))


DOMAINS = (("gear", ("84", "8483")), ("gizmo", ("85",)), ("small", ("39", "84")), ("azure", ("32",)))
DOMAIN_ROWS = ", ".join(f"('{k}', {listed(p)})" for k, p in DOMAINS)


@query("f7_category_prefixes", "v_text", f"""with r(rule_no, keyword, chapters) as (values {RULE_ROWS}), d(keyword, prefixes) as (values {DOMAIN_ROWS}), t as (select id as query_id, {tokens_sql('text', True)} as l from v_text),
w as (select distinct query_id, unnest(list_concat(l, flatten(list_transform(l, lambda x: coalesce({SYN_SQL}[x], []))))) as keyword from t), a as (select query_id, min_by(chapters, rule_no) as prefixes, true as by_rule from w join r using (keyword) group by 1),
b as (select query_id, flatten(list(prefixes)) as prefixes, false as by_rule from w join d using (keyword) where query_id not in (select query_id from a) group by 1)
select query_id, list_sort(list_distinct(prefixes)) as prefixes, by_rule from (from a union all from b)""")  # fmt: skip
def _(t):
    domains = t.sparkSession.createDataFrame([(k, list(p)) for k, p in DOMAINS], "keyword string, prefixes array<string>")
    return L.category_prefixes(as_queries(t, "id", "text"), rule_table(t.sparkSession), domains)


@query("f8_apply_chapter_hints", "v_catalog v_tariff", f"""with r(rule_no, keyword, chapters) as (values {RULE_ROWS}), w as (select id as query_id, unnest({tokens_sql('description', True)}) as keyword from v_catalog),
h as (select query_id, min_by(chapters, rule_no) as chapters from w join r using (keyword) group by 1), c as (select id as query_id, {CANON('raw_code')} as hsn_code from v_catalog)
select c.query_id, hsn_code from c left join h using (query_id) where chapters is null or list_contains(chapters, hsn_code[1:2])""")  # fmt: skip
def _(t, _tariff):
    from dutymark.functions import codes

    cands = t.select(C("id").alias("query_id"), codes.canonicalize_hsn(C("raw_code")).alias("hsn_code"))
    return L.apply_chapter_hints(cands, L.chapter_hints(as_queries(t, "id", "description"), rule_table(t.sparkSession)))


@query("f9_is_authoritative", "v_codes", "select id, coalesce(regexp_full_match(code, '[0-9]{4}|[0-9]{6}|[0-9]{8}') and code not in ('', '99999999', '00000000') and rate is not null and id % 100 >= 70 and id % 3 <> 0, false) as authoritative from v_codes")
def _(t):
    return t.select("id", L.is_authoritative(C("code"), C("rate"), C("id") % 100, C("id") % 3 == 0).alias("authoritative"))


EXACT = f"""q as (select row_id as query_id, unnest([0, 1]) as priority, unnest([{KEY('query')}, {NO_SIZE('query')}]) as key from v_queries),
c as (select id, raw_code, gst_raw, unnest([0, 1]) as priority, unnest([{KEY('description')}, {NO_SIZE('description')}]) as key from v_catalog),
exact as (select query_id, q.priority, id, raw_code, gst_raw from q join c on q.key = c.key and q.priority = c.priority where q.key <> '' qualify row_number() over (partition by query_id order by q.priority, id) = 1)"""


@query("j1_match_exact", "v_queries v_catalog", f"with {EXACT} select * from exact")
def _(q, c):
    return L.match_exact(as_queries(q), c)


@query("j2_match_keys", "v_queries v_catalog", f"""with q as (select row_id as query_id, unnest([0, 1, 2]) as key_no, unnest([upper({squeeze('query')}), {KEY('query')}, {NO_SIZE('query')}]) as key from v_queries),
c as (select id, raw_code, {NO_SIZE('description')} as key from v_catalog), m as (select key, min(id) as id from c group by 1)
select query_id, key_no, c.id, c.raw_code from q join m using (key) join c on c.id = m.id where q.key <> '' qualify row_number() over (partition by query_id order by key_no, c.id) = 1""")  # fmt: skip
def _(q, c):
    from dutymark.functions import text

    refs = L.first_per(c.select("id", "raw_code", text.strip_sizes(C("description")).alias("k")), "k", "id")
    return L.match_keys(as_queries(q), [text.query_key(C("text")), text.text_key(C("text")), text.strip_sizes(C("text"))], refs, C("k")).drop("k")


PLAIN = squeeze("regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g')")
ALIASES = f"""words as (select distinct row_id as query_id, {PLAIN} as p from v_queries), alias_hits as (select query_id, alias, code, p from words join v_alias on p = alias or starts_with(p, alias || ' ') or (len(alias) >= 4 and contains(' ' || p || ' ', ' ' || alias || ' '))
  qualify row_number() over (partition by query_id order by p = alias desc, len(alias) desc, alias, code) = 1)"""


@query("j3_match_alias", "v_queries v_alias", f"with {ALIASES} select query_id, alias, code from alias_hits")
def _(q, a):
    return L.match_alias(as_queries(q), a)


RATES = f"""rates as (select hsn_code, gst_rate from v_tariff where gst_rate is not null qualify row_number() over (partition by hsn_code order by description) = 1),
heads as (select hsn_code[1:6] as head, gst_rate from rates qualify row_number() over (partition by hsn_code[1:6] order by hsn_code) = 1)"""
RATED = lambda source, key, code: f"(select s.{key}, s.hsn, coalesce(r.gst_rate, h.gst_rate, case when s.hsn <> '' then {CHAPTER('s.hsn')} end) as rate, case when r.gst_rate is not null then 'code' when h.gst_rate is not null then 'head' when s.hsn <> '' and {CHAPTER('s.hsn')} is not null then 'chapter' end as rate_from from (select {key}, {CANON(code)} as hsn from {source}) s left join rates r on r.hsn_code = s.hsn left join heads h on h.head = s.hsn[1:6])"


@query("j4_alias_rate", "v_queries v_alias v_tariff", f"with {ALIASES}, {RATES} select query_id, alias, code, rate, rate_from from alias_hits join {RATED('v_alias', 'alias', 'code')} using (alias)")
def _(q, a, t):
    return L.match_alias(as_queries(q), a).join(L.lookup_rate(a, t, "code").select("alias", "rate", "rate_from"), "alias")


@query("j5_match_brand", "v_catalog", f"""with b as (select distinct brand, case id % 3 when 0 then '997' || cast(id % 5 as varchar) else {CANON('raw_code')} end as code, cast(id % 28 as double) as gst_rate from v_catalog),
q as (select id as query_id, lower(brand) as t from v_catalog), s as (select distinct code as sac_code, 'service ' || code as description, 18.0 as gst_rate from b where len(code) = 4),
h as (select query_id, b.code, case when len(b.code) = 4 then s.description else 'goods ' || b.code end as description, cast(case when len(b.code) = 4 then coalesce(s.gst_rate, b.gst_rate) else b.gst_rate end as double) as rate from q join b on upper(trim(q.t)) = b.brand left join s on s.sac_code = b.code)
select * from h qualify row_number() over (partition by query_id order by rate desc nulls last, code, description) = 1""")  # fmt: skip
def _(c):
    from dutymark.functions import codes

    b = c.select("brand", F.when(C("id") % 3 == 0, F.concat(F.lit("997"), (C("id") % 5).cast("string"))).otherwise(codes.canonicalize_hsn(C("raw_code"))).alias("code"), (C("id") % 28).cast("double").alias("gst_rate")).distinct()
    services = b.filter("length(code) = 4").select(C("code").alias("sac_code")).distinct().select("sac_code", F.concat(F.lit("service "), "sac_code").alias("description"), F.lit(18.0).alias("gst_rate"))
    goods = b.filter("length(code) = 8").select(C("code").alias("hsn_code")).distinct().withColumn("description", F.concat(F.lit("goods "), "hsn_code"))
    return L.match_brand(c.select(C("id").alias("query_id"), F.lower("brand").alias("text")), b, goods, services)


@query("j6_brand_mode", "v_catalog", f"select brand, code, n from (select brand, {CANON('raw_code')} as code, count(*) as n from v_catalog where coalesce(raw_code, '') not in ('', '99999999', '00000000') group by 1, 2) qualify row_number() over (partition by brand order by n desc, code) = 1")
def _(c):
    return L.brand_mode(c)


LANG = f"select {NO_SIZE('description')} as term, min({CANON('raw_code')}) as code, max(1.0 + (id % 10) / 8.0) as weight from v_catalog where id % 3 = 0 group by 1 union all select split_part(description, ' ', 1), min({CANON('raw_code')}), 1.5 from v_catalog where id % 7 = 0 group by 1"


@query("j7_match_language_alias", "v_queries v_catalog", f"""with a as ({LANG}), q as (select row_id as query_id, {NO_SIZE('query')} as n from v_queries), k as (select query_id, unnest([0, 1]) as pos, unnest([coalesce(list_filter(string_split(n, ' '), lambda w: len(w) >= 2 and not list_contains({listed([s.upper() for s in fixed.STOPWORDS])}, w))[1], ''), array_to_string(string_split(n, ' ')[1:2], ' ')]) as term from q)
select query_id, code, least(1.0, weight / 2) as score from k join a using (term) where term <> '' qualify row_number() over (partition by query_id order by pos, weight desc, code) = 1""")  # fmt: skip
def _(q, c):
    from dutymark.functions import codes, text

    code = F.min(codes.canonicalize_hsn(C("raw_code"))).alias("code")
    a = c.filter("id % 3 = 0").groupBy(text.strip_sizes(C("description")).alias("term")).agg(code, F.max(1.0 + (C("id") % 10) / 8.0).alias("weight"))
    b = c.filter("id % 7 = 0").groupBy(F.substring_index("description", " ", 1).alias("term")).agg(code, F.lit(1.5).alias("weight"))
    return L.match_language_alias(as_queries(q), a.unionByName(b))


@query("j8_brand_guard", "v_queries", f"""with q as (select row_id, case row_id % 4 when 0 then 'oil' when 1 then 'vellam podi' when 2 then upper(query) else 'TV set' end as t from v_queries)
select row_id, t as text, (t = 'oil') or t = 'vellam podi' as skip, case when len(coalesce(list_filter(string_split({NO_SIZE('t')}, ' '), lambda w: len(w) >= 2 and not list_contains({listed([s.upper() for s in fixed.STOPWORDS])}, w))[1], '')) < 4 then cast(0.75 as double) else 0.55::double end as floor from q""")  # fmt: skip
def _(q):
    return L.brand_guard(q.selectExpr("row_id", "case row_id % 4 when 0 then 'oil' when 1 then 'vellam podi' when 2 then upper(query) else 'TV set' end as text"), ["oil", "rice", "salt"])


WORDS = (("blue", "08021200", 5), ("anvil", "97060000", 3), ("ring", "33049910", 9), ("blue anvil", "94036000", 1), ("plate", "72107000", 2))
WORD_ROWS = ", ".join(f"('{k}', '{c}', {p})" for k, c, p in WORDS)


@query("j9_match_keyword", "v_queries", f"""with k(keyword, code, priority) as (values {WORD_ROWS})
select row_id as query_id, keyword, code from v_queries join k on contains(upper(query), upper(keyword)) qualify row_number() over (partition by row_id order by len(keyword) desc, priority desc, keyword, code) = 1""")  # fmt: skip
def _(q):
    return L.match_keyword(as_queries(q), q.sparkSession.createDataFrame(list(WORDS), "keyword string, code string, priority int"))


HINTED = ("anvil", "ring", "blue")


@query("j10_match_category_keyword", "v_queries v_catalog", f"""with k as (select unnest({listed(HINTED)}) as keyword), n as (select keyword, {CANON('raw_code')} as code, count(*) as n from v_catalog join k on contains(lower(description), keyword) group by 1, 2), m as (select keyword, code from n qualify row_number() over (partition by keyword order by n desc, code) = 1),
q as (select row_id as query_id, list_filter({listed(HINTED)}, lambda x: contains(lower(query), x))[1] as keyword from v_queries) select query_id, keyword, code from q join m using (keyword)""")  # fmt: skip
def _(q, c):
    return L.match_category_keyword(as_queries(q), c, list(HINTED))


@query("j11_match_prefix", "v_catalog", """with q as (select distinct id as query_id, split_part(description, ' ', 1) as start from v_catalog where id % 100 = 0)
select query_id, id, raw_code, description, cast(row_number() over (partition by query_id order by len(description), id) as int) as rank from q join v_catalog on starts_with(description, start) where len(start) >= 3 qualify rank <= 20""")  # fmt: skip
def _(c):
    return L.match_prefix(c.filter("id % 100 = 0").select(C("id").alias("query_id"), F.substring_index("description", " ", 1).alias("text")), c)


@query("j12_lookup_rate", "v_codes v_tariff", f"with {RATES} select id, rate, rate_from from {RATED('v_codes', 'id', 'code')}")
def _(c, t):
    return L.lookup_rate(c.select("id", "code"), t, "code").select("id", "rate", "rate_from")


PREFIXES = "select distinct hsn_code[1:n] as prefix, cast(n as double) as rate from (select hsn_code, unnest([2, 4, 6, 8]) as n, cast(hsn_code[1:4] as int) as k from v_tariff) where k % n < 2"


@query("j13_longest_prefix_join", "v_codes v_tariff", f"""with p as ({PREFIXES}), c as (select id, {CANON('code')} as hsn_code from v_codes)
select id, hsn_code, rate, cast(rate as int) as prefix_len from c left join lateral (select max(rate) as rate from p where starts_with(c.hsn_code, p.prefix)) on true""")  # fmt: skip
def _(c, t):
    from dutymark.functions import codes

    sizes = t.select("hsn_code", F.explode(F.array(*[F.lit(n) for n in (2, 4, 6, 8)])).alias("n")).filter(F.substring("hsn_code", 1, 4).cast("int") % C("n") < 2)
    p = sizes.select(F.expr("substring(hsn_code, 1, n)").alias("prefix"), C("n").cast("double").alias("rate")).distinct()
    return L.longest_prefix_join(c.select("id", codes.canonicalize_hsn(C("code")).alias("hsn_code")), p)


@query("j14_current_rates", "v_rate_history", "select chapter, effective_from, effective_to, gst_rate from v_rate_history where effective_to is null qualify row_number() over (partition by chapter order by effective_from desc, gst_rate) = 1")
def _(h):
    return L.current_rates(h)


@query("j14_rate_as_of", "v_rate_history lineitem", "select l_orderkey, l_linenumber, gst_rate from (select *, lpad(cast(1 + l_partkey % 97 as varchar), 2, '0') as chapter from lineitem) l join v_rate_history h on l.chapter = h.chapter and l_shipdate >= effective_from and (effective_to is null or l_shipdate < effective_to)")
def _(h, li):
    lines = li.select("l_orderkey", "l_linenumber", "l_shipdate", F.lpad((1 + C("l_partkey") % 97).cast("string"), 2, "0").alias("chapter"))
    return L.rate_as_of(lines, h, "l_shipdate").select("l_orderkey", "l_linenumber", "gst_rate")


AMENDED = "select id, case id % 4 when 0 then '21069099' when 1 then '21069011' when 2 then '04015000' else code end as hsn_code from v_codes"
AMEND_ROWS = ", ".join(f"('{a[0]}', '{a[1]}')" for a in fixed.AMENDMENTS)


@query("j15_apply_amendments", "v_codes", f"with a(o, n) as (values {AMEND_ROWS}), c as ({AMENDED}) select id, hsn_code, coalesce(n, hsn_code) as new_code, n is not null as amended from c left join a on o = hsn_code")
def _(c):
    table = c.sparkSession.createDataFrame(list(fixed.AMENDMENTS), "old string, new string, day string, reference string")
    return L.apply_amendments(c.selectExpr("id", "case id % 4 when 0 then '21069099' when 1 then '21069011' when 2 then '04015000' else code end as hsn_code"), table)


#: Languages of the searches: by the id of a text, by the letters of an alias. Each third text asks with its first word.
LANGUAGE_SQL = "['hi', 'ml', 'en'][1 + {} % 3]"


@query("j16_search_by_language", "v_text v_alias v_tariff", f"""with q as (select id as query_id, {squeeze("lower(case when id % 300 = 0 then split_part(text, ' ', 1) else text end)")} as p, {LANGUAGE_SQL.format('(id // 100)')} as language from v_text where id % 100 = 0), a as (select *, {LANGUAGE_SQL.format('len(alias)')} as language, cast(code[1:2] as int) / 50.0 as weight from v_alias),
t as (select p, {R1_TRI('p')} as ta from q group by p), b as (select alias, {R1_TRI('alias')} as tb from v_alias), m as (select p, alias from t, b where contains(alias, p) or len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) >= 0.3),
f as (select query_id, code, max(weight) as weight from q join m using (p) join a using (alias, language) group by 1, 2), h as (select query_id, hsn_code, max(weight)::double as weight from f join (select distinct hsn_code from v_tariff) t on starts_with(hsn_code, code) group by 1, 2)
select *, cast(row_number() over (partition by query_id order by weight desc, len(hsn_code), hsn_code) as int) as rank from h qualify rank <= 5""")  # fmt: skip
def _(q, a, t):
    of = lambda n: F.element_at(F.array(*map(F.lit, ("hi", "ml", "en"))), (n % 3 + 1).cast("int"))
    said = F.when(C("id") % 300 == 0, F.substring_index("text", " ", 1)).otherwise(C("text"))
    asked = q.filter("id % 100 = 0").select(C("id").alias("query_id"), said.alias("text"), of(F.floor(C("id") / 100)).alias("language"))
    known = a.select("alias", "code", (F.substring("code", 1, 2).cast("int") / 50.0).alias("weight"), of(F.length("alias")).alias("language"))
    return S.search_by_language(asked, known, t, 5)


@query("j19_match_regional_alias", "v_queries v_alias", f"""with q as (select row_id as query_id, {squeeze('lower(query)')} as p from v_queries)
select query_id, alias, code from q join v_alias on starts_with(p, alias) or (len(alias) >= 10 and starts_with(p, alias[1:8])) where p not in ('blue') and len(p) >= 3 and len(alias) >= 3 qualify row_number() over (partition by query_id order by p = alias desc, len(alias) desc, alias) = 1""")  # fmt: skip
def _(q, a):
    return L.match_regional_alias(as_queries(q), a, ["blue"])


FOOD = (("blue", "blue anvil"), ("hot gear", "gear hot"), ("ring", "ring"))
FOOD_ROWS = ", ".join(f"('{h}', '{w}')" for h, w in FOOD)


@query("j20_match_food_hint", "v_queries v_catalog", f"""with h(hint, words) as (values {FOOD_ROWS}), f as (select row_id as query_id, string_split(words, ' ')[1:3] as w from v_queries join h on contains(lower(query), hint) qualify row_number() over (partition by row_id order by len(hint) desc, hint) = 1)
select query_id, id, cast(row_number() over (partition by query_id order by id) as int) as rank from f join v_catalog on len(list_filter(w, lambda x: list_contains(string_split(lower(description), ' '), x))) = len(w) qualify rank <= 3""")  # fmt: skip
def _(q, c):
    return L.match_food_hint(as_queries(q), q.sparkSession.createDataFrame(list(FOOD), "hint string, words string"), c, 3)


@query("j22_token_contains", "v_catalog v_tariff", f"""with w as (select distinct id as query_id, unnest({tokens_sql('description')}) as word from v_catalog where id % 100 = 0), k as (select * from w where len(word) >= 3), n as (select query_id, count(*) as words from k group by 1), t as (select hsn_code, min(lower(description)) as d from v_tariff group by 1),
h as (select query_id, hsn_code, count(*) as n from k join t on contains(d, word) group by 1, 2) select query_id, hsn_code, n / words as coverage from h join n using (query_id)""")  # fmt: skip
def _(c, t):
    return L.token_contains(as_queries(c.filter("id % 100 = 0"), "id", "description"), t.groupBy("hsn_code").agg(F.min("description").alias("description")), "hsn_code")


@query("j24_match_model_code", "v_queries v_catalog", """with c as (select id, unnest(list_distinct(regexp_extract_all(upper(description), '\\b(\\d{2,5}[A-Z])\\b', 1))) as model from v_catalog), q as (select row_id, unnest(list_distinct(regexp_extract_all(upper(query), '\\b(\\d{2,5}[A-Z])\\b', 1))) as model from v_queries), m as (select model, min(id) as id from c group by 1)
select row_id as query_id, min(id) as id from q join m using (model) group by 1""")  # fmt: skip
def _(q, c):
    return L.match_model_code(as_queries(q), c)


@query("j25_stale_codes", "v_codes v_tariff", f"select distinct {CANON('code')} as hsn_code from v_codes where {CANON('code')} like '%00' and {CANON('code')} not in (select hsn_code from v_tariff)")
def _(c, t):
    from dutymark.functions import codes

    return L.stale_codes(c.select(codes.canonicalize_hsn(C("code")).alias("hsn_code")).distinct(), t)


TAXONOMY = (("live", 1, 1, 5), ("plants", 2, 6, 14), ("void", 3, 98, 99), ("metal", 4, 72, 83))
TAX_ROWS = ", ".join(f"('{n}', {o}, {a}, {b})" for n, o, a, b in TAXONOMY)


@query("j26_category_counts", "v_tariff", f"with x(name, display_order, a, b) as (values {TAX_ROWS}) select name, display_order, (select count(distinct hsn_code) from v_tariff where cast(hsn_code[1:2] as int) between a and b) as codes from x")
def _(t):
    return L.category_counts(t.sparkSession.createDataFrame(list(TAXONOMY), "name string, display_order int, first_chapter int, last_chapter int"), t)


