"""Similarity and ranking over the derived tables; oracles compare all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, text
from dutymark.operators import lookups as L
from dutymark.operators import similarity as S
from dutymark.queries.lookups import CANON, DOMAIN_ROWS, DOMAINS, KEY, RULE_ROWS, as_queries, rule_table
from dutymark.queries.scalars import NO_SIZE, R1_TRI, SOUNDS, SYN_SQL, listed, tokens_sql
from dutymark.registry import query

C = F.col
SIM = lambda a, b: f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"
Q = "q as (select id as query_id, text, " + R1_TRI("text") + " as ta from v_text)"
REF = "c as (select id, description, " + R1_TRI("description") + " as tb from v_catalog)"


def topk_sql(min_sim: float, k: int, op: str = ">") -> str:
    return f"select query_id, id, round({SIM('ta', 'tb')}, 9) as similarity, cast(row_number() over (partition by query_id order by {SIM('ta', 'tb')} desc, id) as int) as rank from q, c where {SIM('ta', 'tb')} {op} {min_sim} qualify rank <= {k}"


#: Candidates of the rankings: the most similar catalog rows of the texts whose id is divisible by 100.
FOUND = f"fq as (select * from ({Q.removeprefix('q as (').removesuffix(')')}) where query_id % 100 = 0), {REF.replace('c as (', 'fc as (', 1)}, found as (select query_id, id from fq, fc where {SIM('ta', 'tb')} > 0.3 qualify row_number() over (partition by query_id order by {SIM('ta', 'tb')} desc, id) <= 20)"


def found(q, c):
    asked = as_queries(q.filter("id % 100 = 0"), "id", "text")
    return S.trgm_topk(asked, c, 0.3, 20).select("query_id", "id").join(asked.withColumnRenamed("text", "query"), "query_id")


@query("r2_trgm_topk", "v_text v_catalog", f"with {Q}, {REF} {topk_sql(0.45, 5)}")
def _(q, c):
    return S.trgm_topk(as_queries(q, "id", "text"), c, 0.45, 5)


@query("r2_trgm_topk_loose", "v_text v_tariff", f"with {Q}, c as (select hsn_code as id, min(description) as d, {R1_TRI('min(description)')} as tb from v_tariff group by 1) {topk_sql(0.25, 3, '>=')}")
def _(q, t):
    return S.trgm_topk(as_queries(q, "id", "text"), t.groupBy(C("hsn_code").alias("id")).agg(F.min("description").alias("description")), 0.25, 3, strict=False)


@query("r2b_match_product_name", "v_catalog v_text", f"""with q as (select id as query_id, lower(text) as t, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: len(w) >= 3) as words from v_text), e as (select distinct query_id, words, unnest(list_concat([t], words)) as term from q), m as (select query_id, words, term, {R1_TRI('term')} as ta from e),
u as (select distinct ta, term from m), c as (select lower(description) as b, min(id) as id from v_catalog group by 1), p as (select term, b, id, {SIM('ta', 'tb')} as s from u, (select *, {R1_TRI('b')} as tb from c) where {SIM('ta', 'tb')} > 0.28),
h as (select query_id, id, max(s) as s from m join p using (term) where len(list_intersect(words, string_split_regex(b, '\\s+'))) > 0 group by 1, 2)
select query_id, id, round(s, 9) as similarity from h qualify row_number() over (partition by query_id order by s desc, id) = 1""")  # fmt: skip
def _(c, q):
    return S.match_product_name(as_queries(q, "id", "text"), c)


@query("r3_match_verified", "v_text v_catalog", f"""with q as (select id as query_id, {KEY('text')} as k, {NO_SIZE('text')} as b from v_text), c as (select id, {KEY('description')} as dk, {NO_SIZE('description')} as db from v_catalog),
q2 as (select *, {R1_TRI('k')} as tk, {R1_TRI('b')} as tb from q), c2 as (select *, {R1_TRI('dk')} as uk, {R1_TRI('db')} as ub from c),
s as (select query_id, id, k = dk as same, b = db as bare, {SIM('tk', 'uk')} as s1, {SIM('tb', 'ub')} as s2 from q2, c2),
n1 as (select query_id, id, s1 as score from s where s1 > 0.5 qualify row_number() over (partition by query_id order by s1 desc, id) <= 3), n2 as (select query_id, id, s2 as score from s where s2 > 0.5 qualify row_number() over (partition by query_id order by s2 desc, id) <= 3),
e as (select query_id, id, 1.0::double as score from s where same union all select query_id, id, 0.94::double from s where bare union all select query_id, id, round(score, 9) from n1 union all select query_id, id, round(score, 9) from n2), m as (select query_id, id, max(score) as score from e group by 1, 2)
select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from m qualify rank <= 3""")  # fmt: skip
def _(q, c):
    return S.match_verified(as_queries(q, "id", "text"), c, 3, 0.5)


@query("r4_union_similarity", "v_text v_catalog v_tariff", f"""with {Q}, r as (select 'c' || id as id, description from v_catalog union all select 't' || hsn_code, min(description) from v_tariff group by 1), c as (select id, {R1_TRI('description')} as tb from r) {topk_sql(0.4, 5)}""")
def _(q, c, t):
    return S.union_similarity(as_queries(q, "id", "text"), c, t, 5, 0.4)


SCOPE = "case id % 3 when 0 then 'exact' when 1 then 'heading' else 'chapter' end as scope"


@query("r5_match_curated", "v_text v_catalog", f"""with {Q}, {REF}, t as ({topk_sql(0.38, 50)}), h as (select t.*, id % 3 as scope from t)
select query_id, id, similarity, cast(case when similarity > 0.5 then 80 else greatest(65, floor(similarity * 100)) end as int) as confidence from h qualify row_number() over (partition by query_id order by scope, similarity desc, id) = 1""")  # fmt: skip
def _(q, c):
    return S.match_curated(as_queries(q, "id", "text"), c.selectExpr("id", "description", SCOPE))


@query("r6_match_tariff", "v_text v_tariff v_catalog", f"""with {Q}, o as (select distinct hsn_code, description from v_tariff where description is not null), c as (select hsn_code, {R1_TRI('description')} as tb from o), v as (select {CANON('raw_code')} as hsn_code, count(*) as volume from v_catalog group by 1),
h as (select query_id, hsn_code, coalesce(volume, 0) as volume, max({SIM('ta', 'tb')}) as s from q, c left join v using (hsn_code) where {SIM('ta', 'tb')} > 0.32 group by 1, 2, 3)
select query_id, hsn_code, volume, round(s, 9) as similarity, cast(least(75, greatest(55, floor(s * 100))) as int) as confidence, cast(row_number() over (partition by query_id order by volume desc, s desc, hsn_code) as int) as rank from h qualify rank <= 3""")  # fmt: skip
def _(q, t, c):
    return S.match_tariff(as_queries(q, "id", "text"), t, c.select(codes.canonicalize_hsn(C("raw_code")).alias("hsn_code")), k=3)


def fts_sql(q: str, op: str, k: int, tariff: str = "v_tariff") -> str:
    need = "where m = n" if op == "and" else ""
    return f"""w as (select query_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as l from ({q})), d as (select query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] as l from w), e as (select query_id, len(l) as n, unnest(range(1, len(l) + 1)) as pos, unnest(l) as word from d),
k as (select hsn_code, token, max(weight) as weight from (select hsn_code, unnest(string_split_regex(lower(description), '[^a-z0-9]+')) as token, 1.0 as weight from {tariff} union all select hsn_code, unnest(string_split_regex(lower(category), '[^a-z0-9]+')), 0.4 from {tariff}) where token <> '' group by 1, 2),
p as (select query_id, n, hsn_code, pos, max(weight) as weight from e join k on word = token or (pos = n and len(word) >= 2 and starts_with(token, word)) group by 1, 2, 3, 4), f as (select query_id, n, hsn_code, count(*) as m, sum(weight) as s from p group by 1, 2, 3)
select query_id, hsn_code, cast(round(s / (1 + s), 9) as double) as score, cast(row_number() over (partition by query_id order by round(s / (1 + s), 9) desc, hsn_code) as int) as rank from f {need} qualify rank <= {k}"""


ASK_FTS = "select id as query_id, case id % 3 when 0 then text || ' ec' else text end as text from v_text where id % 100 = 0"


@query("r7_fts_search", "v_text v_tariff", f"with {fts_sql(ASK_FTS, 'or', 5)}")
def _(q, t):
    asked = q.filter("id % 100 = 0").selectExpr("id as query_id", "case id % 3 when 0 then text || ' ec' else text end as text")
    return S.fts_search(asked, t, {"description": 1.0, "category": 0.4}, 5, key="hsn_code")


ASK_AND = "select id as query_id, split_part(description, ' ', 1) || ' ' || split_part(description, ' ', 2) || ' promo' as text from v_catalog where id % 100 = 0"


@query("r7b_fts_search_and", "v_catalog v_tariff", f"with {fts_sql(ASK_AND, 'and', 5)}")
def _(c, t):
    asked = c.filter("id % 100 = 0").select(C("id").alias("query_id"), F.concat(F.substring_index("description", " ", 2), F.lit(" promo")).alias("text"))
    return S.fts_search(asked, t, {"description": 1.0, "category": 0.4}, 5, op="and", key="hsn_code")


ASK_SEARCH = "select id as query_id, case id % 4 when 0 then text when 1 then text || ' zz' when 2 then split_part(text, ' ', 2) || ' dru' else 'xyz ' || text end as text, case id % 3 when 0 then ['01', '1', '2x3'] when 1 then [] else null end as chapters from v_text where id % 100 = 0"
WEIGHTED = f"""q0 as ({ASK_SEARCH}), q1 as (select query_id, {tokens_sql('text')} as l, chapters from q0), q2 as (select query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:8] as words, list_filter(list_transform(coalesce(chapters, []), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda p: len(p) >= 2) as prefixes from q1), q as (select * from q2 where len(words) > 0),
pl as (select query_id, least(len(words), 6) as n, unnest(range(1, least(len(words), 6) + 1)) as pos, unnest(words[1:6]) as w from q), alt as (select query_id, n, pos, unnest(list_filter(list_distinct(list_concat([w], list_transform(list_filter(coalesce({SYN_SQL}[w], []), lambda y: len(y) >= 3 and not contains(y, ' ')), lambda y: regexp_replace(lower(y), '[^a-z]', '', 'g')))), lambda v: len(v) >= 2)) as word from pl),
one as (select hsn_code, min(description) as description, min(category) as category from v_tariff group by 1), k as (select hsn_code, token, max(weight) as weight from (select hsn_code, unnest(string_split_regex(lower(description), '[^a-z0-9]+')) as token, 1.0 as weight from one union all select hsn_code, unnest(string_split_regex(lower(category), '[^a-z0-9]+')), 0.4 from one) where token <> '' group by 1, 2),
p as (select query_id, n, hsn_code, pos, max(weight) as weight from alt join k on word = token or (pos = n and starts_with(token, word)) group by 1, 2, 3, 4), f as (select query_id, hsn_code, count(*) = n as whole, round(sum(weight) / (1 + sum(weight)), 9) as r from p join q using (query_id) where len(prefixes) = 0 or len(list_filter(prefixes, lambda x: starts_with(hsn_code, x))) > 0 group by query_id, n, hsn_code),
g as (select *, max(case when whole then 1 else 0 end) over (partition by query_id) as any_whole from f), b as (select query_id, hsn_code, r, whole, cast(row_number() over (partition by query_id order by r desc, hsn_code) as int) as rank from g where any_whole = 0 or whole qualify rank <= 20)
select query_id, hsn_code, round(least(0.96, r * 2.8 + least(0.35, len(list_intersect(words, list_distinct({tokens_sql('description')}))) * 0.08) + 0.16), 3)::double as score, whole, rank from b join q using (query_id) join one using (hsn_code)"""  # fmt: skip


@query("r7b_weighted_search", "v_text v_tariff", f"with {WEIGHTED}")
def _(q, t):
    asked = q.filter("id % 100 = 0").selectExpr("id as query_id", "case id % 4 when 0 then text when 1 then text || ' zz' when 2 then split_part(text, ' ', 2) || ' dru' else 'xyz ' || text end as text", "case id % 3 when 0 then array('01', '1', '2x3') when 1 then cast(array() as array<string>) end as chapters")
    return S.weighted_search(asked, t, 20, asked.select("query_id", "chapters"))


@query("r8_token_set_topk", "v_text v_catalog")
def _(q, c):
    return S.token_set_topk(as_queries(q, "id", "text"), c, 3)


DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: cast(a[i] as double) * b[i]))"


@query("r9_vector_topk", "embeddings", f"""with q as (select vec_id as query_id, embedding as a, sqrt({DOT.replace('b[i]', 'cast(a[i] as double)').replace('len(a)', 'len(embedding)').replace('a[i]', 'embedding[i]')}) as na from embeddings where vec_id % 100 = 0), d as (select vec_id, embedding as b, sqrt({DOT.replace('b[i]', 'cast(a[i] as double)').replace('len(a)', 'len(embedding)').replace('a[i]', 'embedding[i]')}) as nb from embeddings),
s as (select query_id, vec_id, round({DOT} / na / nb, 9) as score from q, d) select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s qualify rank <= 10""")  # fmt: skip
def _(e):
    e = e.select("vec_id", C("embedding").alias("vector"))
    return S.vector_topk(e.filter("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "vector"), e, 10)


@query("r9_vector_index", "embeddings")
def _(e):
    e = e.select("vec_id", C("embedding").alias("vector"))
    return S.vector_index_topk(e.filter("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "vector"), e, 10)


POOL = "select id % 500 as query_id, lpad(cast(1 + id % 23 as varchar), 2, '0') || '01' as hsn_code, case id % 5 when 0 then 'L2_inverted_index' when 1 then 'L3_pg_trgm_fuzzy' when 2 then 'L6_verified_products' when 3 then 'L5_prefix_code' else 'x' end as method, (id % 50) / 50.0::double as score from v_catalog"


@query("r10_merge_pools", "v_catalog", f"""with c as ({POOL}), a as (select query_id, hsn_code, method, score + case method when 'L6_verified_products' then 0.18 when 'L2_inverted_index' then 0.10 when 'L3_pg_trgm_fuzzy' then 0.05 else 0.0 end::double + case when hsn_code = '0101' or starts_with(hsn_code, '1') then 0.07 else 0.0 end::double as adjusted from c),
b as (select * from a qualify row_number() over (partition by query_id, hsn_code order by adjusted desc, method) = 1)
select query_id, hsn_code, method, round(least(1.0, greatest(0.0, adjusted)), 4) as score, cast(row_number() over (partition by query_id order by adjusted desc, hsn_code) as int) as rank from b""")  # fmt: skip
def _(c):
    pool = c.selectExpr(*POOL.removesuffix(" from v_catalog").removeprefix("select ").replace("::double", "D").replace("varchar", "string").replace(", lpad", "\nlpad").replace("hsn_code, case", "hsn_code\ncase").replace("method, (", "method\n(").split("\n"))
    return S.merge_pools(pool, pool.select("query_id").distinct().withColumn("codes", F.array(F.lit("0101"), F.lit("1"))))


RERANK_SQL = f"""with {FOUND}, c as (select t.id as query_id, t.text as query, k.id as old_rank, {CANON('k.raw_code')} as hsn_code, k.description, case k.id % 3 when 0 then 'verified_exact' when 1 then 'product_batch' else 'other' end as source, (k.id % 32) / 32.0::double as score, (k.id % 16) / 16.0::double as embedding,
case k.id % 4 when 0 then 'blue' when 1 then 'gear' end as brand, ['10', '20', '30'] as chapters from found o join v_text t on t.id = o.query_id join v_catalog k on k.id = o.id),
f as (select *, upper(query) as q, upper(description) as d, list_distinct(regexp_extract_all(upper(query), '[A-Z]{{3,}}')) as qw, list_distinct(regexp_extract_all(upper(description), '[A-Z]{{3,}}')) as dw from c), g as (select *, len(list_intersect(qw, dw)) as b from f),
s as (select query_id, hsn_code, old_rank, round(least(1.0, greatest(0.0, embedding * 0.30::double + b / greatest(len(qw) + len(dw) - b, 1) * 0.20::double + b / greatest(len(qw), 1) * 0.15::double + b / greatest(len(dw), 1) * 0.05::double + least(len(q), len(d)) / greatest(len(q), len(d), 1) * 0.02::double
 + case when list_contains(chapters, hsn_code[1:2]) then 0.10 else 0.0 end::double + case source when 'verified_exact' then 1.0 when 'product_batch' then 0.8 else 0.5 end::double * 0.05::double + score * 0.08::double + least(len(d) / 100, 1.0) * 0.03::double
 + case when brand is null then 0.0 when contains(q, upper(brand)) and contains(d, upper(brand)) then 1.0 when contains(q, upper(brand)) then 0.2 else 0.5 end::double * 0.02::double)), 9) as reranked from g)
select query_id, hsn_code, reranked, cast(row_number() over (partition by query_id order by reranked desc, old_rank, hsn_code) as int) as new_rank from s qualify new_rank <= 5"""


@query("r11_rerank", "v_text v_catalog", RERANK_SQL)
def _(q, c):
    k = c.select(
        "id",
        C("id").alias("old_rank"), codes.canonicalize_hsn(C("raw_code")).alias("hsn_code"), "description", F.expr("case id % 3 when 0 then 'verified_exact' when 1 then 'product_batch' else 'other' end").alias("source"),
        (C("id") % 32 / 32.0).alias("score"), (C("id") % 16 / 16.0).alias("embedding"), F.expr("case id % 4 when 0 then 'blue' when 1 then 'gear' end").alias("brand"), F.array(F.lit("10"), F.lit("20"), F.lit("30")).alias("chapters"),
    )
    return S.rerank(found(q, c).join(k, "id").drop("id"), 5)


LEX_DOMAINS = ", ".join(f"'{k}'" for k, _ in DOMAINS)
LEX = f"""with {FOUND}, c as (select t.id as query_id, k.id, {tokens_sql('t.text', True)} as q0, {tokens_sql('k.description')} as d0, {tokens_sql('k.description', True)} as b0, {tokens_sql("coalesce(k.category, '')")} as c0, lower(k.description) as low, (k.id % 8) / 8.0::double as base, {CANON('k.raw_code')} as code from found o join v_text t on t.id = o.query_id join v_catalog k on k.id = o.id),
u as (select query_id, id, code, list_filter(q0, lambda x, i: list_position(q0, x) = i) as every, list_filter(list_distinct(b0), lambda x: list_contains({listed(fixed.BRANDS)}, x)) as named, list_distinct(d0) as d, list_distinct(c0) as c, low, base from c),
v as (select *, list_filter(every, lambda x: list_contains({listed(fixed.BRANDS)}, x)) as b, list_filter(every, lambda x: not list_contains({listed(fixed.BRANDS)}, x)) as q, list_distinct(list_concat(list_concat(d, c), named)) as held from u),
n as (select query_id, count(*) as n from v group by 1), df as (select query_id, word, count(*) as df from (select query_id, id, unnest(held) as word from v) group by 1, 2),
w as (select query_id, id, unnest(b) as word, true as brand, d, c, named, held from v union all select query_id, id, unnest(q), false, d, c, named, held from v),
x as (select w.*, ln((n + 1.0) / (coalesce(df, 0) + 0.5)) + 1.0 + case when brand then 2.8 else case when len(word) >= 5 then 0.25 else 0.0 end + case when word in ({LEX_DOMAINS}) then 0.35 else 0.0 end end as weight from w join n using (query_id) left join df using (query_id, word)),
s as (select query_id, id, sum(weight * case when brand then case when list_contains(named, word) then 1.25 else 0.0 end when list_contains(d, word) then 1.0 when list_contains(c, word) then 0.75 when list_has_any(coalesce({SYN_SQL}[word], []), held) then 0.55 else 0.0 end) / sum(weight) as share from x group by 1, 2),
pt as (select id as query_id, {tokens_sql('text', True)} as l from v_text), pw as (select distinct query_id, unnest(list_concat(l, flatten(list_transform(l, lambda x: coalesce({SYN_SQL}[x], []))))) as keyword from pt),
pr(rule_no, keyword, chapters) as (values {RULE_ROWS}), pd(keyword, prefixes) as (values {DOMAIN_ROWS}), pa as (select query_id, min_by(chapters, rule_no) as prefixes from pw join pr using (keyword) group by 1),
p as (from pa union all select query_id, flatten(list(prefixes)) from pw join pd using (keyword) where query_id not in (select query_id from pa) group by 1),
y as (select v.*, share, list_filter(q, lambda x: len(x) >= 3) as lw, case when coalesce(len(prefixes), 0) = 0 or code = '' then 0.0 when len(list_filter(prefixes, lambda z: starts_with(code, z))) > 0 then 0.08 else -0.06 end as chapter from v left join s using (query_id, id) left join p using (query_id))
select query_id, id, round(least(1.0, greatest(0.0, case when len(every) = 0 then base else (coalesce(share, 0) - case when len(b) > 0 and len(named) > 0 and not list_has_any(b, named) then 0.16 else 0.0 end + chapter
 + case when array_to_string(lw[1:4], ' ') <> '' and contains(low, array_to_string(lw[1:4], ' ')) then 0.12 when len(lw) > 0 and list_has_all(held, lw[1:3]) then 0.06 else 0 end) * 0.74 + base * 0.26 end)), 9)::double as lexical from y"""


@query("r12_lexical_score", "v_text v_catalog", LEX)
def _(q, c):
    rows = c.select("id", codes.canonicalize_hsn(C("raw_code")).alias("hsn_code"), "description", F.coalesce("category", F.lit("")).alias("category"), (C("id") % 8 / 8.0).alias("base"))
    domains = q.sparkSession.createDataFrame([(k, list(p)) for k, p in DOMAINS], "keyword string, prefixes array<string>")
    prefixes = L.category_prefixes(as_queries(q.filter("id % 100 = 0"), "id", "text"), rule_table(q.sparkSession), domains)
    return S.lexical_score(found(q, c).join(rows, "id"), prefixes, tuple(k for k, _ in DOMAINS))


@query("r13_weighted_jaccard", "v_text v_catalog", f"""with p as (select t.id, list_distinct({tokens_sql('t.text')}) as q, list_distinct({tokens_sql('c.description')}) as d from v_text t join v_catalog c on t.id = c.id), s as (select *, list_filter(list_distinct(flatten(list_transform(q, lambda x: coalesce({SYN_SQL}[x], [])))), lambda x: not list_contains(q, x)) as o from p),
h as (select *, 2 * len(list_intersect(q, d)) + len(list_intersect(o, d)) as hit from s) select id, case when 2 * len(q) + len(o) + len(d) - hit > 0 then round(hit / (2 * len(q) + len(o) + len(d) - hit), 9) else 0.0 end as similarity from h""")  # fmt: skip
def _(q, c):
    return q.join(c, "id").select("id", F.round(S.weighted_jaccard(text.tokenize(C("text")), F.array_distinct(text.tokenize(C("description")))), 9).alias("similarity"))


BONUS = (("blue", "anvil", 0.12), ("blue", "gear", -0.2), ("red", "bolt", 0.3), ("hot", "plate", 0.25), ("plate", "hot", 0.25))
BONUS_ROWS = ", ".join(f"('{a}', '{b}', {d})" for a, b, d in BONUS)


@query("r14_intent_bonus", "v_text v_catalog", f"""with r(qw, tw, delta) as (values {BONUS_ROWS}), p as (select t.id, {tokens_sql('t.text', True)} as q, {tokens_sql('c.description', True)} as d from v_text t join v_catalog c on t.id = c.id)
select id, least(0.35, greatest(-0.35, coalesce((select sum(delta) from r where list_contains(q, qw) and list_contains(d, tw)), 0)))::double as bonus from p""")  # fmt: skip
def _(q, c):
    return S.intent_bonus(q.join(c, "id"), q.sparkSession.createDataFrame(list(BONUS), "query_word string, text_word string, delta double")).select("id", "bonus")


@query("r15_calibrate", "v_text v_catalog", f"""with p as (select t.id, list_filter({tokens_sql('t.text', True)}, lambda w: len(w) >= 3) as w, lower(c.description) as d from v_text t join v_catalog c on t.id = c.id), s as (select id, len(w) as n, len(list_filter(w, lambda x: contains(d, x))) / greatest(len(w), 1) as share from p)
select id, round(least(1.0, (id % 50) / 50.0 + case when n > 0 and share >= 1 then 0.05 when share >= 0.5 then 0.02 else 0.0 end), 9)::double as confidence from s""")  # fmt: skip
def _(q, c):
    return q.join(c, "id").select("id", F.round(S.calibrate(C("id") % 50 / 50.0, text.tokenize(C("text"), True), C("description")), 9).alias("confidence"))


@query("r16_hybrid_match", "v_text v_catalog", f"""with q as (select id as query_id, {KEY('text')} as qk, list_distinct({tokens_sql('text')}) as q, coalesce({tokens_sql('text')}[-1], '') as core from v_text where id % 100 = 0), d as (select id, {CANON('raw_code')} as hsn_code, (id % 4) / 100.0 as bonus, {KEY('description')} as dk, list_distinct({tokens_sql('description')}) as d from v_catalog),
r as (select *, len(list_intersect(q, d)) / len(q) * 0.68 + len(list_intersect(q, d)) / len(d) * 0.20 + case when list_contains(d, core) then 0.10 else 0.0 end + bonus as raw from q, d where len(list_intersect(q, d)) > 0),
s as (select query_id, hsn_code, round(least(1.0, case when qk = dk then greatest(raw, 0.95) when contains(dk, qk) or contains(qk, dk) then greatest(raw, 0.80) else raw end), 9)::double as score from r), g as (select query_id, hsn_code, max(score) as score, count(*) as support from s group by 1, 2)
select *, cast(row_number() over (partition by query_id order by score desc, support desc, hsn_code) as int) as rank from g qualify rank <= 5""")  # fmt: skip
def _(q, c):
    dataset = c.select("id", codes.canonicalize_hsn(C("raw_code")).alias("hsn_code"), "description", (C("id") % 4 / 100.0).alias("bonus"))
    return S.hybrid_match(as_queries(q.filter("id % 100 = 0"), "id", "text"), dataset, 5)


TERMS = (("blu", "azure", 1.5), ("gere", "gear", 1.0), ("anvill", "anvil", 1.2), ("vellam", "jaggery", 2.0), ("bolt", "screw", 1.0), ("colt", "chilled", 1.0), ("rink", "hoop", 1.0), ("rins", "wash", 5.0), ("biskit", "cookie", 1.0))
TERM_ROWS = ", ".join(f"('{a}', '{b}', {w}::double)" for a, b, w in TERMS)
TERM_SOUNDS = (("blu", "BL", "PL"), ("gere", "JR", "KR"), ("anvill", "ANFL", "ANFL"), ("vellam", "FLM", "FLM"), ("bolt", "BLT", "PLT"), ("colt", "KLT", "KLT"), ("rink", "RNK", "RNK"), ("rins", "RNS", "RNS"), ("biskit", "BSKT", "PSKT"))
SOUND_SQL = f"k(letters, m, d) as (values {', '.join(f"('{w}', '{m}', '{d}')" for w, m, d in dict.fromkeys((*SOUNDS, *TERM_SOUNDS)))})"


@query("r18_expand_query", "v_text", f"""with {SOUND_SQL}, a(term, english, weight) as (values {TERM_ROWS}), w as (select id as query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as l from v_text), e as (select query_id, unnest(range(len(l))) as pos, unnest(l) as word from w), u as (select distinct word from e),
x as (select word, {R1_TRI('word')} as ta, m, d from u left join k on k.letters = regexp_replace(word, '[^a-z]', '', 'g')), y as (select a.*, {R1_TRI('term')} as tb, m, d from a left join k on k.letters = term),
h as (select word, english, word = term as same, {SIM('ta', 'tb')} as s, weight from x, y where word = term or (len(ta) > 0 and len(word) >= 3 and word not in ({', '.join(f"'{w}'" for w in fixed.UNRESOLVED)}) and ({SIM('ta', 'tb')} >= 0.50 or ((x.m = y.m or x.d = y.d) and {SIM('ta', 'tb')} >= 0.40)))),
n as (select * from h qualify row_number() over (partition by word order by s desc, weight desc, english) <= 8), b as (select word, english from n qualify row_number() over (partition by word order by same desc, weight * s desc, s desc, english) = 1)
select query_id, string_agg(coalesce(english, word), ' ' order by pos) as expanded from e left join b using (word) group by 1""")  # fmt: skip
def _(q):
    return S.expand_query(as_queries(q, "id", "text"), q.sparkSession.createDataFrame(list(TERMS), "term string, english string, weight double"))


@query("r22_rerank_overlap", "v_text v_catalog", f"""with {FOUND}, c as (select t.id as query_id, k.id, {CANON('k.raw_code')} as hsn_code, list_distinct({tokens_sql('t.text')}) as q, list_distinct({tokens_sql('k.description')}) as d, (k.id % 10) / 20.0 as base from found o join v_text t on t.id = o.query_id join v_catalog k on k.id = o.id)
select query_id, id, hsn_code, round(least(0.92, base + 0.22 * len(list_intersect(q, d)) / greatest(len(q), 1) + case when hsn_code[1:2] in ('10', '20') then 0.04 else 0.0 end + 0.01 * (count(*) over (partition by query_id, hsn_code) - 1)), 9)::double as score from c""")  # fmt: skip
def _(q, c):
    k = c.select("id", codes.canonicalize_hsn(C("raw_code")).alias("hsn_code"), "description", (C("id") % 10 / 20.0).alias("base"), F.array(F.lit("10"), F.lit("20")).alias("chapters"))
    return S.rerank_overlap(found(q, c).join(k, "id"))


