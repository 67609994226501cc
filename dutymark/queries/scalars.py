"""Code, rate and text functions over whole derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, sound, text
from dutymark.registry import query

D = "regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g')"
SLABS = "[" + ", ".join(map(str, fixed.SLABS)) + "]"
C = F.col
quoted = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
sql_map = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def chain_sql(x: str, pairs) -> str:
    for pattern, to in pairs:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


@query("c1_canonicalize_hsn", "v_codes", f"select id, case when len({D}) = 0 then '' when len({D}) >= 8 then substr({D}, 1, 8) when len({D}) in (2, 4, 6) then rpad({D}, 8, '0') else lpad({D}, 8, '0') end as hsn from v_codes")
def _(t):
    return t.select("id", codes.canonicalize_hsn(C("code")).alias("hsn"))


@query("c2_clean_hsn", "v_codes", f"select id, case when len({D}) = 0 then null when len({D}) < 8 then lpad({D}, 8, '0') else {D} end as hsn from v_codes")
def _(t):
    return t.select("id", codes.clean_hsn(C("code")).alias("hsn"))


SAC = f"({D} like '99%' and len({D}) in (4, 6))"


@query("c3_code_type", "v_codes", f"select id, case when {SAC} then 'SAC' else 'HSN' end as by_code, case when upper(kind) in ('SAC', 'HSN') then upper(kind) when {SAC} then 'SAC' else 'HSN' end as told from v_codes")
def _(t):
    return t.select("id", codes.code_type(C("code")).alias("by_code"), codes.code_type(C("code"), C("kind")).alias("told"))


@query("c4_display_code", "v_codes", f"select id, case when {SAC} then substr({D}, 1, 6) when len({D}) < 8 then rpad({D}, 8, '0') else {D} end as shown from v_codes")
def _(t):
    return t.select("id", codes.display_code(C("code")).alias("shown"))


@query("c5_hierarchy", "v_codes", f"select id, case when len({D}) >= 2 then {D}[1:2] end as chapter, case when len({D}) >= 4 then {D}[1:4] end as heading, case when len({D}) >= 6 then {D}[1:6] end as subheading from v_codes")
def _(t):
    return t.select("id", codes.hierarchy(C("code")).alias("h")).select("id", "h.*")


@query("c6_parse_rate", "v_codes", r"select id, try_cast(nullif(regexp_extract(rate_text, '(\d+(?:\.\d+)?)', 1), '') as double) as rate from v_codes")
def _(t):
    return t.select("id", codes.parse_rate(C("rate_text")).alias("rate"))


@query("c7_parse_rate_nil", "v_codes", r"select id, case when upper(trim(rate_text)) in ('NIL', 'EXEMPT', 'NA', '-') then 0.0 else try_cast(nullif(regexp_extract(rate_text, '(\d+(?:\.\d+)?)', 1), '') as double) end as rate from v_codes")
def _(t):
    return t.select("id", codes.parse_rate(C("rate_text"), nil=True).alias("rate"))


@query("c8_rate_label", "v_codes", "select id, case when rate is null then null when rate = floor(rate) then cast(cast(rate as bigint) as varchar) || '%' else cast(cast(rate as double) as varchar) || '%' end as label from v_codes")
def _(t):
    return t.select("id", codes.rate_label(C("rate").cast("double")).alias("label"))


@query("c9_valid_slab", "v_codes", f"select id, coalesce(len(list_filter({SLABS}, lambda s: abs(cast(rate as double) - s) < 0.01)) > 0, false) as ok from v_codes")
def _(t):
    return t.select("id", codes.is_valid_slab(C("rate").cast("double")).alias("ok"))


@query("c10_closest_slab", "v_codes", f"select id, case when rate is not null then (select min_by(s, (abs(s - cast(rate as double)), s)) from (select unnest({SLABS}) as s)) end as slab from v_codes")
def _(t):
    return t.select("id", codes.closest_slab(C("rate").cast("double")).alias("slab"))


@query("c11_cess_flag", "v_codes", f"select id, {D}[1:2] in {quoted(fixed.CESS_CHAPTERS)} as cess from v_codes")
def _(t):
    return t.select("id", codes.cess_flag(C("code")).alias("cess"))


@query("c12_chapter_rate", "v_codes", f"select id, case when len({D}) >= 2 and cast({D}[1:2] as int) >= 1 then cast({list(map(float, fixed.CHAPTER_RATES))}[cast({D}[1:2] as int)] as double) end as rate from v_codes")
def _(t):
    return t.select("id", codes.chapter_rate(C("code")).alias("rate"))


TAX = "id, rate, case id % 3 when 0 then 12.0 when 1 then 0.0 end as cess, case id % 4 when 0 then 'combined' when 1 then 'unknown' else 'igst_only' end as sem, case id % 5 when 0 then null else 28.0 - id % 20 end as hist"


@query("c13_effective_tax", "v_codes", f"""select id, case when rate is null then hist when sem = 'igst_only' and coalesce(cess, 0) <> 0 then round(rate + cess, 4) when sem = 'combined' then rate when hist > rate then hist else rate end as tax
from (select id, cast(rate as double) as rate, cast(cess as double) as cess, sem, cast(hist as double) as hist from (select {TAX} from v_codes))""")  # fmt: skip
def _(t):
    t = t.selectExpr(*TAX.replace("case id % 3", "\ncase id % 3").replace("case id % 4", "\ncase id % 4").replace("case id % 5", "\ncase id % 5").split(", \n")[1:], "id", "rate")
    return t.select("id", codes.effective_tax(*(C(c).cast("double") if c != "sem" else C(c) for c in ("rate", "cess", "sem", "hist"))).alias("tax"))


@query("c14_valid_code", "v_codes", r"select id, regexp_full_match(coalesce(code, ''), '[0-9]{2}|[0-9]{4}|[0-9]{6}|[0-9]{8}') as valid, coalesce(code, '') in ('', '99999999', '00000000') as unclassified from v_codes")
def _(t):
    return t.select("id", codes.is_valid_code(C("code")).alias("valid"), codes.is_unclassified(C("code")).alias("unclassified"))


@query("c15_placeholder", "v_codes", "select id, coalesce(code, '') like '%00' as placeholder from v_codes")
def _(t):
    return t.select("id", codes.is_placeholder(C("code")).alias("placeholder"))


@query("c16_full_description", "v_codes", """with p as (select id, name, case id % 3 when 0 then name || ': -' when 1 then 'Other goods:' end as parent, case id % 5 when 0 then ' ' || upper(name) when 1 then '  ' end as official from v_codes),
q as (select *, rtrim(regexp_replace(coalesce(parent, ''), '[: -]+$', '')) as head from p)
select id, coalesce(nullif(trim(official), ''), case when head = '' or instr(lower(name), lower(head)) > 0 then name else head || ' — ' || name end) as full_text from q""")  # fmt: skip
def _(t):
    t = t.selectExpr("id", "name", "case id % 3 when 0 then name || ': -' when 1 then 'Other goods:' end as parent", "case id % 5 when 0 then ' ' || upper(name) when 1 then '  ' end as official")
    return t.select("id", codes.full_description(C("name"), C("parent"), C("official")).alias("full_text"))


TYPOS_SQL = chain_sql("upper(text)", fixed.TYPOS)


@query("t1_fix_typos", "v_text", f"select id, case when regexp_matches(text, '[^\\x00-\\x7F]') then text else {TYPOS_SQL} end as fixed from v_text")
def _(t):
    return t.select("id", text.fix_typos(C("text")).alias("fixed"))


POS_SQL = f"""array_to_string(list_transform(w, lambda x, i: coalesce({sql_map(fixed.ABBREVIATIONS)}[x], case when i = len(w) or regexp_matches(w[i + 1], '^\\s') then {sql_map(fixed.END_ABBREVIATIONS)}[x] end, x)), '')"""


@query("t2_expand_pos", "v_text", f"with p as (select id, regexp_extract_all(upper(text), '([A-Z0-9_]+|[^A-Z0-9_]+)') as w from v_text) select id, {POS_SQL} as expanded from p")
def _(t):
    return t.select("id", text.expand_pos(C("text")).alias("expanded"))


NOISE = ((rf"\b\d+(\.\d+)?\s*({fixed.NOISE_UNITS})\b", " "), (r"\b\d+\b", " "), (r"\b[A-Z]{0,3}\d{2,}[A-Z0-9]{0,4}\b", " "), (r"\*|\bX\d+\b|\d+X\b", " "))


@query("t3_strip_noise", "v_text", f"select id, {squeeze(chain_sql('upper(text)', NOISE))} as plain from v_text where not regexp_matches(text, '[^\\x00-\\x7F]')")
def _(t):
    return t.filter(text.is_plain(C("text"))).select("id", text.strip_noise(C("text")).alias("plain"))


NAME_SQL = f"""with p as (select id, text, regexp_extract_all({chain_sql("upper(trim(text))", fixed.TYPOS)}, '([A-Z0-9_]+|[^A-Z0-9_]+)') as w from v_text where not regexp_matches(text, '[^\\x00-\\x7F]')),
q as (select id, {squeeze(chain_sql(f"regexp_replace({squeeze(chain_sql(f'upper({POS_SQL})', NOISE))}, '[()\\[\\]{{}}#@\\\\|^~`]', ' ', 'g')", [(x, " ") for x in fixed.SHAPES]))} as n from p)
select id, case when regexp_full_match(n, '({"|".join(fixed.LEADING_STOPS)})( ({"|".join(fixed.LEADING_STOPS)}))*') then regexp_extract(n, '[A-Z]+$') else regexp_replace(n, '^(({"|".join(fixed.LEADING_STOPS)}) )+', '') end as name from q"""  # fmt: skip


@query("t4_normalize_name", "v_text", NAME_SQL)
def _(t):
    return t.filter(text.is_plain(C("text"))).select("id", text.normalize_name(C("text")).alias("name"))


@query("t5_product_keywords", "v_text", f"""with p as (select id, list_filter(string_split({squeeze(chain_sql('upper(text)', NOISE))}, ' '), lambda x: x <> '') as w from v_text where not regexp_matches(text, '[^\\x00-\\x7F]')),
q as (select id, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: not list_contains({listed([b.upper() for b in fixed.BRANDS])}, w[i]))), len(w) + 1) as first from p),
r as (select id, w, case when first > len(w) then w[greatest(len(w) - 1, 1):] else w[first:] end as rest from q)
select id, case when len(w) = 0 then [] when len(rest) >= 2 and len(rest[-1]) >= 5 then [rest[-1]] when len(rest) >= 2 then [rest[-2] || ' ' || rest[-1]] else rest[1:1] end as keywords from r""")  # fmt: skip
def _(t):
    return t.filter(text.is_plain(C("text"))).select("id", text.product_keywords(C("text")).alias("keywords"))


KEYS = ((rf"\b\d+(\.\d+)?\s*({fixed.KEY_UNITS})\b", " "), (r"\b\d+\s*X\s*\d+\b", " "), (r"\b\d+\s*\+\s*\d+\b", " "), (r"\b\d+[SNP]\b", " "), (r"\b\d+\b", " "), (r"[^A-Z\s]", " "))
NO_SIZE = lambda x: squeeze(chain_sql(f"upper({x})", KEYS))


@query("t6_strip_sizes", "v_text", f"select id, {NO_SIZE('text')} as key from v_text where not regexp_matches(text, '[^\\x00-\\x7F]')")
def _(t):
    return t.filter(text.is_plain(C("text"))).select("id", text.strip_sizes(C("text")).alias("key"))


@query("t7_text_key", "v_text", f"select id, {squeeze(chain_sql('upper(text)', [('[^A-Z0-9\\s]', ' ')]))} as key from v_text")
def _(t):
    return t.select("id", text.text_key(C("text")).alias("key"))


WORDS_SQL = chain_sql("text", ((r"(?i)\bSS\b", "stainless steel"), (r"(?i)\bFTGR\b", "fenugreek"), (r"(?i)\bTR\.\s*", "kitchen treasure "), (r"(?i)\bTR\b", "kitchen treasure")))


@query("t8_expand_words", "v_text", f"""with p as (select id, list_transform(list_filter(string_split_regex(lower({WORDS_SQL}), '\\s+'), lambda x: x <> ''), lambda x: coalesce({sql_map(fixed.TRADE_WORDS)}[regexp_replace(x, '\\.+$', '')], x)) as w from v_text)
select id, array_to_string(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), ' ') as expanded from p""")  # fmt: skip
def _(t):
    return t.select("id", text.expand_words(C("text")).alias("expanded"))


def tokens_sql(x: str, keep_brands: bool = False) -> str:
    base = f"regexp_replace(regexp_replace(lower({x}), '\\b\\d+\\s*({fixed.TOKEN_UNITS})\\b', ' ', 'g'), '\\b\\d+\\b', ' ', 'g')"
    return f"list_filter(regexp_extract_all({base}, '[a-z]{{2,}}'), lambda t: not list_contains({listed(fixed.STOPWORDS if keep_brands else fixed.STOPWORDS + fixed.BRANDS)}, t))"


@query("t9_tokenize", "v_text", f"select id, {tokens_sql('text')} as tokens, {tokens_sql('text', True)} as with_brands from v_text")
def _(t):
    return t.select("id", text.tokenize(C("text")).alias("tokens"), text.tokenize(C("text"), True).alias("with_brands"))


@query("t10_query_fields", "v_text", f"""with p as (select id, {tokens_sql('text', True)} as w from v_text), q as (select id, list_filter(w, lambda x, i: list_position(w, x) = i) as all_tokens from p)
select id, list_filter(all_tokens, lambda x: list_contains({listed(fixed.BRANDS)}, x)) as brand_tokens, list_filter(all_tokens, lambda x: not list_contains({listed(fixed.BRANDS)}, x)) as product_tokens, all_tokens from q""")  # fmt: skip
def _(t):
    return t.select("id", text.query_fields(C("text")).alias("f")).select("id", "f.*")


SYN_SQL = "MAP {" + ", ".join(f"'{k}': {listed(v)}" for k, v in fixed.SYNONYMS.items()) + "}"


@query("t11_expand_synonyms", "v_text", f"select id, flatten(list_transform({tokens_sql('text')}, lambda x: list_concat([x], coalesce({SYN_SQL}[x], [])))) as tokens from v_text")
def _(t):
    return t.select("id", text.expand_synonyms(text.tokenize(C("text"))).alias("tokens"))


PACK = rf"\b(\d+(?:\.\d+)?)\s*({fixed.PACK_UNITS})\b"
PACK_SQL = lambda x: (f"try_cast(nullif(regexp_extract(upper({x}), '{PACK}', 1), '') as double) * case when regexp_extract(upper({x}), '{PACK}', 2) in ('L', 'LTR', 'KG') then 1000 else 1 end", f"case when regexp_extract(upper({x}), '{PACK}', 2) in ('L', 'LTR', 'ML') then 'ML' when regexp_extract(upper({x}), '{PACK}', 2) <> '' then 'G' end")


@query("t12_pack_size", "v_text", f"select id, array_to_string(regexp_extract_all(lower(text), '\\b(\\d+(?:\\.\\d+)?\\s*(?:{fixed.TOKEN_UNITS}))\\b', 1), ' ') as pack, {PACK_SQL('text')[0]} as value, {PACK_SQL('text')[1]} as unit from v_text")
def _(t):
    return t.select("id", text.pack_text(C("text")).alias("pack"), text.pack_size(C("text")).alias("s")).select("id", "pack", "s.value", "s.unit")


@query("t13_size_similarity", "v_text v_catalog", f"""with p as (select t.id, {PACK_SQL('t.text')[0]} as v1, {PACK_SQL('t.text')[1]} as u1, {PACK_SQL('c.description')[0]} as v2, {PACK_SQL('c.description')[1]} as u2 from v_text t join v_catalog c on t.id = c.id)
select id, case when v1 is null or v2 is null or u1 <> u2 then 0.0 when v1 = v2 then 0.14 else round((1 - least(abs(v1 - v2) / greatest(v1, v2, 1.0), 1.0)) * 0.08, 4) end as similarity from p""")  # fmt: skip
def _(t, c):
    return t.join(c, "id").select("id", text.size_similarity(text.pack_size(C("text")), text.pack_size(C("description"))).alias("similarity"))


@query("t14_core_product", "v_text", f"select id, coalesce({tokens_sql('text')}[-1], '') as core from v_text")
def _(t):
    return t.select("id", text.core_product(C("text")).alias("core"))


@query("t15_brand_token", "v_text", f"select id, coalesce(list_filter(string_split({NO_SIZE('text')}, ' '), lambda w: len(w) >= 2 and not list_contains({listed([s.upper() for s in fixed.STOPWORDS])}, w))[1], '') as brand from v_text where not regexp_matches(text, '[^\\x00-\\x7F]')")
def _(t):
    return t.filter(text.is_plain(C("text"))).select("id", text.brand_token(C("text")).alias("brand"))


@query("t16_normalize_description", "v_text", f"""select id, {squeeze(f"regexp_replace(array_to_string(list_transform(string_split_regex(lower(text), '\\s+'), lambda x: coalesce({sql_map(fixed.TRADE_WORDS)}[regexp_replace(x, '[.,]+$', '')], x)), ' '), '\\s*[+&]\\s*', ' ', 'g')")} as plain from v_text""")
def _(t):
    return t.select("id", text.normalize_description(C("text")).alias("plain"))


SPOKEN = "select doc_id, case doc_id % 9 when 0 then 'vellam podi' when 1 then text || ' मसाला' when 2 then 'മത്തി ' || text when 3 then 'sharkara' when 4 then 'tea achar x' else text end as said from documents"


@query("t17_detect_language", "documents", f"""with s as ({SPOKEN}), p as (select doc_id, said, list_filter(string_split_regex(lower(coalesce(said, '')), '[^a-z]+'), lambda x: x <> '') as w from s), q as (select *, len(list_filter(w, lambda x: list_contains({listed(fixed.ROMAN_HINTS)}, x))) as hits from p)
select doc_id, case when regexp_matches(said, '[\\x{{0900}}-\\x{{097F}}]') then 'hi' when regexp_matches(said, '[\\x{{0D00}}-\\x{{0D7F}}]') then 'ml' when hits >= 2 or (len(w) = 1 and hits = 1 and len(w[1]) >= 5) or (len(w) > 1 and hits >= 1 and hits / len(w) >= 0.34) then 'ml-roman' else 'en' end as language from q""")  # fmt: skip
def _(t):
    said = t.selectExpr("doc_id", "case doc_id % 9 when 0 then 'vellam podi' when 1 then text || ' मसाला' when 2 then 'മത്തി ' || text when 3 then 'sharkara' when 4 then 'tea achar x' else text end as said")
    return said.select("doc_id", text.detect_language(C("said")).alias("language"))


@query("t18_normalize_term", "documents")
def _(t):
    return t.select("doc_id", text.normalize_term(C("text")).alias("term"))


RULES = {"material": (("bolt|plate", "metal"), ("ring|rod", "textile"), ("gear", "gear")), "region": (("red|hot", "red"), ("blue|cold", "blue")), "hint": (("plate", "73"), ("widget", "70"))}


@query("t19_entities", "part", "select p_partkey as id, " + ", ".join("case " + " ".join(f"when regexp_matches(lower(p_name || ' ' || p_type), '{p}') then '{v}'" for p, v in pairs) + f" end as {kind}" for kind, pairs in RULES.items()) + " from part")
def _(t):
    return t.select(C("p_partkey").alias("id"), text.entities(F.concat_ws(" ", "p_name", "p_type"), RULES).alias("e")).select("id", "e.*")


SHOES = "select p_partkey as id, case p_partkey % 4 when 0 then 'VKC 3017 GTS 9' when 1 then 'vkc-9917 lds ' || (p_size % 10) when 2 then 'WKM' || (1000 + p_partkey % 900) || ' K' else p_name end as shoe from part"
SHOE_PATTERN = r"\b([A-Z]{2,4})[ -]?(\d{3,5})[ -]?(GTS|LDS|KDS|G|L|K)?[ -]?(\d{1,2})?\b"


@query("t20_parse_footwear", "part", f"""with s as ({SHOES}), p as (select id, upper(shoe) as u from s), q as (select id, {", ".join(f"nullif(regexp_extract(u, '{SHOE_PATTERN}', {i}), '') as {n}" for i, n in enumerate(("series", "model", "g", "size"), 1))} from p)
select id, case when model is not null then series end as series, model, case when model is not null then g[1:1] end as gender, case when model is not null then size end as size,
case when model is null then null when g[1:1] = 'L' then '64029990' when g[1:1] = 'K' then '64041990' else '64022090' end as code from q""")  # fmt: skip
def _(t):
    shoes = t.selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then 'VKC 3017 GTS 9' when 1 then 'vkc-9917 lds ' || (p_size % 10) when 2 then 'WKM' || (1000 + p_partkey % 900) || ' K' else p_name end as shoe")
    return shoes.select("id", text.parse_footwear(C("shoe")).alias("s")).select("id", "s.*")


@query("t21_query_key", "v_queries", f"select row_id, upper({squeeze('query')}) as key, 'match:v1:' || sha1(upper({squeeze('query')})) as cache_key from v_queries")
def _(t):
    return t.select("row_id", text.query_key(C("query")).alias("key"), text.cache_key(C("query")).alias("cache_key"))


@query("t24_confidence_label", "v_search_events", "select event_id, case when confidence / 100.0 >= 0.8 then 'high' when confidence / 100.0 >= 0.55 then 'medium' else 'low' end as label from v_search_events")
def _(t):
    return t.select("event_id", text.confidence_label(C("confidence") / 100.0).alias("label"))


@query("t25_scaled_confidence", "v_search_events", """select event_id, cast(least(100, greatest(0, floor(case source when 'click' then 100.0 when 'view' then (confidence / 128.0 - 0.92) / 0.08 * 100 else confidence / 128.0 * 100 end + 0.5))) as int) as scaled from v_search_events""")
def _(t):
    named = F.when(C("source") == "click", "exact").when(C("source") == "view", "verified_exact").otherwise("trigram")
    return t.select("event_id", text.scaled_confidence(C("confidence") / 128.0, named).alias("scaled"))


PHRASES = {"blue anvil": "nut", "blue": "badam", "anvil": "old", "small red bolt": "veil", "vellam podi": "jaggery powder", "podi": "powder", "tata tea": "tea"}


@query("t26_replace_phrases", "v_text", f"""with recursive p as (select id, string_split({squeeze('lower(text)')}, ' ') as w from v_text), m as (select {sql_map(PHRASES)} as m),
r as (select id, w, 1 as pos, '' as done from p union all
  select id, w, pos + n, done || ' ' || coalesce(m.m[array_to_string(w[pos:pos + n - 1], ' ')], w[pos]) from (
    select id, w, pos, done, coalesce(list_max(list_filter([1, 2, 3, 4], lambda k: pos + k - 1 <= len(w) and {sql_map(PHRASES)}[array_to_string(w[pos:pos + k - 1], ' ')] is not null)), 1) as n from r where pos <= len(w)), m)
select id, trim(done) as replaced from r where pos > len(w)""")  # fmt: skip
def _(t):
    return t.select("id", text.replace_phrases(C("text"), PHRASES).alias("replaced"))


@query("t27_clean_category", "v_codes", "select id, nullif(nullif(trim(category), ''), 'Other_Unclassified') as category from v_codes")
def _(t):
    return t.select("id", codes.clean_category(C("category")).alias("category"))


LEADS = ("blue", "blue anvil", "ring", "tata")


@query("t28_strip_brand_prefix", "v_text", f"select id, trim(regexp_replace(upper(text), '^({'|'.join(b.upper() for b in sorted(LEADS, key=len, reverse=True))})\\b\\s*', '')) as rest from v_text")
def _(t):
    return t.select("id", text.strip_brand_prefix(C("text"), LEADS).alias("rest"))


#: Keys of all words that occur in the texts, by the public algorithms; the SQL looks them up.
SOUNDS = (
    ("the", "0", "0"), ("new", "N", "N"), ("anvil", "ANFL", "ANFL"), ("biscuit", "BSKT", "PSKT"), ("blue", "BL", "PL"), ("bolt", "BLT", "PLT"), ("btl", "BTL", "PTL"), ("btrm", "BTRM", "PTRM"),
    ("clnr", "KLNR", "KLNR"), ("cocunut", "KKNT", "KKNT"), ("cold", "KLT", "KLT"), ("excel", "EKSSL", "AKSL"), ("free", "FR", "FR"), ("g", "K", "K"), ("gear", "JR", "JR"), ("gizmo", "JSM", "JSM"),
    ("glass", "KLS", "KLS"), ("gm", "KM", "KM"), ("hot", "HT", "HT"), ("kg", "KK", "KK"), ("large", "LRJ", "LRJ"), ("masala", "MSL", "MSL"), ("ml", "ML", "ML"), ("old", "OLT", "ALT"), ("pack", "PK", "PK"),
    ("pdr", "PTR", "PTR"), ("pet", "PT", "PT"), ("plate", "PLT", "PLT"), ("podi", "PT", "PT"), ("red", "RT", "RT"), ("refil", "RFL", "RFL"), ("ring", "RNK", "RNK"), ("rod", "RT", "RT"), ("shp", "XP", "XP"),
    ("small", "SML", "SML"), ("ss", "S", "S"), ("surf", "SRF", "SRF"), ("tab", "TB", "TP"), ("tata", "TT", "TT"), ("tea", "T", "T"), ("tr", "TR", "TR"), ("vellam", "FLM", "FLM"), ("widget", "WJT", "AJT"),
    ("s", "S", "S"), ("x", "S", "S"), ("ab", "AB", "AP"), ("caf", "KF", "KF"), ("cr", "KR", "KR"), ("me", "M", "M"),
)
SOUND_ROWS = ", ".join(f"('{w}', '{m}', '{d}')" for w, m, d in SOUNDS)


@query("t29_phonetic_key", "v_text", f"""with k(w, m, d) as (values {SOUND_ROWS}), t as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as w from v_text)
select w as word, m as metaphone, d as double_metaphone from t left join k using (w) where w <> ''""")  # fmt: skip
def _(t):
    words = t.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).distinct().filter("word <> ''")
    return words.withColumn("s", sound.sound_keys(C("word"))).select("word", C("s.metaphone").alias("metaphone"), C("s.first").alias("double_metaphone"))


R1_TRI = lambda x: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("r1_trigram_similarity", "v_text v_catalog", f"""with p as (select t.id, {R1_TRI('t.text')} as a, {R1_TRI('c.description')} as b from v_text t join v_catalog c on t.id = c.id)
select id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) as similarity from p""")  # fmt: skip
def _(t, c):
    return t.join(c, "id").select("id", F.round(text.trgm_similarity(C("text"), C("description")), 9).alias("similarity"))
