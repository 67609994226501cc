"""Lookups of product text and codes: exact, alias, brand, prefix, keyword, rate; all as set-based joins.

A matcher takes queries (query_id, text) and a reference, and returns candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, text
from dutymark.operators.containment import contained, containing

C = F.col


def first_per(df: DataFrame, keys, *order) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_per(df: DataFrame, keys, k: int, *order, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(C(rank) <= k)


def once_per_text(queries: DataFrame, run) -> DataFrame:
    """run on the distinct texts of queries (query_id, text), each with itself as query_id; its rows (query_id, ..) are copied to all queries with the text. Null texts have none."""
    asked = queries.select("text").distinct().filter("text is not null").select(C("text").alias("query_id"), "text")
    found = run(asked)
    return queries.select("query_id", "text").join(found.withColumnRenamed("query_id", "text"), "text").select(*found.columns)


def search_tariff(tariff: DataFrame, q: str | None = None, rate: float | None = None, category: str | None = None, n: int | None = None) -> DataFrame:
    """Tariff rows by text, rate and category, by code and text; n cuts the list."""
    out = tariff
    if q:
        out = out.filter(C("description").ilike(f"%{q}%"))
    if rate is not None:
        out = out.filter(F.abs(C("gst_rate") - rate) < 0.01)
    if category:
        out = out.filter(C("category").ilike(f"%{category}%"))
    return out if n is None else out.orderBy("hsn_code", "description").limit(n)


def filter_candidates(cands: DataFrame, min_score: float | None = None, categories: list[str] | None = None, rate: float | None = None, chapter: str | None = None) -> DataFrame:
    out = cands
    if min_score is not None:
        out = out.filter(C("score") >= min_score)
    if categories:
        out = out.filter(F.upper(F.coalesce("category", F.lit(""))).isin([c.upper() for c in categories]))
    if rate is not None:
        out = out.filter(F.abs(C("gst_rate") - rate) < 0.01)
    if chapter:
        out = out.filter(F.substring("hsn_code", 1, 2) == chapter.zfill(2))
    return out


def match_code(queries: DataFrame, tariff: DataFrame) -> DataFrame:
    """(query_id, tariff columns) where the query is a code."""
    return queries.select("query_id", codes.canonicalize_hsn(C("text")).alias("hsn_code")).filter("hsn_code <> ''").join(tariff, "hsn_code")


def code_prefixes(tariff: DataFrame, shortest: int = 2) -> DataFrame:
    """tariff with one row per prefix of its code, from `shortest` digits on."""
    lengths = F.sequence(F.lit(shortest), F.length("hsn_code"))
    return tariff.withColumn("prefix", F.explode(F.transform(lengths, lambda n: F.substring(C("hsn_code"), F.lit(1), n))))


def match_code_prefix(queries: DataFrame, tariff: DataFrame, k: int) -> DataFrame:
    """Codes that start with all digits of the query (2 to 8); a longer rest lowers the score."""
    wanted = queries.select("query_id", codes.digits(C("text")).alias("prefix")).filter("length(prefix) between 2 and 8")
    one = tariff.groupBy("hsn_code").agg(F.min("description").alias("description"))
    score = F.greatest(F.lit(0.45), F.round(1 - 0.05 * (F.length("hsn_code") - F.length("prefix")), 4))
    # the k first codes of a prefix answer all its queries
    best = top_per(code_prefixes(one).withColumn("score", score), "prefix", k, F.desc("score"), "hsn_code")
    return wanted.join(best, "prefix").select("query_id", "hsn_code", "description", "score", "rank")


def match_embedded_code(queries: DataFrame, tariff: DataFrame, k: int) -> DataFrame:
    """The first run of 4 to 8 digits in the text as a code prefix; the score falls with the rank."""
    wanted = queries.select("query_id", F.regexp_extract("text", r"\b(\d{4,8})\b", 1).alias("prefix")).filter("prefix <> ''")
    best = top_per(code_prefixes(tariff.select("hsn_code").distinct(), 4), "prefix", k, "hsn_code")
    return wanted.join(best, "prefix").select("query_id", "hsn_code", F.greatest(F.lit(0.72), F.round(0.98 - 0.08 * (C("rank") - 1), 4)).alias("score"), "rank")


def chapter_hints(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, chapters): of the rules (rule_no, keyword, chapters) with a keyword among the words, the first one's chapters."""
    words = queries.select("query_id", F.explode(F.array_distinct(text.tokenize(C("text"), True))).alias("keyword"))
    return words.join(rules, "keyword").groupBy("query_id").agg(F.min_by("chapters", "rule_no").alias("chapters"))


def category_prefixes(queries: DataFrame, rules: DataFrame, domains: DataFrame, synonyms: dict = fixed.SYNONYMS) -> DataFrame:
    """(query_id, prefixes, by_rule): code beginnings that the words of a query and their synonyms allow, rising.

    The chapters of the first rule (rule_no, keyword, chapters) with one of the words; where no rule has one, all prefixes of the words' domains
    (keyword, prefixes). Queries with neither have no row.
    """
    words = queries.select("text").distinct().select("text", F.explode(F.array_distinct(text.expand_synonyms(text.tokenize(C("text"), True), synonyms))).alias("keyword"))
    ruled = words.join(rules, "keyword").groupBy("text").agg(F.min_by("chapters", "rule_no").alias("prefixes"))
    others = words.join(ruled.select("text"), "text", "left_anti").join(domains, "keyword").groupBy("text").agg(F.flatten(F.collect_set("prefixes")).alias("prefixes"))
    both = ruled.withColumn("by_rule", F.lit(True)).unionByName(others.withColumn("by_rule", F.lit(False)))
    sorted_ = both.select("text", F.array_sort(F.array_distinct("prefixes")).alias("prefixes"), "by_rule").filter("size(prefixes) > 0")
    return queries.select("query_id", "text").join(sorted_, "text").drop("text")


def apply_chapter_hints(cands: DataFrame, hints: DataFrame, penalty: float | None = None) -> DataFrame:
    """Candidates outside the allowed chapters go, or lose `penalty` of their score."""
    joined = cands.join(hints, "query_id", "left")
    ok = C("chapters").isNull() | F.array_contains("chapters", F.substring("hsn_code", 1, 2))
    return joined.filter(ok).drop("chapters") if penalty is None else joined.withColumn("score", C("score") - F.when(ok, 0.0).otherwise(penalty)).drop("chapters")


def is_authoritative(code: Column, rate: Column, confidence: Column, review: Column) -> Column:
    return F.coalesce(code.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8})$") & ~codes.is_unclassified(code) & rate.isNotNull() & (confidence >= 70) & ~review, F.lit(False))


def match_keys(queries: DataFrame, keys: list[Column], reference: DataFrame, ref_key: Column) -> DataFrame:
    """(query_id, key_no, reference columns): for each query the first key with a match, then the smallest id."""
    listed = queries.select("query_id", F.posexplode(F.array(*keys)).alias("key_no", "key")).filter("key <> ''")
    hits = listed.join(reference.withColumn("key", ref_key), "key")
    return first_per(hits, "query_id", "key_no", "id").drop("key")


def match_exact(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog row by normalized text, else by the text without sizes."""
    q = queries.select("query_id", F.posexplode(F.array(text.text_key(C("text")), text.strip_sizes(C("text")))).alias("priority", "key")).filter("key <> ''")
    refs = catalog.select("id", "raw_code", "gst_raw", F.posexplode(F.array(text.text_key(C("description")), text.strip_sizes(C("description")))).alias("priority", "key"))
    refs = first_per(refs, ["priority", "key"], "id")  # one row per key, so the join cannot grow
    return first_per(q.join(refs, ["priority", "key"]), "query_id", "priority", "id").drop("key")


def alias_ngrams(c: Column, n: Column) -> Column:
    """array<struct<phrase, at>>: runs of n words."""
    runs = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct(F.array_join(F.slice(words, i, n), " ").alias("phrase"), i.alias("at")))
    return text.let(F.split(c, " "), lambda words: F.when(F.size(words) >= n, runs(words)))


def match_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias, code): an alias equal to the text, else the longest that opens it or (from 4 letters) stands between blanks.

    Runs of as many words as some alias has are looked up, so aliases may have any length.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    # equal texts are looked up once
    asked = queries.select("text").distinct().select("text", plain.alias("plain")).filter("plain <> ''")
    sizes = aliases.select(F.size(F.split("alias", " ")).alias("n")).filter("n > 0").distinct()
    grams = asked.select("plain").distinct().join(F.broadcast(sizes)).select("plain", F.explode(alias_ngrams(C("plain"), C("n"))).alias("g")).select("plain", "g.phrase", "g.at")
    hits = grams.join(aliases, grams["phrase"] == aliases["alias"]).filter("at = 1 or length(alias) >= 4").withColumn("whole", C("alias") == C("plain"))
    order = (F.desc("whole"), F.desc(F.length("alias")), "alias", "code")
    best = asked.join(first_per(hits, "plain", *order).select("plain", "whole", "alias", "code"), "plain").drop("plain")
    return first_per(queries.select("query_id", "text").join(best, "text"), "query_id", *order).select("query_id", "alias", "code")


def tariff_rates(tariff: DataFrame) -> DataFrame:
    """One rate per code: that of the row with the smallest text."""
    return first_per(tariff.filter("gst_rate is not null"), "hsn_code", "description").select("hsn_code", "gst_rate")


def lookup_rate(df: DataFrame, tariff: DataFrame, code: str = "hsn_code") -> DataFrame:
    """df plus rate and rate_from: of the same code, else of the first code with the same six digits, else of the chapter."""
    rates = tariff_rates(tariff)
    heads = first_per(rates.select(F.substring("hsn_code", 1, 6).alias("__head"), "hsn_code", C("gst_rate").alias("__head_rate")), "__head", "hsn_code").drop("hsn_code")
    exact = rates.select(C("hsn_code").alias("__code"), C("gst_rate").alias("__rate"))
    full = codes.canonicalize_hsn(C(code))
    out = df.withColumn("__code", full).withColumn("__head", F.substring(full, 1, 6)).join(exact, "__code", "left").join(heads, "__head", "left")
    chapter = F.when(C("__code") != "", codes.chapter_rate(C("__code")))
    return out.withColumn("rate", F.coalesce("__rate", "__head_rate", chapter)).withColumn("rate_from", F.when(C("__rate").isNotNull(), "code").when(C("__head_rate").isNotNull(), "head").when(chapter.isNotNull(), "chapter")).drop("__code", "__head", "__rate", "__head_rate")


def longest_prefix_join(df: DataFrame, prefixes: DataFrame, code: str = "hsn_code") -> DataFrame:
    """df plus rate and prefix_len of the longest prefix (8, 6, 4, 2 digits) found in prefixes (prefix, rate)."""
    out = df
    for n in (8, 6, 4, 2):
        own = prefixes.filter(F.length("prefix") == n).select(C("prefix").alias(f"__p{n}"), C("rate").alias(f"__r{n}"))
        out = out.withColumn(f"__p{n}", F.substring(code, 1, n)).join(own, f"__p{n}", "left")
    size = F.coalesce(*[F.when(C(f"__r{n}").isNotNull(), n) for n in (8, 6, 4, 2)])
    return out.withColumn("rate", F.coalesce(*[C(f"__r{n}") for n in (8, 6, 4, 2)])).withColumn("prefix_len", size).drop(*[f"__{x}{n}" for n in (8, 6, 4, 2) for x in "pr"])


def current_rates(history: DataFrame) -> DataFrame:
    """Open interval of each chapter; of several the one that starts last."""
    return first_per(history.filter("effective_to is null"), "chapter", F.desc("effective_from"), "gst_rate")


def rate_as_of(df: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """df plus gst_rate valid at its date: an equi join on chapter, then the interval. Empty intervals never match."""
    spans = history.filter("effective_to is null or effective_from < effective_to")
    hit = (C(at) >= C("effective_from")) & (C("effective_to").isNull() | (C(at) < C("effective_to")))
    return df.join(spans, "chapter").filter(hit)


def apply_amendments(df: DataFrame, amendments: DataFrame, code: str = "hsn_code", hops: int = 1) -> DataFrame:
    """df plus new_code and amended; one hop by default. The amendment table is a short fixed list."""
    out = df.withColumn("new_code", C(code))
    for _ in range(hops):
        step = F.broadcast(amendments.select(C("old").alias("new_code"), C("new").alias("__to")))
        out = out.join(step, "new_code", "left").withColumn("new_code", F.coalesce("__to", "new_code")).drop("__to")
    return out.withColumn("amended", ~C("new_code").eqNullSafe(C(code)))


def brand_mode(catalog: DataFrame) -> DataFrame:
    """(brand, code, n): most frequent code of each brand, placeholders left out."""
    n = catalog.filter(~codes.is_unclassified(C("raw_code"))).groupBy("brand", codes.canonicalize_hsn(C("raw_code")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return first_per(n, "brand", F.desc("n"), "code")


def match_brand(queries: DataFrame, brands: DataFrame, goods: DataFrame, services: DataFrame) -> DataFrame:
    """(query_id, code, description, rate): brand equals the text; goods or service text; a service's rate wins; highest rate first."""
    hits = brands.select(F.upper("brand").alias("brand"), "code", C("gst_rate").alias("brand_rate"))
    hits = hits.join(goods.select(C("hsn_code").alias("code"), C("description").alias("goods_text")), "code", "left").join(services.select(C("sac_code").alias("code"), C("description").alias("service_text"), C("gst_rate").alias("service_rate")), "code", "left")
    sac = codes.is_service(C("code"))
    rated = hits.select("brand", "code", F.when(sac, C("service_text")).otherwise(C("goods_text")).alias("description"), F.when(sac, F.coalesce("service_rate", "brand_rate")).otherwise(C("brand_rate")).alias("rate"))
    order = (F.desc_nulls_last("rate"), "code", "description")
    # a brand's first row answers all its queries
    asked = queries.select("query_id", F.upper(F.trim("text")).alias("brand"))
    return first_per(asked.join(first_per(rated, "brand", *order), "brand"), "query_id", *order).drop("brand")


def language_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """match_language_alias plus pos (0 for the brand word, 1 for the first two) and weight."""
    name = text.strip_sizes(C("text"))
    keys = queries.select("query_id", F.posexplode(F.array(text.brand_token(C("text")), F.array_join(F.slice(F.split(name, " "), 1, 2), " "))).alias("pos", "term")).filter("term <> ''")
    best = first_per(keys.join(aliases, "term"), "query_id", "pos", F.desc("weight"), "code")
    return best.select("query_id", "code", F.least(F.lit(1.0), C("weight") / 2).alias("score"), "pos", "weight")


def match_language_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, code, score): alias by the brand word, else by the first two words; score half the weight, 1 at most."""
    return language_aliases(queries, aliases).select("query_id", "code", "score")


def brand_guard(df: DataFrame, commodity: list[str]) -> DataFrame:
    """df (text) plus skip (a lone commodity word is no brand; scripts and romanized text go elsewhere) and floor (higher for short words)."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda w: w != "")
    lone = (F.size(words) == 1) & F.array_contains(text.word_list(commodity), F.get(words, F.lit(0)))
    return df.withColumn("skip", lone | text.detect_language(C("text")).isin("ml", "ml-roman")).withColumn("floor", F.when(F.length(text.brand_token(C("text"))) < 4, 0.75).otherwise(0.55))


def match_keyword(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword, code): the longest keyword (keyword, code, priority) inside the text, then by priority; case does not count.

    Distinct texts are read once; equal ones share the answer. A query of several texts gets the best of theirs.
    """
    order = (F.desc(F.length("keyword")), F.desc("priority"), "keyword", "code")
    best = first_per(containing(queries.select("text").distinct(), C("text"), keywords, F.upper), "text", *order)
    return first_per(queries.select("query_id", "text").join(best, "text"), "query_id", *order).select("query_id", "keyword", "code")


def match_category_keyword(queries: DataFrame, catalog: DataFrame, keywords: list[str]) -> DataFrame:
    """(query_id, keyword, code): the first listed keyword in the text gives the most frequent code of catalog rows that hold it."""
    spark = queries.sparkSession
    listed = spark.createDataFrame(list(enumerate(dict.fromkeys(keywords))), "place int, keyword string")
    held = containing(catalog.groupBy(F.lower("description").alias("low"), "raw_code").agg(F.count(F.lit(1)).alias("rows")), C("low"), listed)
    n = held.groupBy("keyword", codes.canonicalize_hsn(C("raw_code")).alias("code")).agg(F.sum("rows").alias("n"))
    modes = first_per(n, "keyword", F.desc("n"), "code").select("keyword", "code")
    first = first_per(containing(queries.select("text").distinct(), C("text"), listed), "text", "place").select("text", "keyword")
    return queries.select("query_id", "text").join(first.join(modes, "keyword"), "text").select("query_id", "keyword", "code")


def openings(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """df plus key: the beginnings of its column with the lengths that occur in keys (one number per length is gathered)."""
    sizes = keys.agg(F.collect_set(F.length(key)).alias("__sizes"))
    fits = F.filter("__sizes", lambda n: n <= F.length(column))
    return df.join(F.broadcast(sizes)).withColumn("__n", F.explode(fits)).withColumn(key, F.substring(C(column), F.lit(1), C("__n"))).drop("__sizes", "__n")


def match_prefix(queries: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """Catalog texts that start with the query (three letters or more): equi join on the whole beginning; shortest first."""
    q = queries.select("query_id", F.upper(F.trim("text")).alias("start")).filter("length(start) >= 3")
    # equal beginnings are asked once; of equal texts the k first rows are enough
    starts = q.select("start").distinct()
    few = top_per(catalog.select("id", "raw_code", "description"), "description", k, "id", rank="__k").drop("__k")
    best = top_per(starts.join(openings(few, "description", starts, "start"), "start"), "start", k, F.length("description"), "id")
    return q.join(best, "start").select("query_id", "id", "raw_code", "description", "rank")


def match_regional_alias(queries: DataFrame, aliases: DataFrame, blocked: list[str]) -> DataFrame:
    """(query_id, alias, code): exact, else an alias that opens the text, longest first; aliases from 10 letters also by their first 8. Blocked lone words never match."""
    q = queries.select("query_id", text.squeeze(F.lower("text")).alias("said")).filter(~C("said").isin(blocked) & (F.length("said") >= 3))
    starts = F.when(F.length("alias") >= 10, F.array("alias", F.substring("alias", 1, 8))).otherwise(F.array("alias"))
    refs = aliases.filter("length(alias) >= 3").select("alias", "code", F.explode(starts).alias("start"))
    hits = openings(q, "said", refs, "start").join(refs, "start")
    return first_per(hits, "query_id", F.desc(C("said") == C("alias")), F.desc(F.length("alias")), "alias").select("query_id", "alias", "code")


def match_model_code(queries: DataFrame, catalog: DataFrame, pattern: str = r"\b(\d{2,5}[A-Z])\b") -> DataFrame:
    """(query_id, id): the same model code in both texts; smallest id of each query."""
    codes_of = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(pattern), F.lit(1))))
    refs = catalog.select("id", codes_of("description").alias("model")).groupBy("model").agg(F.min("id").alias("id"))
    return queries.select("query_id", codes_of("text").alias("model")).join(refs, "model").groupBy("query_id").agg(F.min("id").alias("id"))


def stale_codes(existing: DataFrame, target: DataFrame) -> DataFrame:
    """Active codes that the new master lacks and that look like padding."""
    return existing.join(target.select("hsn_code").distinct(), "hsn_code", "left_anti").filter(codes.is_placeholder(C("hsn_code")))


def category_counts(taxonomy: DataFrame, tariff: DataFrame) -> DataFrame:
    """Taxonomy rows (name, first, last chapter) with the number of codes in their chapters, zero filled."""
    n = tariff.groupBy(F.substring("hsn_code", 1, 2).cast("int").alias("chapter")).agg(F.count_distinct("hsn_code").alias("n"))
    listed = taxonomy.select("name", "display_order", F.explode(F.sequence("first_chapter", "last_chapter")).alias("chapter"))
    return listed.join(n, "chapter", "left").groupBy("name", "display_order").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("codes"))


def match_food_hint(queries: DataFrame, hints: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """The longest hint inside the text gives words; catalog rows that hold all of up to three of them."""
    order = (F.desc(F.length("keyword")), "keyword", "words")
    listed = hints.select(C("hint").alias("keyword"), "words")
    found = first_per(containing(queries.select("text").distinct(), C("text"), listed), "text", *order)
    asked = first_per(queries.select("query_id", "text").join(found, "text"), "query_id", *order).select("query_id", "words")
    # rows are sought once for each list of words
    first = F.array_distinct(F.slice(F.split("words", " "), 1, 3))
    words = hints.select("words").distinct().select("words", F.explode(first).alias("word"), F.size(first).alias("need"))
    held = catalog.select("id", F.explode(F.array_distinct(F.split(F.lower("description"), " "))).alias("word"))
    hits = words.join(held, "word").groupBy("words", "id", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    return asked.join(top_per(hits, "words", k, "id"), "words").select("query_id", "id", "rank")


def words_inside(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, word, d): the distinct lower-case texts d (column d) that hold a word of asked (text, word)."""
    pairs = contained(texts.select(C("d").alias("text")), asked.select(C("word").alias("keyword"))).select(C("text").alias("d"), C("keyword").alias("word"))
    return asked.select("text", "word").distinct().join(pairs, "word").select("text", "word", "d")


def coverages(queries: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """(text, key, n, coverage) of each distinct text: n of its words of three letters or more stand inside the row's text.

    Substring semantics: distinct words meet distinct texts once, in one automaton.
    """
    words = queries.select("text").distinct().select("text", F.explode(F.array_distinct(text.tokenize(C("text")))).alias("word")).filter("length(word) >= 3")
    words_of = words.groupBy("text").agg(F.count(F.lit(1)).alias("words"))
    rows = reference.select(key, F.lower("description").alias("d"))
    hits = words_inside(words, rows).groupBy("text", "d").agg(F.count(F.lit(1)).alias("n")).join(words_of, "text")
    return hits.join(rows, "d").select("text", key, "n", (C("n") / C("words")).alias("coverage"))


def token_contains(queries: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """(query_id, key, coverage): share of the query's words of three letters or more that stand inside the text, for rows with one at least."""
    return queries.select("query_id", "text").join(coverages(queries, reference, key), "text").select("query_id", key, "coverage")


def most_contained(queries: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """(query_id, key, coverage): of token_contains the first row of each query by coverage, then key."""
    best = first_per(coverages(queries, reference, key), "text", F.desc("coverage"), key)
    return queries.select("query_id", "text").join(best, "text").select("query_id", key, "coverage")


def match_words(queries: DataFrame, reference: DataFrame, mode: str, k: int, key: str = "id", synonyms: dict = fixed.SYNONYMS) -> DataFrame:
    """(query_id, key, rank): rows whose text holds words of the query of three letters or more, shortest text first.

    "all": all of them. "most": of two or more the longest 60 %, rounded, at least one; of equally long ones those that come first. "one": the longest;
    if no row holds it, the first of up to three of its synonyms that some row holds.
    """
    listed = F.filter(F.array_distinct(text.tokenize(C("text"))), lambda w: F.length(w) >= 3)
    places = F.transform(listed, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    asked = queries.select("text").distinct().select("text", F.sort_array(places)["w"].alias("w")).filter("size(w) > 0")
    rows = reference.select(key, F.lower("description").alias("d"), F.length("description").alias("size"))
    # the k first rows are rows of the k texts that come first by their least key, and at most k rows of each
    few = top_per(rows, ["d", "size"], k, key, rank="__k").drop("__k")
    firsts = few.groupBy("d", "size").agg(F.min(key).alias("__key"))
    if mode == "one":
        others = F.filter(F.slice(text.expand_synonyms(F.slice("w", 1, 1), synonyms), 2, 1000), lambda s: (F.length(s) >= 3) & ~F.contains(s, F.lit(" ")))
        asked = asked.select("text", F.posexplode(F.array_distinct(F.concat(F.slice("w", 1, 1), F.slice(others, 1, 3)))).alias("place", "word"))
        # each word's k first texts are found once for all the texts that ask it
        pairs = words_inside(asked.select(C("word").alias("text"), "word"), rows).select("word", "d").join(firsts, "d")
        pairs = top_per(pairs, "word", k, "size", "__key", rank="__k").select("word", "d", "size", "__key")
        texts = asked.join(pairs, "word")
        least = texts.groupBy("text").agg(F.min("place").alias("place"))
        texts = texts.join(least, ["text", "place"]).select("text", "d", "size", "__key")
    else:
        if mode == "most":
            asked = asked.filter("size(w) >= 2").select("text", F.slice("w", F.lit(1), F.greatest(F.lit(1), F.round(F.size("w") * 0.6).cast("int"))).alias("w"))
        need = asked.select("text", F.size("w").alias("need"))
        hits = words_inside(asked.select("text", F.explode("w").alias("word")), rows).groupBy("text", "d").agg(F.count(F.lit(1)).alias("n"))
        texts = hits.join(need, "text").filter("n = need").select("text", "d").join(firsts, "d")
    texts = top_per(texts, "text", k, "size", "__key", rank="__k").select("text", "d", "size")
    best = top_per(texts.join(few, ["d", "size"]), "text", k, "size", key)
    return queries.select("query_id", "text").join(best, "text").select("query_id", key, "rank")
