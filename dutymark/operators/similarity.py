"""Ranked retrieval: trigram joins without loss, full text, vectors, and the scores on top of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dutymark.functions import fixed, sound, text
from dutymark.operators import ratios, vectors, wordsearch
from dutymark.operators.containment import contained
from dutymark.operators.lookups import code_prefixes, first_per, top_per

C = F.col


def trgm_pairs(left: DataFrame, right: DataFrame, min_sim: float) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct texts (columns a, b) with similarity of at least min_sim, over 0.

    Exact prefix filter: with grams in one order, rarest first, two sets that similar share a gram among the first
    n - ceil(min_sim * n) + 1 of each. Common grams come last, so that the join keys are rare ones.
    """
    one = left.select("a").distinct().withColumn("ga", text.trigrams(C("a")))
    two = right.select("b").distinct().withColumn("gb", text.trigrams(C("b")))
    seen = one.select(F.explode("ga").alias("g")).union(two.select(F.explode("gb").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(df: DataFrame, key: str, grams: str) -> DataFrame:
        listed = df.select(key, F.explode(grams).alias("g")).join(seen, "g").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
        take = F.size("o") - F.ceil(F.lit(min_sim) * F.size("o") - 1e-9) + 1
        return listed.select(key, F.size("o").alias(f"n{key}"), F.explode(F.slice("o", F.lit(1), F.least(take.cast("int"), F.size("o")))["g"]).alias("g"))

    p, q = prefixes(one, "a", "ga"), prefixes(two, "b", "gb")
    fits = (C("na") >= min_sim * C("nb") - 1e-9) & (C("nb") >= min_sim * C("na") - 1e-9)
    pairs = p.join(q, "g").filter(fits).select("a", "b").distinct()
    scored = pairs.join(one, "a").join(two, "b").select("a", "b", text.set_similarity(C("ga"), C("gb")).alias("similarity"))
    return scored.filter((C("similarity") >= min_sim) & (C("similarity") > 0))


def trgm_topk(queries: DataFrame, reference: DataFrame, min_sim: float, k: int, strict: bool = True, key: str = "id", column: str = "description") -> DataFrame:
    """(query_id, key, similarity, rank): the k most similar rows of each query; strict: similarity over min_sim, else equal too. Equal texts are compared once."""
    pairs = trgm_pairs(queries.select(C("text").alias("a")), reference.select(C(column).alias("b")), min_sim)
    if strict:
        pairs = pairs.filter(C("similarity") > min_sim)
    refs = reference.select(C(column).alias("b"), key)
    # the k best of a text need at most k rows of each equal text
    few = top_per(refs, "b", k, key, rank="__k").drop("__k")
    # and the k best rows are rows of the k texts that come first by their least key
    firsts = few.groupBy("b").agg(F.min(key).alias("__key"))
    texts = top_per(pairs.join(firsts, "b"), "a", k, F.desc("similarity"), "__key", rank="__k").drop("__k", "__key")
    best = top_per(texts.join(few, "b"), "a", k, F.desc("similarity"), key)
    return queries.select("query_id", C("text").alias("a")).join(best, "a").select("query_id", key, F.round("similarity", 9).alias("similarity"), "rank")


def trgm_topk_codes(queries: DataFrame, tariff: DataFrame, min_sim: float, k: int) -> DataFrame:
    """(query_id, hsn_code, similarity, rank): the k codes of each query whose most similar text is the most similar, over min_sim. Codes may have several rows; equal texts are compared once."""
    pairs = trgm_pairs(queries.select(C("text").alias("a")), tariff.select(C("description").alias("b")), min_sim).filter(C("similarity") > min_sim)
    # of a text's codes, which share its similarity, the k first are enough
    few = top_per(tariff.select(C("description").alias("b"), "hsn_code").distinct(), "b", k, "hsn_code", rank="__k").drop("__k")
    hits = pairs.join(few, "b").groupBy("a", "hsn_code").agg(F.max("similarity").alias("similarity"))
    best = top_per(hits, "a", k, F.desc("similarity"), "hsn_code")
    return queries.select("query_id", C("text").alias("a")).join(best, "a").select("query_id", "hsn_code", F.round("similarity", 9).alias("similarity"), "rank")


def match_product_name(queries: DataFrame, catalog: DataFrame, min_sim: float = 0.28) -> DataFrame:
    """(query_id, id, similarity): whole text and words from 3 letters as terms; the best row must share a word with the text."""
    words = F.filter(F.split("said", r"\s+"), lambda w: F.length(w) >= 3)
    said = queries.select("query_id", F.lower("text").alias("said"))
    terms = said.select("said").distinct().select("said", F.explode(F.array_distinct(F.concat(F.array("said"), words))).alias("term"), F.array_distinct(words).alias("words"))
    pairs = trgm_pairs(terms.select(C("term").alias("a")), catalog.select(F.lower("description").alias("b")), min_sim).filter(C("similarity") > min_sim)
    rows = catalog.groupBy(F.lower("description").alias("b")).agg(F.min("id").alias("id"))
    # a term needs one row for each word that it is asked with: the best that holds the word
    asked = terms.select("said", "term", F.explode("words").alias("word"))
    held = pairs.join(rows, "b").select(C("a").alias("term"), "id", "similarity", F.explode(F.array_distinct(F.split("b", r"\s+"))).alias("word"))
    few = first_per(held.join(asked.select("term", "word").distinct(), ["term", "word"]), ["term", "word"], F.desc("similarity"), "id")
    best = first_per(asked.join(few, ["term", "word"]), "said", F.desc("similarity"), "id").select("said", "id", "similarity")
    return first_per(said.join(best, "said"), "query_id", F.desc("similarity"), "id").select("query_id", "id", F.round("similarity", 9).alias("similarity"))


def match_verified(queries: DataFrame, catalog: DataFrame, k: int, min_sim: float = 0.35) -> DataFrame:
    """(query_id, id, score, rank): exact text 1, same text without sizes 0.94, else the greater similarity of both forms."""
    asked = queries.select(C("text").alias("said")).distinct()
    q = asked.select(C("said").alias("query_id"), text.text_key(C("said")).alias("text"), text.strip_sizes(C("said")).alias("bare"))
    c = catalog.select("id", text.text_key(C("description")).alias("description"), text.strip_sizes(C("description")).alias("bare"))
    # of rows with one text or bare text, and so one score, the k first are enough
    few = lambda column: top_per(c.select("id", column), column, k, "id")
    exact = q.join(few("description"), C("text") == C("description")).select("query_id", "id", F.lit(1.0).alias("score"))
    same = q.select("query_id", "bare").join(few("bare"), "bare").select("query_id", "id", F.lit(0.94).alias("score"))
    near = [trgm_topk(q.select("query_id", C(x).alias("text")), c.select("id", C(y).alias("description")), min_sim, k).select("query_id", "id", C("similarity").alias("score")) for x, y in (("text", "description"), ("bare", "bare"))]
    every = exact.unionByName(same).unionByName(near[0]).unionByName(near[1]).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = top_per(every, "query_id", k, F.desc("score"), "id").withColumnRenamed("query_id", "said")
    return queries.select("query_id", C("text").alias("said")).join(best, "said").select("query_id", "id", "score", "rank")


def union_similarity(queries: DataFrame, catalog: DataFrame, tariff: DataFrame, k: int = 5, min_sim: float = 0.3) -> DataFrame:
    """Similar rows of catalog and tariff together, k of each query."""
    refs = catalog.select(F.concat(F.lit("c"), "id").alias("id"), "description").unionByName(tariff.groupBy("hsn_code").agg(F.min("description").alias("description")).select(F.concat(F.lit("t"), "hsn_code").alias("id"), "description"))
    return trgm_topk(queries, refs, min_sim, k)


def match_curated(queries: DataFrame, goods: DataFrame, min_sim: float = 0.38) -> DataFrame:
    """(query_id, id, similarity, confidence): by scope order, then similarity; confidence 80 above 0.5, else 65 at least."""
    scope = F.when(C("scope") == "exact", 0).when(C("scope") == "heading", 1).otherwise(2)
    # of rows with one text the first by scope stands for all: their similarity is the same
    rows = first_per(goods.select(C("description").alias("b"), "id", scope.alias("scope")), "b", "scope", "id")
    pairs = trgm_pairs(queries.select(C("text").alias("a")), rows, min_sim).filter(C("similarity") > min_sim)
    hits = pairs.withColumn("similarity", F.round("similarity", 9)).join(rows, "b")
    best = queries.select("query_id", C("text").alias("a")).join(first_per(hits, "a", "scope", F.desc("similarity"), "id"), "a")
    return best.select("query_id", "id", "similarity", F.when(C("similarity") > 0.5, 80).otherwise(F.greatest(F.lit(65), F.floor(C("similarity") * 100))).cast("int").alias("confidence"))


def match_tariff(queries: DataFrame, tariff: DataFrame, catalog: DataFrame, min_sim: float = 0.32, k: int = 5) -> DataFrame:
    """(query_id, hsn_code, volume, similarity, confidence, rank): by catalog rows of the code first, then the similarity of its most similar text."""
    volume = catalog.groupBy(C("hsn_code")).agg(F.count(F.lit(1)).alias("volume"))
    own = tariff.select("hsn_code", C("description").alias("b")).filter("b is not null").distinct().join(volume, "hsn_code", "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    # of a text's codes, which share its similarity, the k first are enough
    few = top_per(own, "b", k, F.desc("volume"), "hsn_code", rank="__k").drop("__k")
    pairs = trgm_pairs(queries.select(C("text").alias("a")), few.select("b"), min_sim).filter(C("similarity") > min_sim)
    hits = pairs.join(few, "b").groupBy("a", "hsn_code", "volume").agg(F.max("similarity").alias("similarity"))
    best = top_per(hits, "a", k, F.desc("volume"), F.desc("similarity"), "hsn_code")
    ranked = queries.select("query_id", C("text").alias("a")).join(best, "a")
    return ranked.select("query_id", "hsn_code", "volume", F.round("similarity", 9).alias("similarity"), F.least(F.lit(75), F.greatest(F.lit(55), F.floor(C("similarity") * 100))).cast("int").alias("confidence"), "rank")


def fts_search(queries: DataFrame, reference: DataFrame, weights: dict[str, float], k: int, op: str = "or", prefix_last: bool = True, key: str = "id") -> DataFrame:
    """(query_id, key, score, rank): words of the query against words of the weighted columns.

    The rank is the sum of the greatest weight of each word found, squashed as s / (1 + s). The first 8 words
    count, the last one also as a prefix; op="and" wants all of them. Distinct lists of words are asked once.
    """
    words = F.slice(wordsearch.plain_words(C("text")), 1, 8)
    q = queries.select("query_id", words.alias("words")).filter("size(words) > 0").withColumn("ask", F.array_join("words", " "))
    asked = q.select("ask", F.transform("words", lambda w: F.array(w)).alias("places")).dropDuplicates(["ask"]).withColumn("prefixes", F.array().cast("array<string>"))
    found = wordsearch.best_rows(asked, wordsearch.indexed(reference, weights, key), k, op, prefix_last, reference.schema[key].dataType.simpleString())
    best = top_per(found, "ask", k, F.desc("score"), "key")
    return q.select("query_id", "ask").join(best, "ask").select("query_id", C("key").alias(key), "score", "rank")


def weighted_search(queries: DataFrame, reference: DataFrame, k: int = 20, chapters: DataFrame | None = None, key: str = "hsn_code", synonyms: dict = fixed.SYNONYMS, mode: str = "both") -> DataFrame:
    """(query_id, key, score, whole, rank): the first six words of the query against description (weight 1) and category (0.4).

    A word may be met by one of its synonyms; the last place, with its synonyms, also by words that it begins. chapters (query_id, chapters:
    array) keeps keys with such beginnings; queries without a row there, or with none of two digits, keep all. Rows that meet all places
    come first: only if a query has none are those with any place taken (mode "both"; "and", "or": only these). The k best by rank are
    scored: 2.8 * rank + 0.08 for each common word (0.35 at most) + 0.16, 0.96 at most.
    """
    words = F.slice(F.array_distinct(text.tokenize(C("text"))), 1, 8)
    usable = lambda w: (F.length(w) >= 3) & ~F.contains(w, F.lit(" "))
    letters = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    others = lambda w: F.transform(F.filter(F.slice(text.expand_synonyms(F.array(w), synonyms), 2, 1000), usable), letters)
    places = F.transform(F.slice("words", 1, 6), lambda w: F.filter(F.array_distinct(F.concat(F.array(w), others(w))), lambda v: F.length(v) >= 2))
    q = queries.select("query_id", words.alias("words")).filter("size(words) > 0")
    if chapters is None:
        q = q.withColumn("prefixes", F.array().cast("array<string>"))
    else:
        clean = F.array_sort(F.array_distinct(F.filter(F.transform("chapters", lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda p: F.length(p) >= 2)))
        q = q.join(chapters.select("query_id", clean.alias("prefixes")), "query_id", "left").withColumn("prefixes", F.coalesce("prefixes", F.array().cast("array<string>")))
    q = q.withColumn("ask", F.concat_ws("|", F.array_join("words", " "), F.array_join("prefixes", " ")))
    asked = q.dropDuplicates(["ask"]).select("ask", places.alias("places"), "prefixes")
    one = reference.groupBy(key).agg(F.min("description").alias("description"), F.min("category").alias("category"))
    found = wordsearch.best_rows(asked, wordsearch.indexed(one, {"description": 1.0, "category": 0.4}, key), k, mode, True, reference.schema[key].dataType.simpleString())
    if mode == "both":
        any_whole = F.max(C("whole").cast("int")).over(Window.partitionBy("ask"))
        found = found.withColumn("w", any_whole).filter((C("w") == 0) | C("whole")).drop("w")
    best = top_per(found, "ask", k, F.desc("score"), "key").withColumnRenamed("score", "r")
    shown = best.join(one.select(C(key).alias("key"), F.array_distinct(text.tokenize(C("description"))).alias("d")), "key").join(q.select("ask", "words").dropDuplicates(["ask"]), "ask")
    common = F.size(F.array_intersect("words", "d"))
    score = F.round(F.least(F.lit(0.96), C("r") * 2.8 + F.least(F.lit(0.35), common * 0.08) + 0.16), 3)
    return q.select("query_id", "ask").join(shown.select("ask", "key", score.alias("score"), "whole", "rank"), "ask").select("query_id", C("key").alias(key), "score", "whole", "rank")


def token_set_topk(queries: DataFrame, names: DataFrame, k: int, cutoff: float = 60.0) -> DataFrame:
    """(query_id, id, ratio, rank): the names with the best token-set ratio of the text or one of its tokens.

    Tokens have three letters or more, sizes left out. Distinct terms meet distinct names, which stand for their least id.
    The k best names of a text are among the k best of its terms.
    """
    q = queries.select("query_id", text.squeeze(F.lower("text")).alias("a"))
    terms = q.select("a").distinct().filter("a <> ''").select("a", F.explode(F.array_distinct(F.concat(F.array("a"), text.name_tokens(C("a"))))).alias("term"))
    own = names.groupBy(text.squeeze(F.lower("description")).alias("name")).agg(F.min("id").alias("name_id")).filter("name <> ''")
    near = top_per(ratios.nearest_names(terms.select("term").distinct(), own, k, cutoff), "term", k, F.desc("ratio"), "name_id").drop("rank")
    best = terms.join(near, "term").groupBy("a", C("name_id").alias("id")).agg(F.max("ratio").alias("ratio"))
    return q.join(top_per(best, "a", k, F.desc("ratio"), "id"), "a").select("query_id", "id", "ratio", "rank")


def match_brand_type(queries: DataFrame, catalog: DataFrame, floor: float = 0.35) -> DataFrame:
    """(query_id, id, score): of the names that open with the text's first token the best by 0.6 of the share of the other tokens that
    the name holds and 0.4 of the token-set ratio. Texts under two tokens have none."""
    q = queries.select("query_id", text.squeeze(F.lower("text")).alias("term"))
    asked = q.select("term").distinct().filter("term is not null").withColumn("tokens", text.name_tokens(C("term")))
    own = catalog.groupBy(text.squeeze(F.lower("description")).alias("name")).agg(F.min("id").alias("name_id")).filter("name <> ''")
    best = first_per(ratios.brand_names(asked, own, floor), "term", F.desc("score"), "name_id")
    return q.join(best, "term").select("query_id", C("name_id").alias("id"), "score")


def match_extracted_keyword(queries: DataFrame, goods: DataFrame, min_sim: float = 0.25) -> DataFrame:
    """(query_id, id, similarity, confidence): the product words of the text against curated rows; 82, 75, 68 or 60 by similarity."""
    words = text.let(text.expand_pos(text.fix_typos(C("text"))), lambda t: F.array_join(text.product_keywords(t), " "))
    # equal texts are taken apart once
    asked = queries.select("text").distinct().select(C("text").alias("query_id"), words.alias("text")).filter("text <> ''")
    best = trgm_topk(asked, goods, min_sim, 1).withColumnRenamed("query_id", "text")
    s = C("similarity")
    return queries.select("query_id", "text").join(best, "text").select("query_id", "id", "similarity", F.when(s >= 0.7, 82).when(s >= 0.5, 75).when(s >= 0.35, 68).otherwise(60).alias("confidence"))


def expansions(queries: DataFrame, aliases: DataFrame, synonyms: dict = fixed.SYNONYMS, per_word: int = 4, most: int = 12, hints: int = 8) -> DataFrame:
    """(query_id, expanded, codes): up to `per_word` English terms of each word's exact aliases and 3 synonyms, `most` in all; codes of the aliases."""
    words = queries.select("query_id", F.posexplode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    known = top_per(aliases, "term", per_word, F.desc("weight"), "english", rank="r").select(C("term").alias("word"), "english", "code", "r")
    others = text.expand_synonyms(F.array("word"), synonyms)
    more = words.select("query_id", "pos", F.posexplode(F.slice(others, 2, 3)).alias("r", "english")).select("query_id", "pos", (C("r") + 100).alias("r"), "english", F.lit(None).cast("string").alias("code"))
    every = words.join(known, "word").select("query_id", "pos", "r", "english", "code").unionByName(more)
    g = every.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "english", "code"))).alias("o"))
    return g.select("query_id", F.slice(F.array_distinct(C("o.english")), 1, most).alias("expanded"), F.slice(F.array_distinct(F.array_compact(C("o.code"))), 1, hints).alias("codes"))


def vector_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): greatest inner products of normed vectors, exact; queries and rows meet in blocks, k rows for each query and cell are shuffled."""
    return top_per(vectors.nearest(queries, docs, k), "query_id", k, F.desc("score"), "vec_id")


def vector_index_topk(queries: DataFrame, docs: DataFrame, k: int, probes: int | None = None, centroids: int | None = None) -> DataFrame:
    """vector_topk through a clustered index: near all of the best rows, from the cells of the nearest centroids; by default as many as a sample of the rows needs for a recall of 0.95."""
    found = vectors.VectorIndex.build(docs, centroids).search(queries, k, probes)
    return top_per(found, "query_id", k, F.desc("score"), "vec_id")


def merge_pools(cands: DataFrame, hints: DataFrame) -> DataFrame:
    """(query_id, hsn_code, method, score, rank): best row per code after layer bonus and 0.07 for a hinted code or prefix."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fixed.LAYER_BONUS.items())), C("method")), F.lit(0.0))
    hinted = F.exists(F.coalesce("codes", F.array().cast("array<string>")), lambda h: F.startswith("hsn_code", h))
    scored = cands.filter("hsn_code <> ''").join(hints, "query_id", "left").withColumn("adjusted", C("score") + bonus + F.when(hinted, 0.07).otherwise(0.0))
    best = first_per(scored, ["query_id", "hsn_code"], F.desc("adjusted"), "method")
    out = best.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), C("adjusted"))), 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "hsn_code")
    return out.withColumn("rank", F.row_number().over(w)).select("query_id", "hsn_code", "method", "score", "rank")


def rerank(cands: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, query, hsn_code, description, source, score, embedding, brand, chapters) by ten weighted features; ties keep the old rank."""
    q, d = F.upper("query"), F.upper("description")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Z]{3,})"), F.lit(1)))
    both = F.size(F.array_intersect(words(q), words(d)))
    nq, nd = F.size(words(q)), F.size(words(d))
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    source = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(s), F.lit(v)) for s, v in fixed.SOURCE_PRIORITY.items())), C("source")), F.lit(0.5))
    chapter = F.when(F.array_contains("chapters", F.substring("hsn_code", 1, 2)), 1.0).otherwise(0.0)
    in_q, in_d = F.contains(q, F.upper("brand")), F.contains(d, F.upper("brand"))
    brand = F.when(C("brand").isNull(), 0.0).when(in_q & in_d, 1.0).when(in_q, 0.2).otherwise(0.5)
    total = (
        C("embedding") * 0.30 + ratio(both, nq + nd - both) * 0.20 + ratio(both, nq) * 0.15 + ratio(both, nd) * 0.05
        + F.least(F.length(q), F.length(d)) / F.greatest(F.length(q), F.length(d), F.lit(1)) * 0.02 + F.coalesce(chapter, F.lit(0.0)) * 0.10
        + source * 0.05 + C("score") * 0.08 + F.least(F.length(d) / 100.0, F.lit(1.0)) * 0.03 + brand * 0.02
    )
    scored = cands.withColumn("reranked", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 9))
    return top_per(scored, "query_id", k, F.desc("reranked"), "old_rank", "hsn_code", rank="new_rank").select("query_id", "hsn_code", "reranked", "new_rank")


def lexical_score(cands: DataFrame, prefixes: DataFrame | None = None, domains: tuple[str, ...] = (), synonyms: dict = fixed.SYNONYMS) -> DataFrame:
    """(query_id, id, lexical): words weighted by rarity among the candidates of their own query, 0.74 of that and 0.26 of the base score.

    Candidates are (query_id, query, id, hsn_code, description, category, base). A product word of the query weighs its rarity, 0.25 more from
    five letters on and 0.35 more among `domains`; it counts whole in the text, 0.75 in the category, 0.55 by a synonym in either. A brand
    weighs 2.8 and its rarity and counts 1.25 if the text names it; a text with other brands only loses 0.16. A phrase of up to four words adds
    0.12, else all of the first three 0.06. Where `prefixes` (query_id, prefixes) has code beginnings for the query, a code under one adds
    0.08, any other code loses 0.06. Queries without words keep the base score.
    """
    kept = text.word_list(fixed.BRANDS)
    words = C("f.product_tokens")
    base = cands.select(
        "query_id", "id", "base", "hsn_code", text.query_fields(C("query")).alias("f"), F.array_distinct(text.tokenize(C("description"))).alias("d"),
        F.filter(F.array_distinct(text.tokenize(C("description"), True)), lambda t: F.array_contains(kept, t)).alias("named"),
        F.array_distinct(text.tokenize(C("category"))).alias("c"), F.lower("description").alias("low"),
    ).withColumn("held", F.array_union(F.array_union("d", "c"), C("named")))
    n = base.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = base.select("query_id", F.explode("held").alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("df"))
    asked = base.select("query_id", "id", "d", "c", "named", "held", F.explode("f.all_tokens").alias("word")).withColumn("brand", F.array_contains(kept, C("word")))
    asked = asked.join(n, "query_id").join(df, ["query_id", "word"], "left")
    rarity = F.log((C("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5)) + 1.0
    weight = rarity + F.when(C("brand"), 2.8).otherwise(F.when(F.length("word") >= 5, 0.25).otherwise(0.0) + F.when(C("word").isin(list(domains)), 0.35).otherwise(0.0))
    alike = F.arrays_overlap(text.expand_synonyms(F.array("word"), synonyms), C("held"))
    share = (
        F.when(C("brand"), F.when(F.array_contains("named", C("word")), 1.25).otherwise(0.0))
        .when(F.array_contains("d", C("word")), 1.0).when(F.array_contains("c", C("word")), 0.75).when(alike, 0.55).otherwise(0.0)
    )
    sums = asked.groupBy("query_id", "id").agg((F.sum(weight * share) / F.sum(weight)).alias("share"))
    clash = F.when((F.size("f.brand_tokens") > 0) & (F.size("named") > 0) & ~F.arrays_overlap("f.brand_tokens", "named"), 0.16).otherwise(0.0)
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    phrase = F.array_join(F.slice(long_words, 1, 4), " ")
    plus = F.when((phrase != "") & F.contains("low", phrase), 0.12).when((F.size(long_words) > 0) & (F.size(F.array_except(F.slice(long_words, 1, 3), "held")) == 0), 0.06).otherwise(0.0)
    out = base.join(sums, ["query_id", "id"], "left")
    chapter = F.lit(0.0)
    if prefixes is not None:
        out = out.join(prefixes.select("query_id", "prefixes"), "query_id", "left")
        under = F.exists("prefixes", lambda p: F.startswith("hsn_code", p))
        chapter = F.when((F.coalesce(F.size("prefixes"), F.lit(0)) <= 0) | (F.coalesce("hsn_code", F.lit("")) == ""), 0.0).when(under, 0.08).otherwise(-0.06)
    score = F.when(F.size("f.all_tokens") == 0, C("base")).otherwise((F.coalesce("share", F.lit(0.0)) - clash + plus + chapter) * 0.74 + F.greatest("base", F.lit(0.0)) * 0.26)
    return out.select("query_id", "id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 9).alias("lexical"))


def weighted_jaccard(tokens: Column, described: Column, synonyms: dict = fixed.SYNONYMS) -> Column:
    """Words of the query weigh 2, their synonyms 1, against the words of the text."""
    own = F.array_distinct(tokens)
    others = F.array_except(F.array_distinct(text.expand_synonyms(own, synonyms)), own)
    hit = 2 * F.size(F.array_intersect(own, described)) + F.size(F.array_intersect(others, described))
    total = 2 * F.size(own) + F.size(others) + F.size(F.array_distinct(described)) - hit
    return F.when(total > 0, hit / total).otherwise(0.0)


def intent_bonus(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df (id, text, description) plus bonus: sum over rules (query_word, text_word, delta) that apply, within 0.35 of 0."""
    words = df.select("id", F.array_distinct(text.tokenize(C("text"), True)).alias("q"), F.array_distinct(text.tokenize(C("description"), True)).alias("d"))
    hits = words.select("id", F.explode("q").alias("query_word"), "d").join(rules, "query_word").filter(F.array_contains("d", C("text_word")))
    sums = hits.groupBy("id").agg(F.round(F.sum("delta"), 6).alias("bonus"))
    return df.join(sums, "id", "left").withColumn("bonus", F.least(F.lit(0.35), F.greatest(F.lit(-0.35), F.coalesce("bonus", F.lit(0.0)))))


def calibrate(confidence: Column, words: Column, description: Column) -> Column:
    """Plus 0.05 if all words from 3 letters occur in the text, plus 0.02 from half of them on."""
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    share = F.size(F.filter(long_words, lambda w: F.contains(F.lower(description), F.lower(w)))) / F.greatest(F.size(long_words), F.lit(1))
    return F.least(F.lit(1.0), confidence + F.when((F.size(long_words) > 0) & (share >= 1), 0.05).when(share >= 0.5, 0.02).otherwise(0.0))


def rerank_overlap(cands: DataFrame, cap: float = 0.92) -> DataFrame:
    """Candidates (query_id, query, id, hsn_code, base, chapters): 0.22 of the word overlap, 0.04 for the chapter, 0.01 per other row with the same code."""
    q, d = F.array_distinct(text.tokenize(C("query"))), F.array_distinct(text.tokenize(C("description")))
    overlap = F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1))
    agree = F.count(F.lit(1)).over(Window.partitionBy("query_id", "hsn_code")) - 1
    chapter = F.when(F.array_contains("chapters", F.substring("hsn_code", 1, 2)), 0.04).otherwise(0.0)
    score = F.least(F.lit(cap), C("base") + 0.22 * overlap + F.coalesce(chapter, F.lit(0.0)) + 0.01 * agree)
    return cands.select("query_id", "id", "hsn_code", F.round(score, 9).alias("score"))


def hybrid_match(queries: DataFrame, dataset: DataFrame, k: int) -> DataFrame:
    """(query_id, hsn_code, score, support, rank): dataset rows (id, hsn_code, description, bonus) that share a word.

    0.68 of the query's words found, 0.20 of the text's words, 0.10 if the core word is there, plus the source bonus;
    equal text scores 0.95, the text inside the other 0.80 at least. Groups of a code rank by best score, then support.
    Distinct texts are asked once; rows without a code take no part.
    """
    asked = queries.select(C("text").alias("ask")).distinct().select("ask", text.text_key(C("ask")).alias("qk"), F.array_distinct(text.tokenize(C("ask"))).alias("q"), text.core_product(C("ask")).alias("core")).filter("ask is not null and size(q) > 0")
    rows = dataset.filter("hsn_code is not null").select("id", "hsn_code", C("bonus").cast("double").alias("bonus"), text.text_key(C("description")).alias("dk"), F.array_distinct(text.tokenize(C("description"))).alias("d")).filter("size(d) > 0")
    groups = wordsearch.code_scores(asked, rows, k).groupBy("ask", "hsn_code").agg(F.max("score").alias("score"), F.sum("support").alias("support"))
    best = top_per(groups, "ask", k, F.desc("score"), F.desc("support"), "hsn_code")
    return queries.select("query_id", C("text").alias("ask")).join(best, "ask").drop("ask")


def sound_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b, similarity) of distinct words (columns a, b) with one sound, metaphone or first double metaphone, and similarity of at least `floor`.

    Words without letters have no sound.
    """

    def keys(df: DataFrame, word: str) -> DataFrame:
        own = df.select(word).distinct().withColumn("s", sound.sound_keys(C(word)))
        # a key of either kind; the kind is part of it
        kinds = F.array(F.struct(F.lit("m").alias("kind"), C("s.metaphone").alias("key")), F.struct(F.lit("d").alias("kind"), C("s.first").alias("key")))
        return own.select(word, F.inline(kinds)).filter("key <> ''")

    alike = keys(left, "a").join(keys(right, "b"), ["kind", "key"]).select("a", "b").distinct()
    return alike.withColumn("similarity", text.trgm_similarity(C("a"), C("b"))).filter(C("similarity") >= floor)


def similar_terms(words: DataFrame, aliases: DataFrame, floor: float = 0.50, sound_floor: float = 0.40, most: int = 8) -> DataFrame:
    """(word, term, english, weight, similarity, same): for each distinct word the `most` alias rows of the greatest similarity, then weight.

    A row counts from similarity `floor` on, and from `sound_floor` on if it sounds alike. Words under three letters and fixed.UNRESOLVED
    words only have themselves as a term.
    """
    asked = words.select("word").distinct()
    open_ = asked.filter((F.length("word") >= 3) & ~C("word").isin(list(fixed.UNRESOLVED))).select(C("word").alias("a"))
    terms = aliases.select(C("term").alias("b"))
    pairs = trgm_pairs(open_, terms, floor).unionByName(sound_pairs(open_, terms, sound_floor)).unionByName(asked.select(C("word").alias("a")).join(terms.distinct(), C("a") == C("b")).select("a", "b", F.lit(1.0).alias("similarity")))
    best = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    hits = best.join(aliases, best["b"] == aliases["term"]).select(C("a").alias("word"), "term", "english", "weight", "similarity", (C("a") == C("b")).alias("same"))
    return top_per(hits, "word", most, F.desc("similarity"), F.desc("weight"), "english", rank="__r").drop("__r")


def search_by_language(queries: DataFrame, aliases: DataFrame, tariff: DataFrame, k: int, floor: float = 0.30) -> DataFrame:
    """(query_id, hsn_code, weight, rank): tariff rows whose code is or begins with the code of an alias; weight first, then the shorter code.

    An alias (alias, code, weight, language) counts if it is the query, holds it, or has a trigram similarity of `floor` or more, letters'
    case aside, and is of the query's language where queries have a column language. Empty queries and aliases without a code find nothing.
    """
    by_language = ["language"] if "language" in queries.columns else []
    asked = queries.select("query_id", text.squeeze(F.lower("text")).alias("said"), *by_language).filter("said <> ''")
    known = aliases.filter("alias <> '' and code <> ''").select(F.lower("alias").alias("known"), C("code").alias("prefix"), "weight", *by_language)
    said, terms = asked.select("said").distinct(), known.select("known").distinct()
    inside = contained(terms.select(C("known").alias("text")), said.select(C("said").alias("keyword"))).select(C("keyword").alias("said"), C("text").alias("known"))
    near = trgm_pairs(said.select(C("said").alias("a")), terms.select(C("known").alias("b")), floor).select(C("a").alias("said"), C("b").alias("known"))
    pairs = inside.union(near).distinct()
    found = asked.join(pairs, "said").join(known, ["known", *by_language]).groupBy("query_id", "prefix").agg(F.max("weight").alias("weight"))
    hits = found.join(code_prefixes(tariff.select("hsn_code").distinct()), "prefix").groupBy("query_id", "hsn_code").agg(F.max("weight").alias("weight"))
    return top_per(hits, "query_id", k, F.desc("weight"), F.length("hsn_code"), "hsn_code")


def expand_query(queries: DataFrame, aliases: DataFrame, floor: float = 0.50, sound_floor: float = 0.40) -> DataFrame:
    """(query_id, expanded): each word with an alias gives way to the English term: that of an equal term, else of the similar one (similar_terms)
    with the greatest weight times similarity."""
    words = queries.select("query_id", F.posexplode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    hits = similar_terms(words, aliases, floor, sound_floor)
    best = first_per(hits, "word", F.desc("same"), F.desc(C("weight") * C("similarity")), F.desc("similarity"), "english").select("word", "english")
    done = words.join(best, "word", "left").select("query_id", F.struct("pos", F.coalesce("english", "word").alias("word")).alias("s"))
    return done.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("s"))["word"], " ").alias("expanded"))
