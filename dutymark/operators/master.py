"""Building, merging and correcting the master tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dutymark.functions import codes, fixed, text
from dutymark.operators.containment import containing
from dutymark.operators.lookups import first_per, longest_prefix_join, top_per

C = F.col


def majority_rate(evidence: DataFrame) -> DataFrame:
    """(hsn_code, gst_rate): most frequent rate of a code if it has two votes or is the only one; the first seen (ord) on a tie."""
    votes = evidence.filter("gst_rate is not null").groupBy("hsn_code", "gst_rate").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("ord"))
    kinds = F.count(F.lit(1)).over(Window.partitionBy("hsn_code"))
    return first_per(votes.withColumn("kinds", kinds), "hsn_code", F.desc("votes"), "ord").filter("votes >= 2 or kinds = 1").select("hsn_code", "gst_rate")


def build_master(official: DataFrame, evidence: DataFrame) -> DataFrame:
    """(hsn_code, significance, description, heading_text, gst_rate, rate_from) of all codes of official and evidence.

    Both have raw_hsn_code, hsn_code, description, gst_rate, ord. Significance is the longest raw length of a code; the
    description is that of its longest official prefix up to it; the rate is the official one, else the vote, else the chapter's.
    """
    every = official.select("hsn_code", "raw_hsn_code").union(evidence.select("hsn_code", "raw_hsn_code")).filter("hsn_code <> ''")
    all_codes = every.groupBy("hsn_code").agg(F.least(F.max(F.length("raw_hsn_code")), F.lit(8)).alias("significance"))
    texts = first_per(official.filter("raw_hsn_code <> '' and description is not null"), "raw_hsn_code", F.desc(F.length("description")), "ord").select("raw_hsn_code", "description")
    out = all_codes
    for n in (8, 6, 4, 2):
        own = texts.filter(F.length("raw_hsn_code") == n).select(C("raw_hsn_code").alias(f"__p{n}"), C("description").alias(f"__d{n}"))
        out = out.withColumn(f"__p{n}", F.when(C("significance") >= n, F.substring("hsn_code", 1, n))).join(own, f"__p{n}", "left")
    heads = texts.filter("length(raw_hsn_code) = 4").select(C("raw_hsn_code").alias("__head"), C("description").alias("heading_text"))
    rates = first_per(official.filter("gst_rate is not null"), "hsn_code", "ord").select("hsn_code", C("gst_rate").alias("__official"))
    votes = majority_rate(evidence).select("hsn_code", C("gst_rate").alias("__vote"))
    out = out.withColumn("description", F.coalesce(*[C(f"__d{n}") for n in (8, 6, 4, 2)])).withColumn("__head", F.substring("hsn_code", 1, 4))
    out = out.join(heads, "__head", "left").join(rates, "hsn_code", "left").join(votes, "hsn_code", "left")
    chapter = codes.chapter_rate(C("hsn_code"))
    return out.select(
        "hsn_code", "significance", "description", "heading_text", F.coalesce("__official", "__vote", chapter).alias("gst_rate"),
        F.when(C("__official").isNotNull(), "official").when(C("__vote").isNotNull(), "vote").when(chapter.isNotNull(), "chapter").alias("rate_from"),
    )


QUALIFIERS = ("branded", "unit container", "retail sale")


def choose_official(official: DataFrame, qualifiers=QUALIFIERS) -> DataFrame:
    """One row per code: a rate over 0 and up to 5 prefers texts with a retail qualifier, never "commercial use"; then the first."""
    low = F.lower("description")
    retail = F.when((C("gst_rate") > 0) & (C("gst_rate") <= 5) & F.exists(text.word_list(qualifiers), lambda q: F.contains(low, q)), 0).otherwise(1)
    return first_per(official, "hsn_code", F.contains(low, F.lit("commercial use")), retail, "ord")


def build_release(raw: DataFrame, legacy: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Goods codes of eight digits with the longest text; rate by raw, legacy, schedule prefix, chapter; bad slabs are null and flagged."""
    goods = raw.filter(C("hsn_code").rlike("^[0-9]{8}$") & ~F.startswith("hsn_code", F.lit("99")))
    one = first_per(goods, "hsn_code", F.desc(F.length("description")), "ord").select("hsn_code", "description", C("gst_rate").alias("raw_rate"))
    out = longest_prefix_join(one, prefixes).withColumnRenamed("rate", "prefix_rate").join(legacy.select("hsn_code", C("gst_rate").alias("legacy_rate")), "hsn_code", "left")
    rate = F.coalesce("raw_rate", "legacy_rate", "prefix_rate", codes.chapter_rate(C("hsn_code")))
    return out.select("hsn_code", "description", F.when(codes.is_valid_slab(rate), rate).alias("gst_rate"), (rate.isNotNull() & ~codes.is_valid_slab(rate)).alias("bad_rate"))


def dedupe_dataset(df: DataFrame) -> DataFrame:
    """One row per (hsn_code, text key): the source with the highest rank, empty rate and category filled from the next ones."""
    order = Window.partitionBy("hsn_code", "key").orderBy(F.desc("source_rank"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keyed = df.withColumn("key", text.text_key(C("description")))
    filled = keyed.withColumn("gst_rate", F.first("gst_rate", True).over(order)).withColumn("category", F.first("category", True).over(order))
    return first_per(filled, ["hsn_code", "key"], F.desc("source_rank"), "id")


def attach_aliases(df: DataFrame, most: int = 12) -> DataFrame:
    """df (hsn_code, key) plus aliases: other keys of the code, sorted, at most `most`. Only most + 1 keys of a code are ever gathered."""
    few = top_per(df.select("hsn_code", "key").distinct(), "hsn_code", most + 1, "key", rank="__r")
    lists = few.groupBy("hsn_code").agg(F.sort_array(F.collect_list("key")).alias("__keys"))
    return df.join(lists, "hsn_code").withColumn("aliases", F.slice(F.array_remove("__keys", C("key")), 1, most)).drop("__keys")


def majority_code(cands: DataFrame, base: float, cap: float = 0.08) -> DataFrame:
    """(query_id, hsn_code, n, confidence, alternates): most frequent code, then the shortest text; up to three others; base plus 0.02 a row, cap at most."""
    n = cands.groupBy("query_id", "hsn_code").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("description")).alias("len"))
    ranked = top_per(n, "query_id", 4, F.desc("n"), "len", "hsn_code")
    out = ranked.groupBy("query_id").agg(F.max(F.when(C("rank") == 1, C("hsn_code"))).alias("hsn_code"), F.max(F.when(C("rank") == 1, C("n"))).alias("n"), F.sort_array(F.collect_list(F.when(C("rank") > 1, F.struct("rank", "hsn_code")))).alias("o"))
    return out.select("query_id", "hsn_code", "n", F.round(base + F.least(0.02 * C("n"), F.lit(cap)), 4).alias("confidence"), C("o.hsn_code").alias("alternates"))


def rank_grouped(cands: DataFrame, k: int) -> DataFrame:
    """Matches per (query_id, hsn_code): best row, support, mean score; ranked by score, support, mean, then code."""
    g = cands.groupBy("query_id", "hsn_code").agg(F.max_by("id", F.struct("score", -C("id"))).alias("id"), F.max("score").alias("score"), F.count(F.lit(1)).alias("support"), F.round(F.avg("score"), 9).alias("mean"))
    return top_per(g, "query_id", k, F.desc("score"), F.desc("support"), F.desc("mean"), "hsn_code")


def dataset_version(df: DataFrame) -> DataFrame:
    """(version, source, n): rows and the sum of their hashes, which do not depend on row order, and rows per source."""
    joined = F.concat_ws("|", *[F.coalesce(c, F.lit("?")) for c in ("hsn_code", "key", "source")])
    h = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.concat_ws("-", F.count(F.lit(1)), F.sum(h)).alias("version"))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("version", "source", "n")


def merge_corpus(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (language, term): ambiguous rows first and of these the lower priority; else the higher priority; the later on a tie."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    rank = F.when(C("ambiguous"), C("priority")).otherwise(-C("priority"))
    return first_per(both, ["language", "term"], F.desc("ambiguous"), rank, F.desc("__o"), F.desc("ord")).drop("__o")


def validate_corpus(df: DataFrame, languages=("ml", "ml-roman", "hi", "en")) -> DataFrame:
    """df plus reason (null for good rows): missing term, unknown language, bad code, bad weight, duplicate key."""
    seen = F.row_number().over(Window.partitionBy("language", "term").orderBy("ord"))
    code_ok = C("hsn_code").isNull() | C("hsn_code").rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8})$")
    reason = F.when(F.coalesce(F.trim("term"), F.lit("")) == "", "missing term").when(~F.coalesce(C("language").isin(*languages), F.lit(False)), "unknown language").when(~code_ok, "bad code").when(~(C("weight") > 0), "bad weight").when(C("__seen") > 1, "duplicate key")
    return df.withColumn("__seen", seen).withColumn("reason", reason).drop("__seen")


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per(df, keys, F.desc(order))


def ambiguous_terms(corpus: DataFrame) -> DataFrame:
    """(term, lowest, highest, noted): single words with a priority under 50 or a note, or with mixed priorities."""
    g = corpus.groupBy("term").agg(F.min("priority").alias("lowest"), F.max("priority").alias("highest"), F.bool_or(F.coalesce(C("notes") != "", F.lit(False))).alias("noted"))
    return g.filter(~F.contains("term", F.lit(" ")) & ((C("lowest") < 50) | C("noted") | (C("lowest") < C("highest"))))


def derive_maps(corpus: DataFrame, overrides: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """(kind, term, value): joined forms, transliterations, coded aliases, the rate of an alias and food hints; terms with a manual override are left to it.

    rate: the label of an alias code of 4, 6 or 8 digits, by its chapter (fixed.ALIAS_RATES, else fixed.ALIAS_RATE). food: lone words that are
    not `ambiguous` (term; ambiguous_terms by default), with the English term, a bar, and a code of 4, 6 or 8 digits if there is one.
    """
    joined = corpus.filter(F.contains("term", F.lit(" "))).select(F.lit("joined").alias("kind"), F.replace("term", F.lit(" "), F.lit("")).alias("term"), C("term").alias("value"))
    translit = corpus.filter("english is not null and language <> 'en'").select(F.lit("translit").alias("kind"), "term", C("english").alias("value"))
    alias = corpus.filter("hsn_code is not null").select(F.lit("alias").alias("kind"), "term", C("hsn_code").alias("value"))
    unclear = (ambiguous_terms(corpus) if ambiguous is None else ambiguous).select("term").distinct()
    code = codes.digits(C("hsn_code"))
    lone = corpus.filter("trim(term) <> '' and not contains(trim(term), ' ') and trim(english) <> ''").join(unclear, "term", "left_anti")
    food = lone.select(F.lit("food").alias("kind"), "term", F.concat(F.lower(F.trim("english")), F.lit("|"), F.when(F.length(code).isin(4, 6, 8), code).otherwise("")).alias("value"))
    found = joined.union(translit).union(alias).union(food).groupBy("kind", "term").agg(F.min("value").alias("value"))
    chapter = F.substring("value", 1, 2)
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.ALIAS_RATES.items() for x in pair]), chapter), F.lit(fixed.ALIAS_RATE))
    rates = found.filter(C("kind") == "alias").withColumn("value", codes.digits(C("value"))).filter(F.length("value").isin(4, 6, 8))
    derived = found.unionByName(rates.select(F.lit("rate").alias("kind"), "term", codes.rate_label(rate).alias("value")))
    return derived.join(overrides.select("kind", "term"), ["kind", "term"], "left_anti").unionByName(overrides)


def merge_curated(curated: DataFrame, derived: DataFrame) -> DataFrame:
    """(term, value, conflict): the curated value wins; conflict tells that both differ."""
    c, d = curated.select("term", C("value").alias("__c")), derived.select("term", C("value").alias("__d"))
    return c.join(d, "term", "full_outer").select("term", F.coalesce("__c", "__d").alias("value"), F.coalesce(C("__c") != C("__d"), F.lit(False)).alias("conflict"))


def seed_brands(misses: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(brand, n, representative, products): names grouped by first word, the middle one by length, at most `most` products."""
    m = misses.select("name").distinct().withColumn("brand", F.substring_index("name", " ", 1))
    w = Window.partitionBy("brand")
    ranked = m.withColumn("r", F.row_number().over(w.orderBy(F.length("name"), "name"))).join(m.groupBy("brand").agg(F.count(F.lit(1)).alias("n")), "brand").filter(C("n") >= least)
    middle = F.floor(C("n") / 2) + 1
    kept = ranked.filter((C("r") <= most) | (C("r") == middle))
    return kept.groupBy("brand", "n").agg(F.max(F.when(C("r") == middle, C("name"))).alias("representative"), F.sort_array(F.collect_list(F.when(C("r") <= most, C("name")))).alias("products"))


def learn_brands(misses: DataFrame, classify, floor: int = 65, least: int = 2, most: int = 50) -> DataFrame:
    """(brand, hsn_code, confidence, n, representative, products): the brands of seed_brands whose representative gets a code.

    classify takes queries (query_id, text) and gives (query_id, hsn_code, confidence); a code counts from confidence `floor` on and is filled to
    8 digits on the left. Only one name of each brand is classified.
    """
    seeds = seed_brands(misses, least, most)
    sure = classify(seeds.select(C("brand").alias("query_id"), C("representative").alias("text"))).filter((C("confidence") >= floor) & ~codes.is_unclassified(C("hsn_code")))
    return seeds.join(sure.select(C("query_id").alias("brand"), codes.clean_hsn(C("hsn_code")).alias("hsn_code"), "confidence"), "brand").select("brand", "hsn_code", "confidence", "n", "representative", "products")


def brand_products(learned: DataFrame) -> DataFrame:
    """(description, key, brand, hsn_code): one catalog row per product of the learned brands; of equal keys the first in order of brand and description."""
    rows = learned.select("brand", "hsn_code", F.explode("products").alias("description")).select("description", F.upper(F.trim("description")).alias("key"), "brand", "hsn_code")
    return first_per(rows, "key", "brand", "description")


def split_hits(results: DataFrame) -> DataFrame:
    """results plus hit and reason of a miss, in a fixed order."""
    reason = F.when(C("hsn_code").isNull(), "no code").when(codes.is_unclassified(C("hsn_code")), "placeholder").when(C("gst_rate").isNull(), "no rate").when(C("review"), "review").when(C("confidence") < 70, "low confidence")
    return results.withColumn("reason", reason).withColumn("hit", C("reason").isNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """old with the rows of new put in. Policy per column: replace (default keeps old if new is null), greatest, true.

    Of several new rows with one key the last by `order` counts (any one without it). Null keys are equal to each other.
    """
    policy = policy or {}
    values = [c for c in old.columns if c not in keys]
    new = dedupe_last(new, keys, order) if order else new.dropDuplicates(keys)
    renamed = new.select(*[C(k).alias(f"__k_{k}") for k in keys], *[C(c).alias(f"__n_{c}") for c in values], F.lit(True).alias("__new"))
    same = [C(k).eqNullSafe(C(f"__k_{k}")) for k in keys]
    joined = old.join(renamed, same, "full_outer")

    def value(c: str) -> Column:
        mine, theirs = C(c), C(f"__n_{c}")
        kind = policy.get(c)
        if kind == "replace":
            return F.when(C("__new"), theirs).otherwise(mine)
        if kind == "greatest":
            return F.greatest(mine, theirs)
        if kind == "true":
            return F.coalesce(C("__new"), mine)
        return F.coalesce(theirs, mine)

    return joined.select(*[F.coalesce(C(k), C(f"__k_{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in values])


def sync(old: DataFrame, new: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """(key, tracked, action): added, updated, same or deleted; deleted rows keep their old values."""
    o = old.select(key, F.struct(*tracked).alias("__o"))
    n = new.select(key, F.struct(*tracked).alias("__n"))
    action = F.when(C("__o").isNull(), "added").when(C("__n").isNull(), "deleted").when(C("__o").eqNullSafe(C("__n")), "same").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, *[F.when(C("__n").isNotNull(), C(f"__n.{c}")).otherwise(C(f"__o.{c}")).alias(c) for c in tracked], action.alias("action"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def patch_descriptions(df: DataFrame, patch: DataFrame) -> DataFrame:
    """Empty or unavailable descriptions from patch (code of 8 or 6 digits, description)."""
    p8 = patch.filter("length(code) = 8").select(C("code").alias("hsn_code"), C("description").alias("__d8"))
    p6 = patch.filter("length(code) = 6").select(C("code").alias("__c6"), C("description").alias("__d6"))
    bare = F.coalesce(F.trim("description"), F.lit("")).isin("", "Description not available")
    out = df.withColumn("__c6", F.substring("hsn_code", 1, 6)).join(p8, "hsn_code", "left").join(p6, "__c6", "left")
    return out.withColumn("description", F.when(bare, F.coalesce("__d8", "__d6", "description")).otherwise(C("description"))).drop("__c6", "__d8", "__d6")


def correct(df: DataFrame, wrong: Column, new_code: Column, reason: str, step: int = 0) -> tuple[DataFrame, DataFrame]:
    """(df with new codes where wrong, log of id, old_hsn, new_hsn, reason, step). Later corrections of one table have higher steps."""
    marked = df.withColumn("__w", F.coalesce(wrong, F.lit(False)))
    log = marked.filter("__w").select("id", C("hsn_code").alias("old_hsn"), new_code.alias("new_hsn"), F.lit(reason).alias("reason"), F.lit(step).alias("step"))
    return marked.withColumn("hsn_code", F.when(C("__w"), new_code).otherwise(C("hsn_code"))).drop("__w"), log


def rollback(df: DataFrame, log: DataFrame) -> DataFrame:
    """df with the codes put back that the oldest entry of each id in the log (one or more corrections) has; null codes too."""
    oldest = log.groupBy("id").agg(F.min_by(F.struct(C("old_hsn").alias("code")), "step").alias("__back"))
    return df.join(oldest, "id", "left").withColumn("hsn_code", F.when(C("__back").isNotNull(), C("__back.code")).otherwise(C("hsn_code"))).drop("__back")


def sync_rates(catalog: DataFrame, master: DataFrame) -> DataFrame:
    """Catalog rates from the master where its rate is a slab and differs; changed tells."""
    m = master.select("hsn_code", C("gst_rate").alias("__m"))
    differs = C("__m").isNotNull() & codes.is_valid_slab(C("__m")) & ~C("__m").eqNullSafe(C("gst_rate"))
    return catalog.join(m, "hsn_code", "left").withColumn("changed", differs).withColumn("gst_rate", F.when(differs, C("__m")).otherwise(C("gst_rate"))).drop("__m")


def backfill_no_size(df: DataFrame) -> DataFrame:
    return df.withColumn("no_size", F.when(F.coalesce("no_size", F.lit("")) == "", text.strip_sizes(C("description"))).otherwise(C("no_size")))


def resolve_reviews(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with status and resolved code, promoted rows for the catalog)."""
    out = queue.join(decisions.select("id", C("status").alias("__s"), C("code").alias("__c")), "id", "left")
    out = out.withColumn("status", F.coalesce("__s", "status")).withColumn("resolved", F.when(C("__s") == "approved", F.coalesce("__c", "best_guess"))).drop("__s", "__c")
    return out, out.filter("status = 'approved' and resolved is not null").select("query", C("resolved").alias("hsn_code"))


def set_active(df: DataFrame, condition: Column, flag: bool) -> DataFrame:
    return df.withColumn("is_active", F.when(F.coalesce(condition, F.lit(False)), flag).otherwise(C("is_active")))


def validate_code(df: DataFrame) -> DataFrame:
    """df (code) plus errors and warnings arrays."""
    d = codes.digits(C("code"))
    amended = F.create_map(*[F.lit(x) for a in fixed.AMENDMENTS for x in (a[0], f"amended to {a[1]}")])
    chapter_ok = codes.is_service(d) | (F.length(d) < 2) | (F.substring(d, 1, 2).try_cast("int") >= 1)
    errors = F.array_compact(F.array(F.when(d == "", "empty"), F.when((d != "") & ~F.length(d).isin(2, 4, 6, 8), "length"), F.when(d.isin(*fixed.PLACEHOLDERS), "placeholder"), F.when(~chapter_ok, "chapter")))
    return df.withColumn("errors", errors).withColumn("warnings", F.array_compact(F.array(F.try_element_at(amended, d))))


def validate_pair(df: DataFrame) -> DataFrame:
    """validate_code plus the rate: missing, slab with the closest one, cess."""
    out = validate_code(df)
    slab = F.when(C("rate").isNull(), "no rate").when(~codes.is_valid_slab(C("rate")), F.concat(F.lit("slab, closest "), codes.rate_label(codes.closest_slab(C("rate")))))
    return out.withColumn("errors", F.array_compact(F.concat("errors", F.array(slab)))).withColumn("warnings", F.array_compact(F.concat("warnings", F.array(F.when(codes.cess_flag(C("code")), "cess")))))


def validate_release(df: DataFrame) -> DataFrame:
    """One row of counts: codes, not of eight digits, misshapen services, rates off the slabs."""
    d = codes.digits(C("code"))
    return df.agg(
        F.count(F.lit(1)).alias("codes"), F.count_if(F.length(d) != 8).alias("not_eight"), F.count_if(F.startswith(d, F.lit("99")) & ~F.length(d).isin(4, 6)).alias("bad_service"),
        F.count_if(C("rate").isNotNull() & ~codes.is_valid_slab(C("rate"))).alias("bad_rate"),
    )


def audit_tariff(df: DataFrame) -> DataFrame:
    """(issue, n): empty or odd codes, short or numeric texts, duplicates by padded code."""
    d = codes.digits(C("code"))
    issues = F.array_compact(F.array(F.when(d == "", "empty code"), F.when((d != "") & ~F.length(d).isin(2, 4, 6, 8), "odd code"), F.when(F.length(F.coalesce("name", F.lit(""))) < 9, "short text"), F.when(C("name").rlike("^[0-9 ]+$"), "numeric text")))
    single = df.select(F.explode(issues).alias("issue"))
    repeated = df.groupBy(codes.clean_hsn(C("code")).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter("c is not null and n > 1").select(F.lit("duplicate").alias("issue"))
    return single.union(repeated).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def chapter_mismatch(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_no, chapter): the first rule (rule_no, keyword, chapters) whose keyword is in the text and whose chapters lack the code's."""
    hits = containing(df.select("id", "description", F.substring("hsn_code", 1, 2).alias("chapter")), C("description"), rules)
    first = hits.groupBy("id", "chapter").agg(F.min(F.struct("rule_no", "chapters")).alias("r"))
    return first.filter(~F.array_contains("r.chapters", C("chapter"))).select("id", "r.rule_no", "chapter")


def chapter_violations(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_no, id, chapter): every rule whose keyword is in the text and whose chapters lack the code's."""
    hits = containing(df.select("id", "description", F.substring("hsn_code", 1, 2).alias("chapter")), C("description"), rules)
    return hits.filter(~F.array_contains("chapters", C("chapter"))).select("rule_no", "id", "chapter")


def chapter_coverage(df: DataFrame) -> DataFrame:
    """(chapter, total, with_rate, with_cess, pct)."""
    g = df.groupBy(F.substring("hsn_code", 1, 2).alias("chapter")).agg(F.count(F.lit(1)).alias("total"), F.count("gst_rate").alias("with_rate"), F.count_if(codes.cess_flag(C("hsn_code"))).alias("with_cess"))
    return g.withColumn("pct", F.round(100.0 * C("with_rate") / C("total"), 2))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def compare_reports(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    b, a = before.select(key, C(value).alias("before")), after.select(key, C(value).alias("after"))
    return b.join(a, key, "full_outer").withColumn("change", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


def rate_mismatches(catalog: DataFrame, master: DataFrame) -> DataFrame:
    return catalog.join(master.select("hsn_code", C("gst_rate").alias("master_rate")), "hsn_code").filter(~C("gst_rate").eqNullSafe(C("master_rate")))


def detection_report(results: DataFrame) -> DataFrame:
    """(tier, n, percent, mean_confidence) over all results; a result without a code counts as undetected."""
    tier = F.when(C("hsn_code").isNull(), "undetected").otherwise(C("layer"))
    g = results.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return g.crossJoin(F.broadcast(results.agg(F.count(F.lit(1)).alias("total")))).select("tier", "n", F.round(100.0 * C("n") / C("total"), 4).alias("percent"), "mean_confidence")


def chapter_accuracy(results: DataFrame, expected: DataFrame, equivalent: dict[str, str]) -> DataFrame:
    """One row: compared, right, accuracy by chapter; chapters that map to the same value count as equal."""
    same = F.create_map(*[F.lit(x) for kv in equivalent.items() for x in kv])
    canon = lambda c: F.coalesce(F.try_element_at(same, c), c)
    ok = canon(F.substring("hsn_code", 1, 2)) == canon(C("chapter"))
    return results.join(expected, "query_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(ok).alias("right_chapter"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))
