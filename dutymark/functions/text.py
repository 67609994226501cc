"""Product text as Columns: typos, abbreviations, noise, tokens, sizes, keys."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dutymark.functions import fixed


def word_map(words: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in words.items()))


def word_list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_plain(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def fix_typos(c: Column) -> Column:
    """Upper case with known typos mended; text with other scripts stays as it is."""
    out = F.upper(c)
    for pattern, fixed_word in fixed.TYPOS:
        out = F.regexp_replace(out, pattern, fixed_word)
    return F.when(is_plain(c), out).otherwise(c)


def expand_pos(c: Column) -> Column:
    """Abbreviations spelled out, once, word by word; some only before a blank or the end."""
    text = F.upper(c)
    anywhere, at_end = word_map(fixed.ABBREVIATIONS), word_map(fixed.END_ABBREVIATIONS)

    def joined(parts: Column) -> Column:
        def part(w: Column, i: Column) -> Column:
            after = F.coalesce(F.get(parts, i + 1), F.lit(" "))
            return F.coalesce(F.try_element_at(anywhere, w), F.when(after.rlike(r"^\s"), F.try_element_at(at_end, w)), w)

        return F.array_join(F.transform(parts, part), "")

    return let(F.regexp_extract_all(text, F.lit(r"([A-Z0-9_]+|[^A-Z0-9_]+)"), F.lit(1)), joined)


def strip_noise(c: Column) -> Column:
    """Without sizes, bare numbers, model codes and multipliers."""
    out = F.upper(c)
    for pattern in (rf"\b\d+(\.\d+)?\s*({fixed.NOISE_UNITS})\b", r"\b\d+\b", r"\b[A-Z]{0,3}\d{2,}[A-Z0-9]{0,4}\b", r"\*|\bX\d+\b|\d+X\b"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def normalize_name(c: Column) -> Column:
    """Search form of a name: abbreviations, noise, brackets, leading stop words. Other scripts only lose blanks."""
    opened = expand_pos(fix_typos(F.trim(F.coalesce(c, F.lit("")))))
    plain = F.regexp_replace(strip_noise(opened), r"[()\[\]{}#@\\|^~`]", " ")
    for shape in fixed.SHAPES:
        plain = F.regexp_replace(plain, shape, " ")
    plain = squeeze(plain)
    stops = "|".join(fixed.LEADING_STOPS)
    return F.when(is_plain(F.coalesce(c, F.lit(""))), F.regexp_replace(plain, rf"^(({stops}) )+(?=\S)", "")).otherwise(squeeze(opened))


def product_keywords(c: Column, brands=fixed.BRANDS) -> Column:
    """The last word if long, else the last two, after leading brand words."""
    lead = word_list([b.upper() for b in brands])
    count = lambda a, w: F.struct((a["n"] + F.when(a["on"] & F.array_contains(lead, w), 1).otherwise(0)).alias("n"), (a["on"] & F.array_contains(lead, w)).alias("on"))

    def after_brands(words: Column) -> Column:
        first = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), count, lambda a: a["n"])
        rest = F.slice(words, first + 1, F.size(words))
        return let(rest, lambda r: F.when(F.size(r) == 0, F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))).otherwise(r))

    def chosen(rest: Column) -> Column:
        last = F.get(rest, F.size(rest) - 1)
        two = F.array(F.concat_ws(" ", F.get(rest, F.size(rest) - 2), last))
        return F.when((F.size(rest) >= 2) & (F.length(last) >= 5), F.array(last)).when(F.size(rest) >= 2, two).otherwise(F.slice(rest, 1, 1))

    words = F.filter(F.split(strip_noise(c), " "), lambda w: w != "")
    return let(words, lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(let(after_brands(ws), chosen)))


def strip_sizes(c: Column, units: str = fixed.KEY_UNITS) -> Column:
    """Key without sizes and non-letters, upper case."""
    out = F.upper(c)
    for pattern in (rf"\b\d+(\.\d+)?\s*({units})\b", r"\b\d+\s*X\s*\d+\b", r"\b\d+\s*\+\s*\d+\b", r"\b\d+[SNP]\b", r"\b\d+\b", r"[^A-Z\s]"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def text_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9\s]", " "))


def expand_words(c: Column, words: dict[str, str] = fixed.TRADE_WORDS) -> Column:
    """Dictionary expansion token by token, lower case, without adjacent repeats. SS, FTGR and TR go first."""
    out = F.regexp_replace(c, r"(?i)\bSS\b", "stainless steel")
    out = F.regexp_replace(out, r"(?i)\bFTGR\b", "fenugreek")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\bTR\.\s*", "kitchen treasure "), r"(?i)\bTR\b", "kitchen treasure")
    tokens = F.filter(F.split(F.lower(out), r"\s+"), lambda t: t != "")
    mapped = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(word_map(words), F.regexp_replace(t, r"\.+$", "")), t))
    return let(mapped, lambda m: F.array_join(F.filter(m, lambda t, i: (i == 0) | (t != F.coalesce(F.get(m, i - 1), F.lit("")))), " "))


def tokenize(c: Column, keep_brands: bool = False) -> Column:
    """Lower-case words of two letters or more, without sizes, stop words and (by default) brands; repeats stay."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b\d+\s*({fixed.TOKEN_UNITS})\b", " "), r"\b\d+\b", " ")
    drop = word_list(fixed.STOPWORDS if keep_brands else fixed.STOPWORDS + fixed.BRANDS)
    return F.filter(F.regexp_extract_all(text, F.lit("([a-z]{2,})"), F.lit(1)), lambda t: ~F.array_contains(drop, t))


def name_tokens(c: Column) -> Column:
    """Lower-case tokens of three letters or more, sizes left out; repeats stay."""
    bare = F.regexp_replace(F.lower(c), rf"\b\d+\s*({fixed.NAME_UNITS})\b", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) >= 3)


def query_fields(c: Column) -> Column:
    """struct(brand_tokens, product_tokens, all_tokens), distinct in order."""
    every = F.array_distinct(tokenize(c, keep_brands=True))
    brands = word_list(fixed.BRANDS)
    return F.struct(F.filter(every, lambda t: F.array_contains(brands, t)).alias("brand_tokens"), F.filter(every, lambda t: ~F.array_contains(brands, t)).alias("product_tokens"), every.alias("all_tokens"))


def expand_synonyms(tokens: Column, synonyms: dict = fixed.SYNONYMS) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), word_list(v)) for k, v in synonyms.items()))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def pack_text(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(rf"\b(\d+(?:\.\d+)?\s*(?:{fixed.TOKEN_UNITS}))\b"), F.lit(1)), " ")


def pack_size(c: Column) -> Column:
    """struct(value, unit) of the first size, in ML or G; null without one."""
    pattern = rf"\b(\d+(?:\.\d+)?)\s*({fixed.PACK_UNITS})\b"
    value, unit = F.regexp_extract(F.upper(c), pattern, 1).try_cast("double"), F.regexp_extract(F.upper(c), pattern, 2)
    scale = F.when(unit.isin("L", "LTR", "KG"), 1000.0).otherwise(1.0)
    return F.when(value.isNotNull(), F.struct((value * scale).alias("value"), F.when(unit.isin("L", "LTR", "ML"), "ML").otherwise("G").alias("unit")))


def size_similarity(a: Column, b: Column) -> Column:
    """Of two pack sizes: equal 0.14, same unit by closeness up to 0.08, else 0."""
    gap, top = F.abs(a["value"] - b["value"]), F.greatest(a["value"], b["value"], F.lit(1.0))
    return F.when(a.isNull() | b.isNull() | (a["unit"] != b["unit"]), 0.0).when(gap == 0, 0.14).otherwise(F.round((1 - F.least(gap / top, F.lit(1.0))) * 0.08, 4))


def core_product(c: Column) -> Column:
    return F.coalesce(F.try_element_at(tokenize(c), F.lit(-1)), F.lit(""))


def brand_token(c: Column) -> Column:
    """First word of two letters or more after sizes and packaging words."""
    words = F.filter(F.split(strip_sizes(c), " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(word_list([s.upper() for s in fixed.STOPWORDS]), w))
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def normalize_description(c: Column, words: dict[str, str] = fixed.TRADE_WORDS) -> Column:
    tokens = F.split(F.lower(c), r"\s+")
    mapped = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(word_map(words), F.regexp_replace(t, r"[.,]+$", "")), t)), " ")
    return squeeze(F.regexp_replace(mapped, r"\s*[+&]\s*", " "))


def detect_language(c: Column, hints=fixed.ROMAN_HINTS) -> Column:
    """hi, ml by script; ml-roman by two hint words, a lone long one, or a third of the words; else en."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.array_contains(word_list(hints), w)))
    lone = (F.size(words) == 1) & (hits == 1) & (F.length(F.get(words, F.lit(0))) >= 5)
    return F.when(c.rlike(r"[\x{0900}-\x{097F}]"), "hi").when(c.rlike(r"[\x{0D00}-\x{0D7F}]"), "ml").when((hits >= 2) | lone | ((F.size(words) > 1) & (hits >= 1) & (hits / F.greatest(F.size(words), F.lit(1)) >= 0.34)), "ml-roman").otherwise("en")


@F.pandas_udf(StringType())
def _fold_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))).strip().upper())


def normalize_term(c: Column) -> Column:
    """Upper case without marks and punctuation. Only texts beyond ASCII go to Python."""
    plain = F.upper(squeeze(F.regexp_replace(c, r"[^\w\s]", " ")))
    return F.when(is_plain(c), plain).otherwise(_fold_marks(c))


def entities(c: Column, rules: dict[str, tuple[tuple[str, str], ...]]) -> Column:
    """struct of the first value of each kind whose pattern occurs; rules: kind -> ((pattern, value), ...)."""
    return F.struct(*[F.coalesce(*[F.when(F.lower(c).rlike(p), F.lit(v)) for p, v in pairs]).alias(kind) for kind, pairs in rules.items()])


def parse_footwear(c: Column) -> Column:
    """struct(series, model, gender, size, code): brand letters, model number, gender letter, size; the gender decides the code."""
    pattern = r"\b([A-Z]{2,4})[ -]?(\d{3,5})[ -]?(GTS|LDS|KDS|G|L|K)?[ -]?(\d{1,2})?\b"
    part = lambda i: F.nullif(F.regexp_extract(F.upper(c), pattern, i), F.lit(""))
    gender = F.substring(part(3), 1, 1)
    return F.when(part(2).isNotNull(), F.struct(part(1).alias("series"), part(2).alias("model"), gender.alias("gender"), part(4).alias("size"), F.when(gender == "L", "64029990").when(gender == "K", "64041990").otherwise("64022090").alias("code")))


def query_key(c: Column) -> Column:
    return F.upper(squeeze(F.coalesce(c, F.lit(""))))


def cache_key(c: Column) -> Column:
    return F.concat(F.lit("match:v1:"), F.sha1(query_key(c).cast("binary")))


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.80, "high").when(c >= 0.55, "medium").otherwise("low")


def scaled_confidence(score: Column, source: Column) -> Column:
    """0 to 100 by the range of the source."""
    scaled = F.when(source == "exact", 100.0).when(source == "verified_exact", (score - 0.92) / 0.08 * 100).otherwise(score * 100)
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(scaled + 0.5))).cast("int")


def replace_phrases(c: Column, phrases: dict[str, str], longest: int = 4) -> Column:
    """Longest phrase first, word by word from the left; words inside a replaced phrase are not read again."""
    table = word_map(phrases)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(words: Column, acc: Column, at: Column) -> Column:
        hits = [F.when((at + n <= F.size(words)) & F.try_element_at(table, F.array_join(F.slice(words, at + 1, n), " ")).isNotNull(), F.struct(F.try_element_at(table, F.array_join(F.slice(words, at + 1, n), " ")).alias("to"), F.lit(n - 1).alias("skip"))) for n in range(longest, 0, -1)]
        choice = F.coalesce(*hits, F.struct(F.get(words, at).alias("to"), F.lit(0).alias("skip")))
        return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).otherwise(F.struct(F.concat(acc["out"], F.array(choice["to"])).alias("out"), choice["skip"].alias("skip")))

    return let(F.split(squeeze(F.lower(c)), " "), lambda words: F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, lambda acc, at: step(words, acc, at), lambda a: F.array_join(a["out"], " ")))


def strip_brand_prefix(c: Column, brands) -> Column:
    alternatives = "|".join(re.escape(b.upper()) for b in sorted(brands, key=lambda b: (-len(b), b)))
    return F.trim(F.regexp_replace(F.upper(c), rf"^({alternatives})\b\s*", ""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two blanks before and one after."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trgm_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))
