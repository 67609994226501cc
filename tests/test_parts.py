"""Literal rows for the rankings, the adapter, the language search and the corpus maps, against plain versions."""

import math

from dutymark.functions import fixed
from dutymark.operators import master, similarity
from dutymark.plans import cascade


def test_lexical_score_equals_plain_sums(spark):
    brand, other = fixed.BRANDS[0], fixed.BRANDS[1]
    word, same = next((w, s[0]) for w, s in fixed.SYNONYMS.items() if w.isalpha() and s and s[0].isalpha() and not {w, s[0]} & {*fixed.STOPWORDS, *fixed.BRANDS} and len(w) > 2)
    rows = [
        (1, f"{brand} copper kettle", 1, "73211100", f"{brand} copper kettle large", "kitchen", 0.5),
        (1, f"{brand} copper kettle", 2, "85161000", f"{other} copper kettle", "kitchen", 0.5),
        (1, f"{brand} copper kettle", 3, None, "iron pan", "kettle", 0.25),
        (2, word, 1, "73211100", f"{same} thing", "", 0.0), (2, word, 2, "1", "nothing here", "", None), (3, "12", 1, "1", "x", "", 0.75), (4, None, 1, "1", "x", "", 0.75),
    ]
    cands = spark.createDataFrame(rows, "query_id long, query string, id long, hsn_code string, description string, category string, base double")
    prefixes = spark.createDataFrame([(1, ["73"])], "query_id long, prefixes array<string>")
    got = {(r["query_id"], r["id"]): r["lexical"] for r in similarity.lexical_score(cands, prefixes, ("copper",)).collect()}
    idf = lambda n, df: math.log((n + 1) / (df + 0.5)) + 1
    b, copper, kettle = 2.8 + idf(3, 1), idf(3, 2) + 0.25 + 0.35, idf(3, 3) + 0.25
    total = b + copper + kettle
    s = idf(2, 0) + (0.25 if len(word) >= 5 else 0)
    want = {
        (1, 1): min(1, ((b * 1.25 + copper + kettle) / total + 0.12 + 0.08) * 0.74 + 0.5 * 0.26),
        (1, 2): ((copper + kettle) / total - 0.16 + 0.12 - 0.06) * 0.74 + 0.5 * 0.26,
        (1, 3): kettle * 0.75 / total * 0.74 + 0.25 * 0.26,
        (2, 1): s * 0.55 / s * 0.74, (2, 2): 0.0, (3, 1): 0.75, (4, 1): 0.75,
    }
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert similarity.lexical_score(cands.limit(0), prefixes).count() == 0


def test_alternates_of_bulk_results(spark):
    alternates = [("1905", 84.0), ("99999999", 90.0), (None, 1.0), ("", 1.0), ("998311", None), ("19053100", 0.0), ("84", 0.31)]
    rows = [(1, "a", "19053100", 90, False, 18.0, alternates), (2, "b", None, 10, False, None, alternates), (3, "c", "1905", 60, True, 18.0, None)]
    df = spark.createDataFrame(rows, "row_id long, query string, hsn_code string, confidence int, review boolean, gst_rate double, alternates array<struct<hsn_code:string,score:double>>")
    got = {r["row_id"]: (r["state"], r["alternate_codes"], r["alternate_scores"]) for r in cascade.to_bulk_result(df).collect()}
    assert got == {1: ("ok", ["19050000", "998311", "19053100", "84000000"], [0.84, 0.5, 0.5, 0.31]), 2: ("empty", [], []), 3: ("needs review", [], [])}


def test_language_search_by_equal_contained_and_similar_terms(spark):
    aliases = spark.createDataFrame([("vellam", "170114", 2.0, "ml"), ("pure vellam blocks", "1701", 1.0, "ml"), ("vellum", "4806", 1.5, "ml"), ("vellam", "22", 3.0, "hi"), ("gur", None, 9.0, "ml"), ("", "01", 9.0, "ml")], "alias string, code string, weight double, language string")
    tariff = spark.createDataFrame([("17011400",), ("17011490",), ("170114",), ("48064000",), ("22011010",), ("01010000",)], "hsn_code string")
    queries = spark.createDataFrame([(1, " Vellam ", "ml"), (2, "vellam", "en"), (3, "", "ml"), (4, None, "ml"), (5, "gur", "ml")], "query_id long, text string, language string")
    got = [(r["query_id"], r["hsn_code"], r["weight"]) for r in similarity.search_by_language(queries, aliases, tariff, 9).orderBy("query_id", "rank").collect()]
    assert got == [(1, "170114", 2.0), (1, "17011400", 2.0), (1, "17011490", 2.0), (1, "48064000", 1.5)]
    # without languages every alias counts
    assert {r["hsn_code"] for r in similarity.search_by_language(queries.filter("query_id = 2").drop("language"), aliases, tariff, 9).collect()} == {"170114", "17011400", "17011490", "48064000", "22011010"}


def test_rates_and_food_hints_of_the_corpus(spark):
    rows = [("ml", "vellam", "17011400", "Jaggery", 60, None), ("ml", "achar", "2001", " Pickle ", 60, None), ("hi", "papad", "190590", "papad", 60, None), ("hi", "tea dust", "123", "tea", 60, None), ("hi", "vague", "1905", "thing", 10, None), ("hi", "bare", None, "", 60, None)]
    corpus = spark.createDataFrame(rows, "language string, term string, hsn_code string, english string, priority int, notes string")
    none = spark.createDataFrame([("rate", "achar", "28%")], "kind string, term string, value string")
    got = {(r["kind"], r["term"]): r["value"] for r in master.derive_maps(corpus, none).collect() if r["kind"] in ("rate", "food")}
    assert got == {
        ("rate", "vellam"): "5%", ("rate", "achar"): "28%", ("rate", "papad"): "18%", ("rate", "vague"): "18%",
        ("food", "vellam"): "jaggery|17011400", ("food", "achar"): "pickle|2001", ("food", "papad"): "papad|190590",
    }


def test_brands_are_learned_from_sure_codes(spark):
    names = ["ACME TEA", "ACME TEA BIG", "ACME TEA BIGGER", "DUO A", "DUO B", "LONE X", "WEAK ONE", "WEAK TWO"]
    codes = {"ACME TEA BIG": ("9021", 80), "DUO B": ("99999999", 90), "WEAK TWO": ("0101", 64)}
    table = spark.createDataFrame([(k, *v) for k, v in codes.items()], "text string, hsn_code string, confidence int")
    learned = master.learn_brands(spark.createDataFrame([(n,) for n in names], "name string"), lambda q: q.join(table, "text").drop("text"))
    assert [tuple(r) for r in learned.collect()] == [("ACME", "00009021", 80, 3, "ACME TEA BIG", names[:3])]
    assert {(r["key"], r["hsn_code"]) for r in master.brand_products(learned).collect()} == {(n, "00009021") for n in names[:3]}
