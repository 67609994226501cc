"""Equal texts, brands and codes are answered once: intermediate rows grow with the rows, not with the square of a group."""

import pytest
from pyspark.sql import functions as F

from dutymark.operators import lookups as L
from dutymark.operators import similarity as S
from dutymark.operators import wordsearch
from dutymark.plans import cascade

C = F.col


@pytest.fixture
def most_rows(spark):
    """f(df): the greatest number of rows that a join of its plan gives out."""

    def measured(df) -> int:
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif name.endswith("QueryStage"):
                todo.append(node.plan())
            if "Join" in name and node.metrics().contains("numOutputRows"):
                found.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return max(found)

    return measured


def test_match_brand_joins_one_row_of_a_brand(spark, most_rows):
    brands = spark.range(300).select(F.lit("Acme").alias("brand"), F.format_string("%08d", C("id")).alias("code"), (C("id") % 28).cast("double").alias("gst_rate"))
    goods = brands.select(C("code").alias("hsn_code"), F.concat(F.lit("goods "), "code").alias("description"))
    services = spark.createDataFrame([], "sac_code string, description string, gst_rate double")
    got = L.match_brand(spark.range(200).select(C("id").alias("query_id"), F.lit(" acme ").alias("text")), brands, goods, services)
    assert most_rows(got) <= 300
    assert {tuple(r) for r in got.drop("query_id").collect()} == {("00000027", "goods 00000027", 27.0)} and got.count() == 200


def asked(spark, n: int, said: str):
    return spark.range(n).select(C("id").alias("query_id"), F.lit(said).alias("text"))


def numbered(spark, n: int, before: str):
    return spark.range(n).select("id", F.concat(F.lit(before), "id").alias("description"), F.lpad(C("id") + 1000, 8, "0").alias("raw_code"))


def test_match_product_name_joins_one_row_of_a_word(spark, most_rows):
    catalog = numbered(spark, 60, "Blue bolt ")
    got = S.match_product_name(asked(spark, 300, "blue bolt 7"), catalog)
    assert most_rows(got) < 5_000
    assert {(r["id"], r["similarity"]) for r in got.collect()} == {(7, 1.0)} and got.count() == 300


def test_match_prefix_joins_few_rows_of_a_beginning(spark, most_rows):
    got = L.match_prefix(asked(spark, 200, "blue"), numbered(spark, 300, "BLUE BOLT "), 5)
    assert most_rows(got) <= 1_000
    assert sorted({(r["id"], r["rank"]) for r in got.collect()}) == [(n, n + 1) for n in range(5)] and got.count() == 1_000


def test_match_tariff_joins_few_codes_of_a_text(spark, most_rows):
    tariff = numbered(spark, 60, "blue bolt ").withColumnRenamed("raw_code", "hsn_code")
    got = S.match_tariff(asked(spark, 200, "blue bolt"), tariff, tariff.select("hsn_code"), k=3)
    assert most_rows(got) <= 3_000
    assert {r["hsn_code"] for r in got.filter("rank = 1").collect()} == {"00001000"} and got.count() == 600


def test_match_code_prefix_joins_few_codes(spark, most_rows):
    tariff = spark.range(80).select((C("id") + 10_000_000).cast("string").alias("hsn_code"), F.lit("x").alias("description"))
    got = L.match_code_prefix(asked(spark, 200, "10"), tariff, 5)
    assert most_rows(got) <= 1_000
    assert sorted({(r["hsn_code"], r["rank"]) for r in got.collect()}) == [(str(10_000_000 + n), n + 1) for n in range(5)]


@pytest.mark.parametrize("mode", ["one", "all"])
def test_match_words_joins_few_rows_of_a_text(spark, most_rows, mode):
    catalog = spark.range(400).select("id", F.lit("BLUE BOLTS").alias("description"))
    queries = spark.range(60).select(C("id").alias("query_id"), F.concat(F.lit("bolts blue "), C("id") % 60).alias("text"))
    got = L.match_words(queries, catalog, mode, 5)
    assert most_rows(got) <= 600
    assert sorted({(r["id"], r["rank"]) for r in got.collect()}) == [(n, n + 1) for n in range(5)]


def test_hybrid_cascade_keeps_few_codes_of_a_key(spark, monkeypatch):
    sizes, keep = [], cascade.kept
    monkeypatch.setattr(cascade, "kept", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    rows = numbered(spark, 200, "BLUE BOLT ").select("id", C("raw_code").alias("hsn_code"), F.lit("BLUE BOLT").alias("description"), (C("id") % 4 / 100.0).alias("bonus"))
    got = cascade.hybrid_cascade(asked(spark, 100, "blue bolt"), rows, 5)
    assert max(sizes) <= 20
    assert sorted({(r["rank"], r["hsn_code"], r["score"]) for r in got.collect()}) == [(n + 1, f"{1003 + 4 * n:08d}", 0.85) for n in range(5)]


def test_code_scores_gives_few_codes_of_a_cell(spark):
    rows = numbered(spark, 500, "").select("id", C("raw_code").alias("hsn_code"), F.lit(0.0).alias("bonus"), F.lit("BLUE BOLT").alias("dk"), F.array(F.lit("blue"), F.lit("bolt")).alias("d"))
    question = spark.createDataFrame([("a", "BLUE", ["blue"], "blue")], "ask string, qk string, q array<string>, core string")
    got = wordsearch.code_scores(question, rows.unionByName(rows.filter("id = 300")), 5).collect()
    assert len(got) <= 5 * 64
    assert max(got, key=lambda r: (r["score"], r["support"]))["hsn_code"] == "00001300"


def test_rate_as_of_equals_all_pairs(spark):
    at = lambda c: F.expr(f"date_add(date'2020-01-15', cast({c} as int))")
    rows = spark.range(200).select("id", F.lit("01").alias("chapter"), at("id").alias("day"))
    spans = [(0, 10, 1.0), (5, 70, 2.0), (50, 50, 3.0), (60, 40, 4.0), (-400, 3, 5.0), (150, None, 6.0), (300, None, 7.0), (-900, None, 8.0)]
    history = spark.createDataFrame(spans, "a int, b int, gst_rate double").select(F.lit("01").alias("chapter"), at("a").alias("effective_from"), at("b").alias("effective_to"), "gst_rate")
    got = L.rate_as_of(rows, history, "day")
    assert sorted((r["id"], r["gst_rate"]) for r in got.collect()) == sorted((i, g) for i in range(200) for a, b, g in spans if a <= i and (b is None or i < b))
