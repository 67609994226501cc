"""Queries do their whole job: nothing is left out for its length, frequency or place."""

import numpy as np

from dutymark.operators import lookups as L
from dutymark.operators import similarity as S
from dutymark.plans import cascade
from dutymark.queries import flows
from dutymark.registry import QUERIES
from dutymark.views import view


def test_aliases_of_any_length_are_found(spark):
    aliases = spark.createDataFrame([("one two three four five", "5"), ("six seven eight nine ten eleven twelve", "7"), ("one two", "2"), ("abc", "3")], "alias string, code string")
    texts = {1: "one two three four five", 2: "One two three four five, more", 3: "more one two three four five six", 4: "abc six seven eight nine ten eleven twelve", 5: "xabc", 6: "one two three four", 7: "six", 8: "one one two three four five"}
    asked = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    assert {r["query_id"]: r["code"] for r in L.match_alias(asked, aliases).collect()} == {1: "5", 2: "5", 3: "5", 4: "7", 6: "2", 8: "5"}


def test_every_text_of_a_code_counts_in_match_tariff(spark):
    tariff = spark.createDataFrame([("01", "aaa first text"), ("01", "copper kettle"), ("02", "copper kettles of zinc"), ("03", "copper kettle"), ("03", "zzz"), ("04", None)], "hsn_code string, description string")
    catalog = spark.createDataFrame([("01",), ("01",), ("02",)], "hsn_code string")
    got = S.match_tariff(spark.createDataFrame([(1, "copper kettle")], "query_id long, text string"), tariff, catalog, k=2)
    assert [(r["hsn_code"], r["volume"], r["rank"]) for r in got.orderBy("rank").collect()] == [("01", 2, 1), ("02", 1, 2)]
    assert got.filter("rank = 1").first()["similarity"] == 1.0


def test_every_text_of_a_code_counts_in_multi_search(spark):
    tariff = spark.createDataFrame([("01010000", "aaa first", "a", 5.0), ("01010000", "copper kettle", "b", 5.0), ("02020000", "copper", "a", 5.0), ("02020000", "zzz", "kettle", 5.0), ("03030000", "kettle of iron", "c", 5.0)], "hsn_code string, description string, category string, gst_rate double")
    catalog = spark.createDataFrame([(1, "FIELD GATE", "83024190")], "id long, description string, raw_code string")
    asked = spark.createDataFrame([(1, "copper kettle"), (2, "copper kettle")], "query_id long, text string")
    hints = spark.createDataFrame([], "query_id long, codes array<string>")
    got = sorted((r["query_id"], r["rank"], r["hsn_code"], r["method"], r["score"]) for r in cascade.multi_search(asked, catalog, tariff, hints, 2).collect())
    # the same text by trigrams is 1 and 0.05 of its layer, over 2 / 3 and 0.10 by words
    first, second = ("01010000", "L3_pg_trgm_fuzzy", 1.0), ("02020000", "L2_inverted_index", round(1.4 / 2.4 + 0.10, 4))
    assert got == [(q, n + 1, *row) for q in (1, 2) for n, row in enumerate((first, second))]


def test_every_open_text_asks_all_vectors(spark, sf_dir):
    text, catalog, e = (view(spark, sf_dir, n) for n in ("v_text", "v_catalog", "embeddings"))
    rows = e.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    score = np.round(x @ x.T, 9)
    near = [(int(ids[i]), int(ids[j]), float(score[i, j])) for i in range(len(ids)) for j in np.lexsort((ids, -score[i]))[:10]]
    want = cascade.hybrid_cascade(flows.asked14(text, catalog), flows.dataset14(catalog), 5, spark.createDataFrame(near, "query_id long, id long, score double"))
    plain = lambda df: sorted((r["query_id"], r["rank"], r["hsn_code"], round(r["score"], 6)) for r in df.collect())
    assert plain(QUERIES["w14_hybrid_vectors"](spark, sf_dir)) == plain(want)


def test_brand_lookup_reads_its_rows_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(400).selectExpr("id as query_id", "case id % 3 when 0 then 'HORLO 500G' when 1 then 'kavya' else 'oil' end as text")
    catalog = spark.createDataFrame([(1, "FIELD GATE", "83024190", "KAVYA"), (2, "ZINC BUCKET", "79070010", "LUMEN")], "id long, description string, raw_code string, brand string")
    aliases = spark.createDataFrame([("HORLO", "19019010", 1.8)], "term string, code string, weight double")
    got = cascade.brand_lookup(rows.mapInArrow(count, rows.schema), aliases, catalog, 0.5, ["oil"], ["bucket"], 4)
    assert got.groupBy("code", "step").count().orderBy("code").collect() == [("19019010", 1, 134), ("83024190", 2, 133)]
    # once for the distinct texts, once for the answers
    assert seen.value <= 2 * 400
