"""Votes, cascades, upserts, files and streams on small tables."""

import uuid

from pyspark.sql import functions as F

from dutymark.operators import lookups, master, ratios, similarity
from dutymark.plans import cascade
from dutymark.sources import files
from dutymark.streaming import events


def test_votes(spark):
    rows = [("a", 5.0, 1), ("a", 18.0, 2), ("b", 5.0, 3), ("b", 5.0, 4), ("b", 18.0, 5), ("c", 12.0, 6)]
    got = {r["hsn_code"]: r["gst_rate"] for r in master.majority_rate(spark.createDataFrame(rows, "hsn_code string, gst_rate double, ord long")).collect()}
    assert got == {"b": 5.0, "c": 12.0}


def test_alias_bounds(spark):
    aliases = spark.createDataFrame([("oil", "1"), ("coil", "2"), ("mosquito coil", "3"), ("tea", "4")], "alias string, code string")
    asked = spark.createDataFrame([(1, "steak"), (2, "aluminium foil"), (3, "good Mosquito  coil!"), (4, "tea leaf"), (5, "hot tea")], "query_id long, text string")
    assert {r["query_id"]: r["code"] for r in lookups.match_alias(asked, aliases).collect()} == {3: "3", 4: "4"}


def test_cascade_takes_the_first_acceptable_tier(spark):
    rows = [(1, 3, "a", 90, False), (1, 1, "b", 60, False), (1, 2, "c", 95, True), (2, 1, "d", 50, False), (2, 4, "e", 69, False), (3, 5, "f", 70, False), (3, 2, "g", 71, False)]
    got = cascade.resolve_cascade(spark.createDataFrame(rows, "query_id long, tier int, hsn_code string, confidence int, review boolean")).collect()
    assert {r["query_id"]: (r["hsn_code"], r["accepted"]) for r in got} == {1: ("a", True), 2: ("e", False), 3: ("g", True)}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id long, name string, weight double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 1.0)], "id long, name string, weight double")
    once = master.upsert(old, new, ["id"], {"weight": "greatest"})
    assert sorted(map(tuple, once.collect())) == [(1, "a", 2.0), (2, "b", 9.0), (3, "c", 1.0)]
    assert sorted(map(tuple, master.upsert(once, new, ["id"], {"weight": "greatest"}).collect())) == sorted(map(tuple, once.collect()))


def test_rollback_restores(spark):
    df = spark.createDataFrame([(1, "10"), (2, None)], "id long, hsn_code string")
    new, log = master.correct(df, F.col("hsn_code") == "10", F.lit("20"), "moved")
    assert sorted(map(tuple, master.rollback(new, log).collect())) == [(1, "10"), (2, None)]
    coded, first = master.correct(df, F.col("hsn_code").isNull(), F.lit("30"), "filled")
    moved, second = master.correct(coded, F.col("hsn_code") == "30", F.lit("40"), "moved", step=1)
    assert sorted(map(tuple, moved.collect())) == [(1, "10"), (2, "40")]
    assert sorted(map(tuple, master.rollback(moved, second.union(first)).collect())) == [(1, "10"), (2, None)]


def test_upsert_takes_the_last_of_repeated_keys_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "id long, name string")
    new = spark.createDataFrame([(3, "x", 1), (3, "z", 3), (3, "y", 2), (None, "m", 1)], "id long, name string, at int")
    assert sorted(map(repr, map(tuple, master.upsert(old, new, ["id"], order="at").collect()))) == ["(1, 'a')", "(3, 'z')", "(None, 'm')"]


def test_version_sees_repeated_rows(spark):
    make = lambda rows: master.dataset_version(spark.createDataFrame(rows, "hsn_code string, key string, source string")).first()["version"]
    a, b = [("1", "x", "s")] * 2, [("2", "y", "s")] * 2
    assert make(a) != make(b) and make(a + b) == make(b + a)


def test_token_set_ratios():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = h[i - 1][j - 1] + 1 if x == y else max(h[i - 1][j], h[i][j - 1])
        return h[-1][-1]

    texts = ["blue steel anvil", "steel anvil blue", "red anvil", "anvil", "bleu stele", "", "x yz"]
    for a in texts:
        for b in texts:
            assert ratios.common_subsequence(a, b) == plain(a, b)
            x, y = set(a.split()), set(b.split())
            forms = [" ".join(filter(None, [" ".join(sorted(x & y)), " ".join(sorted(s))])) for s in (set(), x - y, y - x)]
            ratio = lambda p, q: 200 * plain(p, q) / (len(p) + len(q)) if p and q else 0.0
            want = 0.0 if not x or not y else max(ratio(forms[i], forms[j]) for i, j in ((0, 1), (0, 2), (1, 2)))
            assert abs(ratios.token_set_ratio(a, b) - want) < 1e-9


def test_prefix_filter_loses_no_pair(spark, sf_dir):
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type")).distinct().limit(60).collect()]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}
    for floor in (0.2, 0.5, 0.8):
        want = {(a, b) for a in names for b in names if len(grams(a) & grams(b)) >= floor * len(grams(a) | grams(b)) - 1e-12 and grams(a) & grams(b)}
        df = spark.createDataFrame([(n,) for n in names], "a string")
        got = {(r["a"], r["b"]) for r in similarity.trgm_pairs(df, df.withColumnRenamed("a", "b"), floor).collect()}
        assert got == want


def test_files(spark, tmp_path):
    (tmp_path / "ACME_FOODS.json").write_text('[{"Category_L2": "Other_Unclassified", "Description": "Tea 100G", "HSN_Ref": "0902", "GST_Ref": "GST 5%"}, {"Description": " ", "HSN_Ref": "1"}]')
    (tmp_path / "_index.json").write_text('[{"Description": "x", "HSN_Ref": "1"}]')
    r = files.read_product_batches(spark, str(tmp_path)).collect()
    assert [(x["brand"], x["hsn_code"], x["gst_rate"], x["category"]) for x in r] == [("ACME FOODS", "09020000", 5.0, None)]
    (tmp_path / "t.csv").write_text("hsn_code,description,gst_rate\n# note\n0902,tea,5%\n0902,green tea,5%\n")
    assert [(x["raw_hsn_code"], x["description"]) for x in files.read_tariff_csv(spark, str(tmp_path / "t.csv")).collect()] == [("0902", "green tea")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"entries": [{"language_code": "ml", "original_term": "x"}]}')
    (tmp_path / "c" / "b.json").write_text('[{"language_code": "hi", "original_term": "y"}]')
    assert sorted(x["original_term"] for x in files.read_alias_corpus(spark, str(tmp_path / "c")).collect()) == ["x", "y"]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("USER TERM "), F.col("user_id") % 50).alias("product_name"), F.col("user_id").alias("api_key"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), F.col("event_id"))).alias("normalized"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.stream_misses(source, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    key = lambda df: sorted(map(repr, ((r["name"], r["n"], r["normalized"], r["first_word"], r["updated"], r["normalized_at"]) for r in df.collect())))
    assert key(events.read_misses(spark, str(tmp_path / "table"))) == key(events.miss_counts(e))
    name = f"calls_{uuid.uuid4().hex}"
    q = events.stream_calls(source, 1, "3650 days").writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table(name).groupBy("api_key", "minute").agg(F.max("calls").alias("calls"))
    batch = events.calls_per_minute(e, 1).select("api_key", "minute", "calls")
    assert last.exceptAll(batch).count() == 0 and last.count() == batch.count()


def test_regional_chain_takes_each_of_its_steps(spark):
    catalog = spark.createDataFrame([(1, "spicy mango pickle", "20019000"), (2, "KAVYA steel ladle", "73239390"), (3, "Floor wiper long", "96039000")], "id long, description string, raw_code string")
    aliases = spark.createDataFrame([("achar", "20011000")], "alias string, code string")
    terms = spark.createDataFrame([("vellam", "jaggery", 2.0)], "term string, english string, weight double")
    foods = spark.createDataFrame([("maanga", "mango pickle")], "hint string, words string")
    asked = spark.createDataFrame([(1, "achar"), (2, "achar hot"), (3, "maanga hot jar of 12"), (4, "KAVYA steel deep ladle set box of kitchen"), (5, "nothing here")], "query_id long, text string")
    got = {r["query_id"]: (r["layer"], r["hsn_code"], r["confidence"], r["accepted"]) for r in cascade.match_regional(asked, aliases, terms, catalog, [], foods).collect()}
    assert got[1] == ("regional_alias", "20011000", 96, True) and got[2] == ("regional_alias", "20011000", 92, True)
    assert got[3] == ("food_hint", "20019000", 90, True) and got[4][1:] == ("73239390", 88, True) and 5 not in got
    assert 3 not in {r["query_id"] for r in cascade.match_regional(asked.filter("query_id = 3"), aliases, terms, catalog, []).filter("layer = 'food_hint'").collect()}
