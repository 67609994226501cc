import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from dutymark.llm import classifier, quality_rules
from dutymark.llm.common import crc_mod
from dutymark.llm.docstats import repeated_words, with_stats
from dutymark.llm.quality_rules import Forest, fit_forest, judge, keep_good
from tests.llm.cases import awkward_docs, no_docs, texts_of

LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_plain_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(awkward_docs(spark).select("doc_id", "text"))
    got = sorted(map(repr, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in with_stats(docs).collect())))
    assert got == sorted(repr((d, *plain_counts(t))) for d, t in texts_of(docs))


def test_repeats_with_a_large_vocabulary():
    ids = np.r_[np.arange(9000), np.arange(100, 130), np.arange(9000, 9100)]
    assert repeated_words(ids) == 60


def test_forest_tells_junk_from_good():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.05, 0.01, (800, 3)), rng.normal(0.6, 0.1, (100, 3))
    both = np.vstack([good, bad])
    forest = Forest.grow(good[:400], both.min(0), both.max(0))
    assert np.quantile(forest.score(good), 0.99) < np.quantile(forest.score(bad), 0.01)
    assert Forest.grow(np.empty((0, 3)), np.zeros(3), np.zeros(3)).score(bad).max() == 0


def test_rules_keep_clean_and_reject_junk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    forest = fit_forest(docs, labels)
    rows = judge(docs, forest).join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    kept = {r["doc_id"] for r in judge(docs, forest).filter("kept").collect()}
    assert {r["doc_id"] for r in keep_good(docs, forest).collect()} == kept


def rows_with_late_bad_ones(spark, salt, n):
    """Documents and labels; the bad ones are those after the first n in the order of a hash."""
    late = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id")) > n
    rows = spark.range(n + 400).withColumnRenamed("id", "doc_id").withColumn("bad", late)
    plain = F.concat(*[F.concat(F.lit(f"word{k}x"), F.col("doc_id") % (k + 7), F.lit(" ")) for k in range(15)])
    text = F.when(F.col("bad"), F.concat(plain, F.lit("### !!! $$$ ### !!!"))).otherwise(plain)
    return rows.select("doc_id", text.alias("text")), rows.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality"))


def test_every_labelled_row_counts(spark):
    docs, labels = rows_with_late_bad_ones(spark, "forest", 20_000)
    kept = judge(docs, fit_forest(docs, labels)).filter("kept").join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in kept} == {1: 20_000}


def test_classifier_learns_from_every_labelled_row(spark):
    docs, labels = rows_with_late_bad_ones(spark, "kernel", 30_000)
    found = classifier.score(docs, classifier.fit(docs, labels)).join(labels, "doc_id").groupBy("quality").agg(F.min("score").alias("least"), F.max("score").alias("most")).collect()
    found = {r["quality"]: r for r in found}
    assert found[0]["most"] < 0.3 <= found[1]["least"]


def test_trees_count_all_rows():
    x = np.random.default_rng(3).beta(1, 9, (5000, 3))
    forest = Forest.grow(x, np.zeros(3), np.ones(3), trees=5)
    for root in forest.roots.tolist():
        todo = [(root, np.arange(len(x)), 0)]
        while todo:
            node, own, depth = todo.pop()
            share = len(own) * quality_rules.TREE_ROWS / len(x)
            if forest.feature[node] < 0:
                assert (share < 2 or depth == 16) and np.isclose(forest.path[node], depth + quality_rules.harmonic_depth(share))
            else:
                assert share >= 2 and depth < 16
                right = x[own, forest.feature[node]] >= forest.cut[node]
                todo += [(int(forest.left[node]) + side, own[right == side], depth + 1) for side in (0, 1)]


def test_rules_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    empty = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 1, 0), (1, 0, 0), (10, 1, None), (6, 1, 0)], LABELS)
    for labels in (empty, odd):
        forest = fit_forest(docs, labels)
        assert judge(docs, forest).count() == docs.count()
        assert keep_good(docs, forest).columns == docs.columns
        assert judge(no_docs(spark), forest).count() == 0
    assert all(not r["kept"] for r in judge(docs, forest).filter("doc_id in (3, 4, 5)").collect())


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    rows = classifier.score(docs, model).join(labels.filter(crc_mod("doc_id", 5) == 0), "doc_id").select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_ignores_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in classifier.score(docs, classifier.fit(docs, x, crc_mod("doc_id", 5) != 0)).collect()) for x in (labels, turned))
    assert np.allclose([s for _, s in a], [s for _, s in b])


def test_classifier_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0)], LABELS)):
        rows = classifier.score(docs, classifier.fit(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert classifier.score(no_docs(spark), classifier.fit(no_docs(spark), labels)).count() == 0


def test_pooled_is_monotone():
    rng = np.random.default_rng(2)
    score = rng.integers(0, 20, 300) / 20
    knots, values = classifier.pooled(score, (rng.random(300) < score).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 < values.min() <= values.max() < 1


def test_crc_matches_zlib(spark):
    rows = spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_base_rule_edges():
    assert quality_rules.base_fails(9, 0) and not quality_rules.base_fails(10, 2) and quality_rules.base_fails(10, 3)


def test_kept_equals_a_plain_walk_through_the_trees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = fit_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {}
    for d, t in texts_of(docs):
        counts, ratios = quality_rules.stats((t or "").encode())
        x, total = [ratios[k] for k in quality_rules._AT], 0.0
        for node in forest.roots.tolist():
            while forest.feature[node] >= 0:
                node = int(forest.left[node]) + (x[forest.feature[node]] >= forest.cut[node])
            total += forest.path[node]
        score = 2 ** (-total / len(forest.roots) / forest.norm)
        want[d] = counts[0] >= 10 and 100 * plain_counts(t)[4] <= 20 * counts[0] and score <= forest.threshold
    assert {r["doc_id"]: r["kept"] for r in judge(docs, forest).collect()} == want
