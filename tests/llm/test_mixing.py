import math

from pyspark.sql import functions as F

from dutymark.llm.mixing import hash_unit, mix, poisson_cdf, source_rates
from tests.llm.cases import awkward_docs, no_docs


def test_poisson_table(spark):
    for rate in (0.3, 5.0, 900.0):
        cdf = spark.range(1).select(poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        want, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            want.append(total)
        assert max(abs(a - b) for a, b in zip(cdf, want, strict=True)) < 1e-9 and abs(cdf[-1] - 1) < 1e-9


def test_weights_are_met(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    out = mix(docs, {"big": 1.0, "small": 3.0})
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    assert abs(total / 40_000 - 1) < 0.03 and abs(n["small"] / total - 0.75) < 0.02
    again = mix(docs, {"big": 1.0, "small": 3.0})
    assert out.exceptAll(again).count() == 0
    assert mix(docs, {"big": 1.0}).filter("source = 'small'").count() == 0


def test_units_are_uniform(spark):
    u = [r["u"] for r in spark.range(2000).select(hash_unit(F.concat(F.lit("s:"), F.col("id").cast("string"))).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = mix(docs)
    assert [c for c in out.columns if c not in ("copy", "mix_key")] == [c for c in docs.columns if c != "copy"]
    counts = {}
    for r in out.filter("doc_id = 1").collect():
        counts[r["copy"]] = counts.get(r["copy"], 0) + 1
    assert all(n == 2 for n in counts.values())
    assert {r["source"] for r in source_rates(docs).collect()} == {"", "a", "b", "c"}
    assert mix(no_docs(spark)).count() == 0 and mix(docs, {}).count() == 0
