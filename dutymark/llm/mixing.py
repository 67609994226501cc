"""Mix sources to target weights by Poisson replication.

Source s with size n_s of total n and target weight w_s has the mean repetition rate
rate_s = w_s * n / n_s. Each document draws its count from the Poisson distribution with that
mean by inverting its cumulative distribution at a number hashed from seed and id, is exploded
by the count, and all copies are dealt out and ordered by a hash of (seed, id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import table

SEED = "mix-1"
#: Default targets: source sizes to this power, normed. Below 1 it lifts small sources.
TEMPERATURE = 0.7
#: Beyond so many sources their rates are joined by a shuffle, not broadcast.
MAX_BROADCAST_SOURCES = 10_000


def hash_unit(text: Column) -> Column:
    """A number in (0, 1) from 48 bits of the md5 of text."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k) for k = 0.. to 12 deviations and 20 above the mean; nothing within reach of 48 bits lies beyond."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("cum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        cum = acc["cum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), cum.alias("cum"), F.concat(acc["cdf"], F.array(cum)).alias("cdf"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"]))


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """(source, n, weight, rate), one row per source; a null source counts as ''. targets: source -> weight, normed over the sources that occur; a source without one gets 0."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        entries = [F.lit(x) for k, v in targets.items() for x in (k, float(v))]
        raw = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("source")), F.lit(0.0)) if entries else F.lit(0.0)
    sizes = sizes.withColumn("raw", raw)
    total = sizes.agg(F.sum("raw").alias("raw_total"), F.sum("n").alias("n_total"))
    weight = F.when(F.col("raw_total") > 0, F.col("raw") / F.col("raw_total")).otherwise(F.lit(0.0))
    return sizes.join(F.broadcast(total)).select("source", "n", weight.alias("weight"), (weight * F.col("n_total") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' columns, each row repeated by its Poisson count, plus copy (from 1) and mix_key, in a global random order.

    mix_key orders the whole output; rows are dealt to partitions by its hash and sorted by it within.
    Equal ids draw equal numbers; a null id counts as ''. Columns of docs named copy or mix_key are replaced.
    An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    rates = source_rates(docs, targets, temperature, source_col).select(F.col("source").alias("__mix_source"), poisson_cdf(F.col("rate")).alias("__mix_cdf"))
    few = len(rates.select("__mix_source").limit(MAX_BROADCAST_SOURCES + 1).collect()) <= MAX_BROADCAST_SOURCES
    ident = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = (
        docs.select(*kept)
        .withColumn("__mix_source", F.coalesce(F.col(source_col), F.lit("")))
        .join(F.broadcast(rates) if few else rates, "__mix_source")
        .withColumn("__mix_unit", hash_unit(ident))
        .withColumn("__mix_n", F.size(F.filter("__mix_cdf", lambda c: c < F.col("__mix_unit"))))
        .filter("__mix_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
        .withColumn("mix_key", F.md5(F.concat_ws(":", ident, F.col("copy")).cast("binary")))
    )
    return drawn.select(*kept, "copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with sizes as (select coalesce(source, '') as src, count(*) as n from documents group by 1),
rates as (select src, pow(n, {TEMPERATURE}) / (select sum(pow(n, {TEMPERATURE})) from sizes) * (select sum(n) from sizes) / n as rate from sizes),
cdf as (select src, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by src order by k) as c
        from rates, lateral (select unnest(generate_series(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as bigint))) as k)),
lists as (select src, list(c order by k) as cdf from cdf group by src),
drawn as (select d.*, '{SEED}:' || coalesce(cast(doc_id as varchar), '') as ident, l.cdf,
        (cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) + 0.5) / 281474976710656.0 as u
        from documents d join lists l on coalesce(d.source, '') = l.src),
counted as (select *, len(list_filter(cdf, lambda x: x < u)) as m from drawn)
select doc_id, text, lang, source, n_chars, cast(k as integer) as copy, md5(ident || ':' || k) as mix_key
from counted, lateral (select unnest(generate_series(1, m)) as k)
"""
