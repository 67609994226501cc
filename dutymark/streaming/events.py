"""Event tables: batch aggregates, and the same results from streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.functions import codes, text
from dutymark.operators.lookups import first_per

C = F.col

#: Confidence from which a result is stored.
ACCEPTED = 70


def miss_counts(events: DataFrame) -> DataFrame:
    """(name, n, normalized, first_word, updated, normalized_at): per product name cut to 500 letters; the last normal form that is not null and its time, the first word cut to 100."""
    e = events.withColumn("name", F.substring("product_name", 1, 500))
    g = e.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(C("normalized").isNotNull(), F.struct("ts", "event_id", "normalized"))).alias("last"), F.max("ts").alias("updated"))
    return g.select("name", "n", C("last.normalized").alias("normalized"), F.substring(F.substring_index("name", " ", 1), 1, 100).alias("first_word"), "updated", C("last.ts").alias("normalized_at"))


def cache_state(events: DataFrame, now: str, days: int = 30) -> DataFrame:
    """(key, source, confidence, hits, expires_at): newest stored result per key that has not expired; rows under 70 are not stored."""
    stored = first_per(events.filter(C("confidence") >= ACCEPTED), "product_name", F.desc("ts"), F.desc("event_id"))
    hits = events.groupBy("product_name").agg(F.count(F.lit(1)).alias("hits"))
    out = stored.withColumn("expires_at", C("ts") + F.expr(f"interval {days} days")).filter(C("expires_at") > F.lit(now).cast("timestamp"))
    return out.join(hits, "product_name").select(C("product_name").alias("key"), "source", "confidence", "hits", "expires_at")


def calls_per_minute(events: DataFrame, limit: int) -> DataFrame:
    """(api_key, minute, calls, over): tumbling minutes; works on streams with a watermark on ts."""
    g = events.groupBy("api_key", F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("calls"))
    return g.select("api_key", C("window.start").alias("minute"), "calls", (C("calls") > limit).alias("over"))


def warm_list(events: DataFrame, sources: list[str], most: int = 5000, least: int = 65) -> DataFrame:
    """Newest `most` events of the sources with the confidence, then the newest per text."""
    newest = events.filter(C("source").isin(sources) & (C("confidence") >= least)).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    return first_per(newest, "product_name", F.desc("ts"), F.desc("event_id"))


def warm_cache(events: DataFrame, tariff: DataFrame, sources: list[str], most: int = 5000, least: int = 65) -> DataFrame:
    """(product_name, cache_key, hsn_code, description, gst_rate, chapter, score, label, review): warm_list (with raw_code) joined to the tariff.

    The text of a code that the tariff lacks is `HSN` and the code. The key is that of the normal form of the name, or of the name where nothing is left of it; blank names go.
    """
    code = F.coalesce(F.nullif(codes.canonicalize_hsn(C("raw_code")), F.lit("")), C("raw_code"))
    newest = warm_list(events, sources, most, least).withColumn("hsn_code", code)
    one = first_per(tariff.select("hsn_code", C("description").alias("official"), "gst_rate"), "hsn_code", "official", "gst_rate")
    name = F.coalesce(F.nullif(text.normalize_name(C("product_name")), F.lit("")), F.trim("product_name"))
    score = C("confidence") / 100.0
    out = newest.join(one, "hsn_code", "left").withColumn("name", name).filter("name <> ''")
    return out.select(
        "product_name", text.cache_key(C("name")).alias("cache_key"), "hsn_code", F.coalesce(F.nullif(F.trim("official"), F.lit("")), F.concat(F.lit("HSN "), "hsn_code")).alias("description"), "gst_rate",
        F.when(F.length("hsn_code") >= 2, F.substring("hsn_code", 1, 2)).alias("chapter"), score.alias("score"), text.confidence_label(score).alias("label"), (score < 0.55).alias("review"),
    )


def stream_calls(stream: DataFrame, limit: int, delay: str = "10 minutes") -> DataFrame:
    """calls_per_minute of a stream; minutes close `delay` after their end."""
    return calls_per_minute(stream.withWatermark("ts", delay), limit)


def put_batches(table: DataFrame, path: str, checkpoint: str):
    """Write what a stream in update mode changes, each batch to a folder of its own, which a replayed batch overwrites; available data is read, then the query ends."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return table.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_batches(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The row of each key that the last batch to change it wrote."""
    df = spark.read.parquet(path)
    own = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*own), "batch").alias("r")).select(key, "r.*")


def stream_misses(stream: DataFrame, path: str, checkpoint: str):
    """miss_counts of a stream: counts and the last normal form are kept as aggregation state, so late rows and ties of ts count as in one batch."""
    return put_batches(miss_counts(stream), path, checkpoint)


def read_misses(spark: SparkSession, path: str) -> DataFrame:
    """miss_counts as the batches under path left them."""
    return newest_batches(spark, path, "name")


#: What a task makes of its rows of a key before they are dealt by key; times in microseconds, -1 without a stored result.
_SUMMED = "key string, n long, ts timestamp, stored_ts long, stored_id long, source string, confidence int"
_STATE = "n long, stored_ts long, stored_id long, source string, confidence int, expired boolean"
_CACHE = "key string, source string, confidence int, hits long, until long, expired boolean"


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each key of an Arrow batch: number of rows, last time, newest result to store."""
    for b in batches:
        rows = b.assign(at=b["micros"].where(b["confidence"] >= ACCEPTED, -1)).sort_values(["at", "event_id"])
        last = rows.groupby("key", as_index=False).agg(n=("at", "size"), ts=("ts", "max")).merge(rows.drop_duplicates("key", keep="last")[["key", "at", "event_id", "source", "confidence"]], on="key")
        none = last["at"] < 0
        yield last.assign(stored_ts=last["at"], stored_id=last["event_id"].where(~none, -1), source=last["source"].where(~none, None), confidence=last["confidence"].where(~none, -1).astype("int32"))[["key", "n", "ts", "stored_ts", "stored_id", "source", "confidence"]]


def stream_cache(stream: DataFrame, path: str, checkpoint: str, days: int = 30, delay: str = "1 day"):
    """cache_state of a stream (product_name, ts, event_id, source, confidence): the newest stored result and the hits of each key, as keyed state.

    A timer in event time expires the result `days` after it was stored, once no row older than `delay` can come; the key then gives a row with
    expired = true and keeps its hits alone. Rows later than `delay` are left out; null names and times too. Tasks sum their rows of a
    key before these are dealt by key, so that a popular key is a few rows.
    """
    life = days * 86_400_000_000

    def keep(key, batches, state):
        n, ts, number, source, confidence, expired = state.get if state.exists else (0, -1, -1, None, -1, False)
        if state.hasTimedOut:
            ts, number, source, confidence, expired = -1, -1, None, -1, True
        for b in batches:
            n += int(b["n"].sum())
            for r in b[b["stored_ts"] >= 0].itertuples():
                if (r.stored_ts, r.stored_id) > (ts, number):
                    ts, number, source, confidence, expired = int(r.stored_ts), int(r.stored_id), r.source, int(r.confidence), False
        if ts >= 0 and (ts + life) // 1000 <= state.getCurrentWatermarkMs():
            ts, number, source, confidence, expired = -1, -1, None, -1, True
        state.update((n, ts, number, source, confidence, expired))
        if ts >= 0:
            state.setTimeoutTimestamp((ts + life) // 1000)
        until = pd.array([ts + life if ts >= 0 else None], "Int64")
        yield pd.DataFrame({"key": [key[0]], "source": [source], "confidence": pd.array([confidence if ts >= 0 else None], "Int32"), "hits": [n], "until": until, "expired": [expired]})

    rows = stream.select(C("product_name").alias("key"), "ts", F.unix_micros("ts").alias("micros"), C("event_id").cast("long").alias("event_id"), "source", C("confidence").cast("int").alias("confidence")).filter("key is not null and ts is not null")
    summed = rows.withColumn("confidence", F.coalesce("confidence", F.lit(-1))).mapInPandas(_summed, _SUMMED).withWatermark("ts", delay)
    kept = summed.groupBy("key").applyInPandasWithState(keep, _CACHE, _STATE, "update", "EventTimeTimeout")
    return put_batches(kept.select("key", "source", "confidence", "hits", F.timestamp_micros("until").alias("expires_at"), "expired"), path, checkpoint)


def read_cache(spark: SparkSession, path: str, now: str) -> DataFrame:
    """cache_state as the batches under path left it: results that have not expired."""
    return newest_batches(spark, path, "key").filter(C("expires_at") > F.lit(now).cast("timestamp")).select("key", "source", "confidence", "hits", "expires_at")
