"""Streams give what one batch over the same rows gives: ties, late rows, replays, expiry."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dutymark.streaming import events

SCHEMA = "event_id long, ts timestamp, product_name string, source string, confidence int, normalized string"
START = datetime(2024, 1, 1)


def rows_of(rng, n, hours, first=0):
    return [
        (first + i, START + timedelta(hours=rng.randrange(hours)), rng.choice(["USER A", "USER B", "x" * 600, "hot", "hot", "hot", ""]), rng.choice(["click", "view", None]), rng.choice([None, 10, 69, 70, 95]), rng.choice([None, "aa", "ZZ", "mm"]))
        for i in range(n)
    ]


def stream_of(spark, parts, path):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def shown(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_misses_with_ties_and_late_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = rows_of(rng, 200, 6)  # few hours: many ties of ts
    rng.shuffle(rows)
    source = stream_of(spark, [rows[:90], rows[90:110], rows[110:]], str(tmp_path / "in"))
    events.stream_misses(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ("name", "n", "normalized", "first_word", "updated", "normalized_at")
    assert shown(events.read_misses(spark, str(tmp_path / "out")), *columns) == shown(events.miss_counts(spark.createDataFrame(rows, SCHEMA)), *columns)
    # more rows later: the same checkpoint goes on
    more = rows_of(rng, 30, 6, 1000)
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "late"))
    events.stream_misses(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert shown(events.read_misses(spark, str(tmp_path / "out")), *columns) == shown(events.miss_counts(spark.createDataFrame(rows + more, SCHEMA)), *columns)


def test_cache_with_ties_and_late_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = rows_of(rng, 200, 12)
    rng.shuffle(rows)
    source = stream_of(spark, [rows[:50], rows[50:140], rows[140:]], str(tmp_path / "in"))
    events.stream_cache(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ("key", "source", "confidence", "hits", "expires_at")
    now = str(START + timedelta(days=20))
    want = shown(events.cache_state(spark.createDataFrame(rows, SCHEMA), now), *columns)
    assert len(want) == 5 and shown(events.read_cache(spark, str(tmp_path / "out"), now), *columns) == want
    assert shown(events.read_cache(spark, str(tmp_path / "out"), str(START + timedelta(days=31))), *columns) == []


def test_cache_expires_by_timer_and_comes_back(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    parts = [
        [(1, day(0), "a", "s1", 90, None), (2, day(0), "b", "s1", 80, None)],
        [(3, day(20), "b", "s2", 75, None), (4, day(21), "a", "s9", 10, None)],
        [(5, day(40), "c", "s3", 90, None)],  # a has expired, b has not
        [(6, day(41), "c", "s4", 60, None)],
        [(7, day(42), "a", "s5", 70, None)],
    ]
    source = stream_of(spark, parts, str(tmp_path / "in"))
    events.stream_cache(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    every = spark.read.parquet(str(tmp_path / "out"))
    assert every.filter("key = 'a' and expired").count() == 1 and every.filter("key <> 'a' and expired").count() == 0
    got = {r["key"]: (r["source"], r["confidence"], r["hits"], r["expires_at"]) for r in events.read_cache(spark, str(tmp_path / "out"), str(day(43))).collect()}
    assert got == {"a": ("s5", 70, 3, day(72)), "b": ("s2", 75, 2, day(50)), "c": ("s3", 90, 2, day(70))}
    state = events.newest_batches(spark, str(tmp_path / "out"), "key")
    assert state.count() == 3 and state.filter(F.col("expires_at").isNull()).count() == 0
