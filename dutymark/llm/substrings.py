"""Substring deduplication with suffix automata of reference shards.

`remove_reference_spans` is the plain form: the reference is read in shards of bounded size, each shard's
automaton is broadcast, and documents stream past it for their matching statistics.

`duplicate_windows` uses the corpus as its own reference. Broadcasting that is not bounded, and each document
would have to stream past every shard. So the reference is sharded by content: the least hash of the short
runs within a window of WINDOW words (its anchor) depends on the window alone, so all windows with one anchor
meet in one shard, in order of (doc_id, start). A shard's automaton grows in that order; a window whose
matching length reaches WINDOW against it started earlier. Anchors that occur once are left out first, by
a bitmap of fixed size over exact counts; equal runs are judged once, and very common anchors are dealt
out window by window. Runs are told apart by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import row_key, saved, table
from dutymark.llm.textscan import window_hashes, word_hashes

#: Words of a window and of an anchor; log2 of the bitmap's bits; distinct runs of an anchor beyond which it is dealt by window.
WINDOW, ANCHOR, BITS, COMMON = 20, 7, 27, 256
#: Rows from which a run's key is hot, and such keys that are broadcast at most; all others join by a shuffle.
HOT, HOT_KEYS = 2_000, 100_000
#: Words of a broadcast reference shard.
SHARD_WORDS = 500_000


class SuffixAutomaton:
    """Automaton of all substrings of the word sequences added to it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _copy(self, p: int, q: int, w) -> int:
        """Split state q: its strings up to length[p] + 1 get a state of their own."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:  # known from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, w)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new

    def matching(self, words: list) -> Iterator[int]:
        """At each word, the length of the longest match that ends there."""
        state = size = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            yield size


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mask of the words that spans cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


def anchor_runs(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of windows with the same anchor."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    grams = window_hashes(hashes, anchor)
    spans = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    place = spans.argmin(1) + np.arange(len(spans))
    starts = np.flatnonzero(np.r_[True, np.diff(place) != 0])
    return grams[place[starts]].view(np.int64), starts.astype(np.int32), np.diff(np.r_[starts, len(spans)]).astype(np.int32)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [anchor_runs(word_hashes(t or b"")[0])[0] for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], ["a"])


def _runs(bitmap_b):
    """Runs of windows whose anchor is in the bitmap, with their words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmap_b.value
        names = ["a", "c", "doc", "rid", "start", "n", "words"]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out: list[list] = [[] for _ in names]
                for rid, doc, text in zip(*(b.column(k).slice(at, 500).to_pylist() for k in range(3)), strict=True):
                    data = text or b""
                    hashes, first, end = word_hashes(data)
                    a, start, n = anchor_runs(hashes)
                    bit = a.view(np.uint64) & np.uint64(2**BITS - 1)
                    hit = np.flatnonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    a, start, n = a[hit], start[hit], n[hit]
                    for k, s, m, low, high in zip(*(x.tolist() for x in (a, start, n, first[start], end[start + n + WINDOW - 2])), strict=True):
                        run = b" ".join(data[low:high].split())
                        for column, x in zip(out, (k, xxhash.xxh3_128_digest(run), doc, rid, s, m, run), strict=True):
                            column.append(x)
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return scan


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of the shard of a run: its anchor; for common anchors each window goes by its own hash."""
    for b in batches:
        rows = []
        for a, c, doc, start, words, n in zip(*(b.column(x).to_pylist() for x in ("a", "c", "doc", "start", "words", "n")), strict=True):
            if n <= COMMON:
                rows.append((a, c, doc, start, 0, words))
            else:
                own = words.split(b" ")
                for k in range(len(own) - WINDOW + 1):
                    part = b" ".join(own[k : k + WINDOW])
                    rows.append((int.from_bytes(xxhash.xxh3_64_digest(part), "big", signed=True), c, doc, start + k, k, part))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "c", "doc", "start", "offset", "words"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (key, doc, start): each is matched against the automaton of those before it, then added."""
    key, automaton = None, SuffixAutomaton()
    for b in batches:
        rows = []
        for k, c, offset, words in zip(*(b.column(x).to_pylist() for x in ("key", "c", "offset", "words")), strict=True):
            own = words.split(b" ")
            if k != key:
                key, automaton = k, SuffixAutomaton()
            else:
                found = [i - WINDOW + 1 for i, size in enumerate(automaton.matching(own)) if size >= WINDOW]
                if found:
                    rows.append((c, [offset + i for i in found]))
            automaton.add(own)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["c", "offsets"])


def _by_run(runs: DataFrame, told: DataFrame) -> DataFrame:
    """runs joined with told (c, times, ...): the most frequent runs by a broadcast of bounded size, all others by a shuffle."""
    hot = told.filter(F.col("times") >= HOT).orderBy(F.desc("times"), "c").limit(HOT_KEYS)
    hot = saved(hot, "hot")
    few = F.broadcast(hot.select("c"))
    return runs.join(F.broadcast(hot), "c").unionByName(runs.join(few, "c", "left_anti").join(told.join(few, "c", "left_anti"), "c"))


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """(rid, runs array<struct<start,n>>): windows of each document that also start earlier, as runs of first words."""
    spark = docs.sparkSession
    source = docs.select(row_key("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    counts = source.select("text").mapInArrow(_anchors, "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bit = F.col("a").bitwiseAND(F.lit(2**BITS - 1)) + 1
    cells = counts.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bitmap = np.zeros(2**BITS // 8, np.uint8)
    for r in cells.toLocalIterator():  # 4 KB a row, 2**BITS bits at most, whatever the input
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    runs = saved(source.mapInArrow(_runs(spark.sparkContext.broadcast(bitmap)), "a long, c binary, doc long, rid long, start int, n int, words binary"), "runs")

    place = F.struct("doc", "start")
    first = saved(runs.groupBy("c").agg(F.min(place).alias("first"), F.min("a").alias("a"), F.count(F.lit(1)).alias("times")), "first")
    mixed = first.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    judged = first.join(mixed, "a").select("c", "first", "times", F.col("n").alias("kinds"))
    heads = (
        _by_run(runs, judged).filter(place == F.col("first")).dropDuplicates(["c"])
        .select("a", "c", "doc", "start", "words", F.col("kinds").alias("n"))
        .mapInArrow(_deal, "key long, c binary, doc long, start int, offset int, words binary")
    )
    flagged = heads.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(_stream, "c binary, offsets array<int>")
    flagged = flagged.groupBy("c").agg(F.flatten(F.collect_list("offsets")).alias("offsets"))
    told = saved(first.join(flagged, "c", "left").filter("times > 1 or offsets is not null").select("c", "times", F.when(F.col("times") > 1, F.col("first")).alias("first"), "offsets"), "flagged")
    told = _by_run(runs.select("c", "doc", "rid", "start", "n"), told)
    whole = F.array(F.struct("start", "n"))
    parts = F.transform(F.coalesce("offsets", F.array().cast("array<int>")), lambda o: F.struct((F.col("start") + o).alias("start"), F.lit(1).alias("n")))
    told = told.select("rid", F.when(place > F.col("first"), whole).otherwise(parts).alias("runs")).filter("size(runs) > 0")
    return told.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            rows = []
            for text, runs in zip(b.column(1).slice(at, 200), b.column(2).slice(at, 200), strict=True):
                words = (text.as_py() or b"").split()
                gone = 0
                kept = words
                if runs.is_valid and len(runs.values):
                    start, n = (runs.values.field(k).to_numpy() for k in (0, 1))
                    mask = covered(len(words), start, n + WINDOW - 1)
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    gone = int(mask.sum())
                rows.append((len(words), gone, b" ".join(kept)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 200), *columns], ["doc_id", "n_words", "n_removed", "kept"])


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the words of windows that also start earlier.

    Earlier is a smaller doc_id (null first) or the same doc_id and an earlier start. Windows are judged on the
    input. kept holds the remaining words joined by one blank; null and empty texts have no words, texts under
    WINDOW words lose none, and repeated rows, equal in id and text, are treated alike.
    """
    runs = duplicate_windows(docs)
    source = docs.select(row_key("doc_id", "text").alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    joined = source.join(runs, "rid", "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(_strip, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without maximal spans of min_words words or more that occur in reference (a column text).

    The reference is cut into shards of about shard_words words; their automata are broadcast one after another, so
    memory is bounded by a shard and its longest text, and the work grows with the number of shards.
    """
    spark = docs.sparkSession
    texts = reference.filter("text is not null").select("text").distinct()
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (6 * shard_words)))
    source = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    source = saved(source, "streamed")
    spans = []
    for k in range(shards):
        automaton = SuffixAutomaton()
        for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).toLocalIterator():
            automaton.add(r["text"].encode().split())
        automaton_b = spark.sparkContext.broadcast(automaton)

        def match(batches: Iterator[pa.RecordBatch], automaton_b=automaton_b) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rids, runs = [], []
                for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sizes = list(automaton_b.value.matching((text or b"").split()))
                    # a span is maximal where the match does not go on
                    ends = [i for i, n in enumerate(sizes) if n >= min_words and (i + 1 == len(sizes) or sizes[i + 1] <= n)]
                    if ends:
                        rids.append(rid)
                        runs.append([{"start": i - sizes[i] + 1, "n": sizes[i] - WINDOW + 1} for i in ends])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(runs, kind)], ["rid", "runs"])

        spans.append(saved(source.select("rid", "text").mapInArrow(match, "rid long, runs array<struct<start:int,n:int>>"), "spans"))
    both = spans[0]
    for s in spans[1:]:
        both = both.union(s)
    runs = both.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    joined = source.join(runs, "rid", "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(_strip, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
