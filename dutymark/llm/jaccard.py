"""Similarity join on five-word shingles with Bayesian pruning.

1. Each distinct text gets HASHES minima; BANDS bands of ROWS of them name buckets.
2. A text's home is the most frequent of the buckets that it shares; a home is dealt to blocks of bounded size.
   Two blocks are compared only if a bucket has texts in both, and only with the texts of such buckets.
3. A task compares two blocks: pairs that share a band are compared
   STEP minima at a time and dropped once P(similarity >= threshold | matches so far) < TOLERANCE;
   the rest is verified on the whole shingle sets. A task returns a row per text, never its pairs.
4. Verified links are joined into classes.

Texts are told apart by 64-bit hashes: of n different texts n ** 2 / 2 ** 65 pairs are expected to be taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import row_key, saved, spare, table
from dutymark.llm.components import components, star
from dutymark.llm.textscan import window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 20 bands of 4: a pair at 0.8 shares none with probability 3e-5.
BANDS, ROWS, STEP, TOLERANCE = 20, 4, 16, 1e-6
HASHES = BANDS * ROWS
#: Texts and shingles of a block, and pairs whose minima are compared at once.
BLOCK, BLOCK_SHINGLES, AT_ONCE = 512, 1_000_000, 100_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)


@cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each n = STEP, 2 STEP..: the fewest matches of n with P(s >= threshold | matches) >= tolerance, s uniform beforehand."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log_p = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log_p - log_p.max())
            if p[grid >= threshold].sum() >= tolerance * p.sum():
                out.append(m)
                break
    return tuple(out)


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; under five words all words make one shingle, no word none."""
    words = word_hashes(data)[0]
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def minima(own: np.ndarray) -> np.ndarray:
    """High halves of the least values under HASHES linear permutations of 64 bits."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(out, (own[at : at + 512, None] * _A + _B).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band, for a signature or a matrix of them."""
    x = signature.reshape(*signature.shape[:-1], BANDS, ROWS).astype(np.uint64)
    out = x[..., 0] + np.arange(BANDS, dtype=np.uint64) * np.uint64(2**32)
    for j in range(1, ROWS):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[..., j]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gids, sizes, rows = [], [], []
        for gid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = shingles(text.as_py() or b"")
            if len(own):
                gids.append(gid)
                sizes.append(len(own))
                rows.append(bands_of(minima(own)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["gid", "size", "bands"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            own = [shingles(t.as_py() or b"") for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("gid", "block", "copies", "pairs")] + [pa.array([s.tobytes() for s in own], pa.binary()), pa.array([minima(s).tobytes() for s in own], pa.binary())],
                ["gid", "block", "copies", "pairs", "shingles", "signature"],
            )


def _candidates(left: np.ndarray, right: np.ndarray, same: bool, bands: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows that share a band and whose sizes allow the threshold, some left rows at a time."""
    rows = max(1, AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), rows):
        own = left[at : at + rows]
        near = bands[own, 0][:, None] == bands[right, 0][None, :]
        for k in range(1, BANDS):
            near |= bands[own, k][:, None] == bands[right, k][None, :]
        low, high = np.minimum(sizes[own][:, None], sizes[right][None, :]), np.maximum(sizes[own][:, None], sizes[right][None, :])
        near &= low >= threshold * high
        i, j = np.nonzero(near)
        i, j = own[i], right[j]
        yield (i[i < j], j[i < j]) if same else (i, j)


def linked_pairs(left: list[int], right: list[int], sets: list[np.ndarray], signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs between left and right (i < j if they are the same block) whose similarity reaches threshold."""
    sizes = np.array([len(s) for s in sets])
    live_i, live_j = [np.empty(0, int)], [np.empty(0, int)]
    for i, j in _candidates(np.array(left), np.array(right), left is right, bands_of(signatures), sizes, threshold):
        matches = np.zeros(len(i), int)
        for step, least in enumerate(least_matches(threshold)):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (signatures[i, part] == signatures[j, part]).sum(1)
            live = matches >= least
            i, j, matches = i[live], j[live], matches[live]
        live_i.append(i)
        live_j.append(j)
    i, j = np.concatenate(live_i), np.concatenate(live_j)
    if not len(i):
        return i, j
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    ok = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    mask = np.zeros(codes.max() + 1, np.int32)
    for chunk in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = codes[begins[i[chunk[0]]] : ends[i[chunk[0]]]]
        mask[own] = 1
        for part in np.split(chunk, range(64, len(chunk), 64)):
            to = j[part]
            both = np.add.reduceat(mask[np.concatenate([codes[begins[k] : ends[k]] for k in to])], np.cumsum(sizes[to]) - sizes[to])
            ok[part] = both >= threshold * (len(own) + sizes[to] - both) - 1e-9
        mask[own] = 0
    return i[ok], j[ok]


def _compare(threshold: float):
    def compare(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        block = t.column("block").to_pylist()
        gid, copies = t.column("gid").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        signatures = np.array([np.frombuffer(s, np.uint32) for s in t.column("signature").to_pylist()])
        left = [k for k, b in enumerate(block) if b == x]
        right = left if x == y else [k for k, b in enumerate(block) if b == y]
        i, j = linked_pairs(left, right, sets, signatures, threshold) if left and right else (np.empty(0, int),) * 2
        links = np.zeros(len(gid), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = gid.copy()
        while True:  # smallest gid of each linked part of these rows
            before = label.copy()
            np.minimum.at(label, i, before[j])
            np.minimum.at(label, j, before[i])
            if (before == label).all():
                break
        linked = links > 0
        return pa.table({"gid": gid[linked], "near": label[linked], "links": links[linked]})

    return compare


def dealt_blocks(signed: DataFrame) -> DataFrame:
    """(gid, block, pairs array<struct<x,y>>): the block of each text that shares a bucket, and the pairs of blocks it is compared in.

    Blocks are numbered by a hash; two that share a number are compared as one.
    """
    cells = signed.select("gid", "size", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cells = saved(cells.join(shared, "bucket"), "cells")
    home = cells.groupBy("gid").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.max("size").alias("size"))
    parts = home.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = saved(home.join(parts, "home").select("gid", F.xxhash64("home", F.pmod(F.xxhash64(F.lit("block"), "gid"), F.col("parts"))).alias("block")), "blocks")
    at = cells.select("gid", "bucket").join(placed, "gid")
    spread = at.groupBy("bucket").agg(F.collect_set("block").alias("blocks")).filter("size(blocks) > 1")
    other = at.join(spread, "bucket").groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("others"))
    pair = lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y"))
    return placed.join(other, "gid", "left").select("gid", "block", F.transform(F.array_union(F.array("block"), F.coalesce("others", F.array("block"))), pair).alias("pairs"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, class_id, n_links, is_first), one row per input row.

    rid is the hash of id and text, class_id the smallest doc_id of a class, n_links the number of other rows
    whose similarity reaches threshold (copies included), is_first marks the rows that stand for their class
    (repeated rows, equal in id and text, are all marked). Words are separated by ASCII white space and kept
    as they are. A text without words (null, empty) is in a class of its own and has no link; an empty table
    gives an empty table; a null id comes before all others.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = source.select("doc_id", row_key("doc_id", "text").alias("rid"), F.xxhash64("text").alias("gid"))
    copies = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "rid")).alias("own"))
    texts = source.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("gid"), F.col("text").cast("binary").alias("text"))
    signed = saved(texts.mapInArrow(_signatures, "gid long, size long, bands array<long>").dropDuplicates(["gid"]), "signatures")

    # equal texts are made one before the join, so that a text with many copies is not gathered in one task
    members = (
        texts.dropDuplicates(["gid"]).join(dealt_blocks(signed), "gid").join(copies.select("gid", "copies"), "gid")
        .select("gid", "block", "copies", "pairs", "text")
        .mapInArrow(_members, "gid long, block long, copies long, pairs array<struct<x:long,y:long>>, shingles binary, signature binary")
        .select("gid", "block", "copies", "shingles", "signature", F.inline("pairs"))
    )
    found = saved(members.groupBy("x", "y").applyInArrow(_compare(threshold), "gid long, near long, links long"), "links")
    classes = components(star(found, "gid", "near")).withColumnRenamed("node", "gid")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    # one row per distinct text: rows with many copies are joined once, against it
    told = signed.select("gid", F.lit(True).alias("worded")).join(copies, "gid").join(classes, "gid", "left").join(links, "gid", "left")
    told = saved(told.select("gid", "worded", "own", F.coalesce("label", "gid").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    first = told.groupBy("label").agg(F.min("own").alias("first"))
    out = rows.join(told.join(first, "label").select("gid", "first", "n_links"), "gid", "left")
    return out.select(
        "rid", "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("is_first"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each class, with its columns; repeated rows become one."""
    rid = spare(docs, "rid")
    first = near_duplicates(docs, threshold).filter("is_first").select(F.col("rid").alias(rid)).distinct()
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    return keyed.join(first, rid, "left_semi").dropDuplicates([rid]).select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
