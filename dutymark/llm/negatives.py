"""Hard negatives: different-label rows scoring within a band under each positive, found through segment summaries.

A vector cut into segments of L components has for each its mean m and deviation d (root of the summed squares
about the mean). The product of two vectors then lies within sum(L * m * m') -+ sum(d * d'), by Cauchy-Schwarz.
Bounds of few long segments are cheap and wide; pairs that they cannot settle get twice as many segments, and
only what is left after the last level gets the exact integer product.

1. Rows and anchors meet in cells: rows are dealt evenly, each block of anchors goes to every cell of rows.
2. A first pass finds each anchor's best rows of its label; cells keep their own best, a window merges them.
3. A second pass finds the best rows of other labels within the bands that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dutymark.llm.common import saved, table
from dutymark.llm.vectors import integers, products, usable

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a cell at most, least number of rows worth a cell of its own, cells wanted, anchors of a block.
CELL_ROWS, LEAST_ROWS, CELLS, BLOCK = 32_768, 1_024, 64, 2_048
#: Segments of the levels (as far as the vectors are longer), and the share of open pairs under which single pairs are bounded.
LEVELS, SPARSE = (4, 8, 16, 32), 0.02
#: Rows and anchors of a matrix, pairs at once.
TILE_ROWS, TILE_ANCHORS, PAIRS = 8_192, 256, 262_144


class Summary:
    """Segment means (times the root of the segment's length) and deviations of integer vectors, by level."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, n, size = x, len(x), x.shape[1]
        self.norm = np.sqrt(np.square(x.astype(np.float64)).sum(1))
        self.levels = []
        for count in (c for c in LEVELS if c < size):
            width = -(-size // count)
            padded = np.zeros((n, count * width))
            padded[:, :size] = x
            parts = padded.reshape(n, count, width)
            mean = parts.mean(2)
            self.levels.append((mean * np.sqrt(width), np.sqrt(np.square(parts - mean[..., None]).sum(2))))


class Pairs:
    """Open pairs of anchors and rows, narrowed level by level; `settled` counts those closed by each level."""

    def __init__(self, anchors: Summary, rows: Summary, open_: np.ndarray) -> None:
        self.anchors, self.rows, self.open, self.level, self.settled = anchors, rows, open_, 0, []
        # the bounds' own rounding
        self.slack = 1e-9 * (anchors.norm[:, None] * rows.norm + 1)

    def refined(self, keep) -> bool:
        """Next level: keep(low, high, anchor) tells which pairs stay open. False after the last level."""
        if self.level == len(self.anchors.levels):
            return False
        (m, d), (m2, d2) = self.anchors.levels[self.level], self.rows.levels[self.level]
        self.level += 1
        before = int(self.open.sum())
        if before > SPARSE * self.open.size:
            middle, reach = m @ m2.T, d @ d2.T + self.slack
            self.open &= keep(middle - reach, middle + reach, np.arange(len(m))[:, None])
        elif before:
            a, r = np.nonzero(self.open)
            for at in range(0, before, PAIRS):
                i, j = a[at : at + PAIRS], r[at : at + PAIRS]
                middle, reach = np.einsum("ij,ij->i", m[i], m2[j]), np.einsum("ij,ij->i", d[i], d2[j]) + self.slack[i, j]
                self.open[i, j] = keep(middle - reach, middle + reach, i)
        self.settled.append(before - int(self.open.sum()))
        return True

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of the pairs still open, by anchor and row."""
        a, r = np.nonzero(self.open)
        if len(a) > SPARSE * self.open.size:
            return a, r, products(self.anchors.x, self.rows.x)[a, r]
        parts = [np.einsum("ij,ij->i", self.anchors.x[a[k : k + PAIRS]], self.rows.x[r[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)]
        return a, r, np.concatenate(parts) if parts else np.empty(0, np.int64)


def firsts(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k different (score, id) of each anchor, by falling score and rising id."""
    order = np.lexsort((ids, -score, a))
    a, ids, score = a[order], ids[order], score[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    order, a = order[new], a[new]
    begins = np.searchsorted(a, a, "left")
    return order[np.arange(len(a)) - begins < k]


def best_alike(anchors: Summary, ids: np.ndarray, rows: Summary, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of each anchor's first k rows but those with its own id.

    The rows with the best upper bounds are scored first: the k-th of them is the score that the others must be able to reach.
    """
    pairs = Pairs(anchors, rows, ids[:, None] != row_ids)
    reach = np.full(len(ids), -np.inf)
    taken = min(4 * k, len(row_ids))
    if anchors.levels and len(row_ids) > 8 * k:
        (m, d), (m2, d2) = anchors.levels[0], rows.levels[0]
        upper = np.where(pairs.open, m @ m2.T + d @ d2.T, -np.inf)
        likely = np.argpartition(-upper, taken - 1, axis=1)[:, :taken]
        a = np.repeat(np.arange(len(ids)), taken)
        r = likely.ravel()
        fine = pairs.open[a, r]
        a, r = a[fine], r[fine]
        score = np.einsum("ij,ij->i", anchors.x[a], rows.x[r])
        chosen = firsts(a, row_ids[r], score, k)
        of, worst = a[chosen], score[chosen]
        full = np.bincount(of, minlength=len(ids)) == k
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, of, worst)
        reach[full] = least[full]
        while pairs.refined(lambda low, high, i: high >= reach[i]):
            pass
    a, r, score = pairs.scores()
    chosen = firsts(a, row_ids[r], score, k)
    return a[chosen], r[chosen], score[chosen]


def band(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer s with low * positive <= 100 * s <= high * positive; empty where the least is greater."""
    return -(-low * positive // 100), high * positive // 100


def best_other(anchors: Summary, rows: Summary, row_ids: np.ndarray, open_: np.ndarray, bands: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, row, score) of each band's first k rows. bands: anchor, least, greatest; rising by anchor."""
    of, least, most = bands
    low_of, high_of = np.full(len(anchors.x), np.iinfo(np.int64).max), np.full(len(anchors.x), np.iinfo(np.int64).min)
    np.minimum.at(low_of, of, least)
    np.maximum.at(high_of, of, most)
    pairs = Pairs(anchors, rows, open_)
    while pairs.refined(lambda low, high, i: (high >= low_of[i]) & (low <= high_of[i])):
        pass
    a, r, score = pairs.scores()
    begins, ends = np.searchsorted(a, of, "left"), np.searchsorted(a, of, "right")
    count = ends - begins
    which = np.repeat(np.arange(len(of)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
    fine = (score[at] >= least[which]) & (score[at] <= most[which])
    which, at = which[fine], at[fine]
    chosen = firsts(which, row_ids[r[at]], score[at], k)
    return which[chosen], r[at[chosen]], score[at[chosen]]


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(low, min(low + size, n)) for low in range(0, n, size))


def _longs(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def _positives_of(size: int, scale: int, k: int):
    """Of the anchors and rows of a cell, each anchor's first k rows of its label."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"akey": [], "anchor_id": [], "label": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            keys, ids, labels, row_ids, row_labels = _longs(left, "akey"), _longs(left, "id"), _longs(left, "label"), _longs(right, "row_id"), _longs(right, "row_label")
            x, y = integers(left.column("vector"), scale, size), integers(right.column("row_vector"), scale, size)
            for label in np.intersect1d(labels, row_labels):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                for s in _tiles(len(theirs), TILE_ROWS):
                    rows = Summary(y[theirs[s]])
                    for t in _tiles(len(mine), TILE_ANCHORS):
                        a, r, score = best_alike(Summary(x[mine[t]]), ids[mine[t]], rows, row_ids[theirs[s]], k)
                        a, r = mine[t][a], theirs[s][r]
                        for name, value in zip(out, (keys[a], ids[a], labels[a], row_ids[r], score), strict=True):
                            out[name].append(value)
        return pa.table({name: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for name, v in out.items()})

    return find


def _negatives_of(size: int, scale: int, k: int, low: int, high: int):
    """Of the anchors (with their positives' scores) and rows of a cell, the first k rows of another label within each band."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"akey": [], "anchor_id": [], "positive_score": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            keys, ids, labels, row_ids, row_labels = _longs(left, "akey"), _longs(left, "id"), _longs(left, "label"), _longs(right, "row_id"), _longs(right, "row_label")
            x, y = integers(left.column("vector"), scale, size), integers(right.column("row_vector"), scale, size)
            scores = left.column("scores").combine_chunks()
            count, flat = scores.value_lengths().to_numpy(), scores.flatten().to_numpy()
            begin = np.cumsum(count) - count
            for s in _tiles(len(row_ids), TILE_ROWS):
                rows = Summary(y[s])
                for t in _tiles(len(ids), TILE_ANCHORS):
                    of = np.repeat(np.arange(t.stop - t.start), count[t])
                    score = flat[begin[t.start] : begin[t.start] + len(of)]
                    least, most = band(score, low, high)
                    live = least <= most
                    of, least, most, score = of[live], least[live], most[live], score[live]
                    if not len(of):
                        continue
                    open_ = (labels[t, None] != row_labels[s]) & (ids[t, None] != row_ids[s])
                    which, r, found = best_other(Summary(x[t]), rows, row_ids[s], open_, (of, least, most), k)
                    a = of[which] + t.start
                    for name, value in zip(out, (keys[a], ids[a], score[which], row_ids[s][r], found), strict=True):
                        out[name].append(value)
        return pa.table({name: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for name, v in out.items()})

    return find


def _meet(anchors: DataFrame, rows: DataFrame, find, schema: str) -> DataFrame:
    """find(anchors, rows) for each block of anchors and cell of rows, both dealt by (block, cell)."""
    return anchors.groupBy("block", "cell").cogroup(rows.groupBy("block", "cell")).applyInArrow(find, schema)


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k different (score, id) of each group; tasks drop the others before the shuffle."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return df.withColumn("place", place).filter(F.col("place") <= k).dropDuplicates([*by, "place"])


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id or label, or with a null, non-finite or missing vector component take no part. Shorter vectors count as filled
    with zeros; components beyond what keeps scores in 64 bits (2**28 for 64 components) stop there. Equal rows count once; rows of one
    id with other contents are rows of their own, but no row is its own id's positive or negative. An anchor without positives,
    or a positive without rows in its band, gives no row. is_anchor is a condition on the id; an empty table gives an empty result.
    """
    df = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), is_anchor.alias("asks")
    )
    n, asking, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cells, blocks, size = max(1, -(-n // CELL_ROWS), min(CELLS, n // LEAST_ROWS)), max(1, -(-asking // BLOCK)), max(1, size)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # the place in the scan deals rows evenly, whatever their ids; every run over the same files gives the same places
    rows = df.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int")).withColumn("block", every(blocks)).select(
        "block", "cell", F.col("id").alias("row_id"), F.col("label").alias("row_label"), F.col("vector").alias("row_vector")
    )
    anchors = df.filter("asks").select("id", "label", "vector").distinct()
    anchors = anchors.withColumn("akey", F.xxhash64("id", "label", "vector")).withColumn("block", F.pmod(F.xxhash64("akey", F.lit("block")), F.lit(blocks)).cast("int"))

    found = _meet(anchors.withColumn("cell", every(cells)), rows, _positives_of(size, scale, positives), "akey long, anchor_id long, label long, id long, score long")
    positive = saved(_first(found, ["akey", "anchor_id"], positives).select("akey", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positive.groupBy("akey").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked = anchors.join(scores, "akey").withColumn("cell", every(cells))
    found = _meet(asked, rows, _negatives_of(size, scale, negatives, low, high), "akey long, anchor_id long, positive_score long, id long, score long")
    negative = _first(found, ["akey", "anchor_id", "positive_score"], negatives)
    return positive.join(negative, ["akey", "anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
with own as materialized (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as materialized (
  select distinct a.id as aid, a.label as alabel, a.v as av, r.id, r.label = a.label as alike, cast(list_inner_product(a.v, r.v) as bigint) as score
  from own a join own r on r.id <> a.id where a.id % 50 = 0),
positive as (
  select aid, alabel, av, id as pid, score as ps from (select *, row_number() over (partition by aid, alabel, av order by score desc, id) as nth from scored where alike) where nth <= 5),
negative as (
  select p.aid, p.pid, p.ps, s.id, s.score, row_number() over (partition by p.aid, p.alabel, p.av, p.pid, p.ps order by s.score desc, s.id) as rank
  from positive p join scored s on s.aid = p.aid and s.alabel = p.alabel and s.av = p.av and not s.alike where 50 * p.ps <= 100 * s.score and 100 * s.score <= 95 * p.ps)
select aid as anchor_id, pid as positive_id, cast(rank as integer) as rank, id as negative_id, ps as positive_score, score as negative_score from negative where rank <= 3"""
