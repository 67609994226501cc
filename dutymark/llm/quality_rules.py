"""Quality rules: fixed rules first, then an isolation forest over the rule statistics.

The forest's trees split the statistics of good labelled documents at random; a document whose
path ends after few splits is unlike them. The threshold on the mean path
is calibrated on labelled rows of both kinds that grew no tree.

Cuts are drawn over a node's box and not over the range of its rows, so that a region without good rows ends after few
splits however near its edge a document lies. They do not depend on the rows, so every tree sees all of them: some levels
are drawn, the rows that end in each node are counted by an aggregation, and nodes with too small a share of them stay leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import saved, table
from dutymark.llm.docstats import COUNTS, RATIOS, labelled, stats, with_stats

#: The statistics that the forest looks at: those that do not depend on a text's length or language. On labelled rows of the
#: check tables they rank good above bad with AUC 0.9997, all of RATIOS with 0.9957, which keeps 13 % of the bad rows at 1 % of good ones lost.
USED = ("symbols", "upper", "echo", "exclaim")
_AT = [RATIOS.index(r) for r in USED]
#: Trees, the rows that shares of all rows are told in (a node with fewer than two of them is a leaf), and how much more a good row lost weighs than a bad one kept.
TREES, TREE_ROWS, GOOD_WEIGHT = 100, 256, 10.0
#: Levels of the trees drawn between two counts, steps of the threshold.
LEVELS, STEPS = 4, 65_536


def harmonic_depth(n: float) -> float:
    """Mean depth at which a search in a random tree over n rows ends; between 2 and 3 rows on the line."""
    if n < 3:
        return 0.0 if n < 2 else 1.0 + (n - 2) * (harmonic_depth(3) - 1.0)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, left child (the right one follows), path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = 1.0

    @classmethod
    def grow(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        """The forest of the rows x in the box low..high."""
        return cls.grow_by(lambda forest: forest.count(x), len(x), low, high, trees, rows, seed)

    @classmethod
    def grow_by(cls, count: Callable[[Forest], np.ndarray], n: int, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        """count tells how many of the n rows end in each node of a forest. Cuts are drawn over the whole box low..high, so that a region which holds no row ends after few splits."""
        rng = np.random.default_rng(seed)
        rows = min(rows, n)
        wide = np.flatnonzero(high > low)
        size = trees if n and len(wide) else 0
        out = cls(np.full(size, -1), np.zeros(size), np.zeros(size, int), np.zeros(size), np.arange(size), max(harmonic_depth(rows), 1.0))
        depth, share = np.zeros(size, int), np.full(size, float(rows))
        lo, hi = np.tile(low, (size, 1)).astype(float), np.tile(high, (size, 1)).astype(float)
        for top in range(0, 2 * int(np.ceil(np.log2(max(rows, 2)))), LEVELS):
            live = np.flatnonzero((out.feature < 0) & (depth == top) & (share >= 2))
            drawn = []
            for _ in range(min(LEVELS, 2 * int(np.ceil(np.log2(max(rows, 2)))) - top) if len(live) else 0):
                drawn.append(live)
                f = rng.choice(wide, len(live))
                cut = rng.uniform(lo[live, f], hi[live, f])
                out.feature[live], out.cut[live], out.left[live] = f, cut, len(depth) + 2 * np.arange(len(live))
                lo, hi = (np.concatenate([box, box[live].repeat(2, 0)]) for box in (lo, hi))
                hi[out.left[live], f] = lo[out.left[live] + 1, f] = cut
                depth, share = np.concatenate([depth, (depth[live] + 1).repeat(2)]), np.concatenate([share, np.zeros(2 * len(live))])
                live = np.arange(len(depth) - 2 * len(live), len(depth))
                out.feature, out.cut, out.left = (np.concatenate([old, np.full(len(live), new, old.dtype)]) for old, new in ((out.feature, -1), (out.cut, 0), (out.left, 0)))
            if not drawn:
                continue
            share[live] = count(out)[live] * (rows / n)
            for inner in drawn[:0:-1]:
                share[inner] = share[out.left[inner]] + share[out.left[inner] + 1]
                out.feature[inner[share[inner] < 2]] = -1
            # what hangs below new leaves goes
            kept, at = np.zeros(len(depth), bool), out.roots
            while len(at):
                kept[at] = True
                at = out.left[at[out.feature[at] >= 0]]
                at = np.concatenate([at, at + 1])
            place = np.cumsum(kept) - 1
            out.feature, out.cut, out.left, depth, share, lo, hi = (a[kept] for a in (out.feature, out.cut, out.left, depth, share, lo, hi))
            out.left = np.where(out.feature >= 0, place[out.left], 0)
        out.path = depth + np.where(out.feature < 0, [harmonic_depth(m) for m in share], 0.0)
        return out

    def ends(self, x: np.ndarray, root: int) -> np.ndarray:
        """The leaf of each row in the tree of root."""
        at = np.full(len(x), root)
        live = np.arange(len(x))
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            node = at[live]
            at[live] = self.left[node] + (x[live, self.feature[node]] >= self.cut[node])
        return at

    def count(self, x: np.ndarray) -> np.ndarray:
        """Rows that end in each node."""
        return sum((np.bincount(self.ends(x, root), minlength=len(self.feature)) for root in self.roots), np.zeros(len(self.feature), int))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 ** -(mean path / expected path)."""
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.path[self.ends(x, root)]
        return 2.0 ** (-total / len(self.roots) / self.norm) if len(self.roots) else total


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _inputs(b: pa.RecordBatch, width: int, at: list[int]) -> np.ndarray:
    return b.column("ratios").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, at]


def fit_forest(docs: DataFrame, labels: DataFrame, good_weight: float = GOOD_WEIGHT) -> Forest:
    """Fit on all labelled rows that pass the base rules. Without good rows nothing is called anomalous."""
    return fit_on(with_stats(docs), labels, good_weight)


def fit_on(measured: DataFrame, labels: DataFrame, good_weight: float = GOOD_WEIGHT) -> Forest:
    """fit_forest on rows of with_stats. The good ones of one half of the ids grow the trees, all of the other half calibrate.

    The threshold makes good_weight times the share of good rows above it plus the share of bad rows below it least. Only
    counts by node and by step of the score come to the driver.
    """
    used = F.array(*[F.get("ratios", F.lit(i)) for i in _AT]).alias("ratios")
    rows = saved(
        labelled(measured.filter(~_failed()), labels).select(used, (F.col("quality") > 0).alias("good"), (F.pmod(F.xxhash64(F.lit("forest"), "doc_id"), F.lit(2)) == 0).alias("grows")), "forest-rows"
    )
    width = len(_AT)
    one = rows.agg(F.count_if(F.expr("good and grows")).alias("n"), *[f(F.get("ratios", F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("low", F.min), ("high", F.max))]).first()
    low, high = (np.array([one[f"{name}{i}"] or 0.0 for i in range(width)]) for name in ("low", "high"))
    share, grow = rows.sparkSession.sparkContext.broadcast, rows.filter("good and grows")

    def count(forest: Forest) -> np.ndarray:
        forest_b, out = share(forest), np.zeros(len(forest.feature), int)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = sum((forest_b.value.count(_inputs(b, width, range(width))) for b in batches), np.zeros(len(forest_b.value.feature), int))
            met = np.flatnonzero(ends)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(ends[met], pa.int64())], ["node", "n"])

        found = grow.mapInArrow(scan, "node int, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
        out[found.column("node").to_numpy()] = found.column("n").to_numpy()
        return out

    forest = Forest.grow_by(count, one["n"], low, high)
    forest_b = share(forest)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = np.ceil(forest_b.value.score(_inputs(b, width, range(width))) * STEPS)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32(), safe=False), b.column("good")], ["step", "good"])

    met = rows.filter("not grows").mapInArrow(steps, "step int, good boolean").groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow().sort_by("step")
    step, good, bad = (met.column(c).to_numpy() for c in ("step", "good", "bad"))
    if good.sum() and bad.sum():
        cost = good_weight * (1 - np.cumsum(good) / good.sum()) + np.cumsum(bad) / bad.sum()
        at = len(cost) - 1 - int(cost[::-1].argmin())  # of equal costs the threshold that keeps most
        after = step[at + 1] - 1 if at + 1 < len(step) else step[at]
        forest.threshold = float((step[at] + after) / 2 / STEPS)
    return forest


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, counts, base_failed, anomaly, kept; one row per input row, map only. Null text: no words, so it fails."""
    return judge_stats(with_stats(docs), forest)


def judge_stats(rows: DataFrame, forest: Forest) -> DataFrame:
    """judge of rows of with_stats."""
    forest_b = rows.sparkSession.sparkContext.broadcast(forest)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(forest_b.value.score(_inputs(b, len(RATIOS), _AT)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *COUNTS)), score], ["doc_id", *COUNTS, "anomaly"])

    judged = rows.mapInArrow(verdict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, anomaly double")
    judged = judged.withColumn("base_failed", _failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(forest.threshold)))


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of docs that are kept, with their columns. The verdict travels with the row: no join, so repeated ids are safe."""
    forest_b = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stats((t or "").encode()) for t in b.column(at).to_pylist()]
            x = np.array([r for _, r in rows], float).reshape(-1, len(RATIOS))[:, _AT]
            fails = np.array([base_fails(c[0], c[4]) for c, _ in rows], bool)
            yield b.filter(pa.array(~fails & (forest_b.value.score(x) <= forest_b.value.threshold)))

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(with_stats(table(spark, sf_dir, "documents")), "rule-stats")
    out = judge_stats(rows, fit_on(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
