"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

cos(x W + b) with normal W approximates a Gaussian kernel. The normal equations are summed by
partition; held-back training rows calibrate the ridge score by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import crc_mod, saved, table
from dutymark.llm.docstats import RATIOS, labelled, with_stats

#: Number of random features, kernel width, ridge, partitions that sum.
FEATURES, WIDTH, RIDGE, SUM_PARTITIONS = 256, 3.0, 1.0, 16
#: Ridge scores are calibrated in steps of 1 / STEPS, from -REACH to REACH.
STEPS, REACH = 8192, 4


def pooled(score: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: block means of labels over rising scores, with a block's first and last score as knots.

    With rows, label is the sum of the labels of so many rows of a score.
    """
    rows = np.ones(len(score)) if rows is None else rows.astype(float)
    order = np.lexsort((label, score))
    blocks: list[list[float]] = []
    for s, y, n in zip(score[order], label[order], rows[order], strict=True):
        blocks.append([y, n, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            y2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2], last]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    value = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks for _ in (0, 1)])
    return knots, np.maximum.accumulate(value)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        out = np.ones((len(x), len(self.shift) + 1))
        out[:, :-1] = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.weights + self.shift)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.beta
        # between knots the line, plus a small slope so that ties keep the ridge order
        return np.clip(0.98 * np.interp(raw, self.knots, self.values) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def vectors(b: pa.RecordBatch) -> np.ndarray:
    """Model inputs: the ratios and log lengths."""
    ratios = np.array(b.column("ratios").to_pylist(), float).reshape(-1, len(RATIOS))
    return np.c_[ratios, np.log1p(b.column("n_words").to_numpy(zero_copy_only=False)), np.log1p(b.column("word_chars").to_numpy(zero_copy_only=False))]


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> Model:
    """keep: condition on doc_id of the label rows to learn from; all of them are used. Without labels each score is 0.5."""
    return fit_on(with_stats(docs), labels, keep)


def fit_on(measured: DataFrame, labels: DataFrame, keep=None) -> Model:
    """fit on rows of with_stats. A third of the ids calibrates, the others give the normal equations. Only sums come to the driver."""
    rows = saved(labelled(measured, labels, keep).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3))), "kernel-rows")
    inputs = F.concat("ratios", F.array(F.log1p("n_words"), F.log1p("word_chars")))
    width = len(RATIOS) + 2
    one = rows.select(inputs.alias("v")).agg(*[f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(11)
    model = Model(
        np.array([one[f"m{i}"] or 0.0 for i in range(width)]), np.array([max(one[f"s{i}"] or 1.0, 1e-6) for i in range(width)]),
        rng.normal(0, 1 / WIDTH, (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES),
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            f = model.features(vectors(b))
            y = b.column("quality").to_numpy(zero_copy_only=False).astype(float) > 0
            a += f.T @ np.c_[f, y]
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], ["row", "a"])

    # each partition sends one matrix; their number is fixed, whatever the input
    parts = rows.filter("fold > 0").select("ratios", "n_words", "word_chars", "quality").repartition(SUM_PARTITIONS)
    summed = parts.mapInArrow(sums, "row int, a array<double>").collect()
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in summed:
        a[r["row"]] += r["a"]
    if a[-1, -2] > 0:
        model.beta = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(FEATURES + 1), a[:, -1])

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = np.rint(np.clip(model.features(vectors(b)) @ model.beta, -REACH, REACH) * STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), b.column("good")], ["step", "good"])

        held = rows.filter("fold = 0").select("ratios", "n_words", "word_chars", (F.col("quality") > 0).alias("good"))
        met = held.mapInArrow(steps, "step int, good boolean").groupBy("step").agg(F.count_if("good").alias("good"), F.count(F.lit(1)).alias("n")).toArrow()
        if met.num_rows:
            step, good, n = (met.column(c).to_numpy() for c in ("step", "good", "n"))
            model.knots, model.values = pooled(step / STEPS, good.astype(float), n)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0..1 of every row; null text counts as empty. Map only; equal texts get equal scores."""
    return score_stats(with_stats(docs), model)


def score_stats(rows: DataFrame, model: Model) -> DataFrame:
    """score of rows of with_stats."""
    model_b = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model_b.value.score(vectors(b)), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(with_stats(table(spark, sf_dir, "documents")), "quality-stats")
    model = fit_on(rows, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_stats(rows, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
