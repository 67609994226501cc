"""Nearest vectors by inner product of normed vectors: exactly, in blocks, and through a clustered index.

The index has centroids from a bounded sample of rows; every row is assigned to its nearest one. A question probes the
cells of its nearest centroids only. Large cells are cut into parts of bounded size, so that a cell that
holds most rows is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutymark.operators.blocks import meet, tiles

C = F.col

#: Questions of a block; rows of a cell at most, least number worth a cell of its own; rows of a matrix.
BLOCK, CELL_ROWS, LEAST_ROWS, TILE = 1_024, 32_768, 1_024, 4_096
#: Bounds of the index: rows that the centroids are learned from, centroids; rounds of learning; part of the rows that a centroid should stand for at least.
SAMPLE, MOST_CENTROIDS, ROUNDS, ROWS_EACH = 20_000, 1_024, 8, 50
#: Questions of the sample, and neighbours of each, that tell how many cells to probe; the recall that is aimed at.
TRIAL, NEIGHBOURS, RECALL = 256, 10, 0.95

_FOUND = "query_id long, vec_id long, score double"


def normed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of unit vectors; zero vectors stay. Shorter rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), int(length.max(initial=0))))
    out[np.arange(out.shape[1]) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fitted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the columns of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _best(k: int):
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            asked, ids, own = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy(), normed(right.column("vector"))
            q = normed(left.column("vector"))
            q, own = fitted(q, own)
            for s in tiles(len(ids), TILE):
                score = np.round(q @ own[s].T, 9)
                few = min(k, score.shape[1])
                # all that reach the k-th best score compete, so that ties go by id
                least = -np.partition(-score, few - 1, axis=1)[:, few - 1 : few]
                i, j = np.nonzero(score >= least)
                order = np.lexsort((ids[s][j], -score[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
                i, j = i[first], j[first]
                for part, values in zip(out, (asked[i], ids[s][j], score[i, j]), strict=True):
                    part.append(values)
        flat = [np.concatenate(p) if p else np.empty(0) for p in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(float))})

    return find


def _clean(df: DataFrame, key: str) -> DataFrame:
    return df.select(C(key).cast("long").alias(key), "vector").filter(C(key).isNotNull() & C("vector").isNotNull())


def nearest(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each cell's k best rows of each question, by score and id. queries (query_id, vector), docs (vec_id, vector); rows without id or vector are left out."""
    q, d = _clean(queries, "query_id"), _clean(docs, "vec_id")
    return meet(q, "query_id", max(1, -(-q.count() // BLOCK)), d, "vec_id", CELL_ROWS, LEAST_ROWS, _best(k), _FOUND)


@dataclass
class VectorIndex:
    """rows: vec_id, vector, cell, of every indexed row; parts: number of parts of each large cell; depth: rising, how many cells a question of the
    sample has to probe for each of its nearest neighbours there."""

    rows: DataFrame
    centroids: np.ndarray
    parts: dict[int, int]
    depth: np.ndarray

    @classmethod
    def build(cls, docs: DataFrame, centroids: int | None = None) -> VectorIndex:
        """Centroids are learned from at most SAMPLE rows, in the order of a hash of their ids; there are rows / ROWS_EACH of them, MOST_CENTROIDS at most."""
        docs = _clean(docs, "vec_id")
        n = docs.count()
        k = centroids or min(MOST_CENTROIDS, max(1, n // ROWS_EACH))
        sample = docs.orderBy(F.xxhash64(F.lit("index"), "vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
        x = normed(sample.column("vector")) if sample.num_rows else np.zeros((1, 1))
        c = x[:k].copy()
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            for i in np.unique(near):
                m = x[near == i].sum(0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
        asked = x[:TRIAL]
        likeness = asked @ x.T
        likeness[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        few = min(NEIGHBOURS, max(1, len(x) - 1))
        neighbours = np.argpartition(-likeness, few - 1, axis=1)[:, :few]
        place_of = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)
        depth = np.sort(np.take_along_axis(place_of, (x @ c.T).argmax(1)[neighbours], 1).ravel()) + 1
        shared = docs.sparkSession.sparkContext.broadcast(c)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, centres = fitted(normed(b.column("vector")), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((rows @ centres.T).argmax(1), pa.int32())], [*b.schema.names, "cell"])

        rows = docs.mapInArrow(place, f"vec_id long, vector {docs.schema['vector'].dataType.simpleString()}, cell int")
        large = rows.groupBy("cell").count().filter(C("count") > CELL_ROWS).collect()  # MOST_CENTROIDS rows at most
        return cls(rows, c, {r["cell"]: -(-r["count"] // CELL_ROWS) for r in large}, depth)

    def probes_for(self, recall: float) -> int:
        """Cells to probe so that this part of the sample's neighbours is found."""
        return int(self.depth[min(len(self.depth) - 1, int(np.ceil(recall * len(self.depth))))])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, recall: float = RECALL) -> DataFrame:
        """(query_id, vec_id, score): the k best rows of each probed cell's part. With as many probes as centroids the answer is exact; without
        a number, as many are taken as the sample needs for the recall."""
        probes = probes or self.probes_for(recall)
        shared, parts = queries.sparkSession.sparkContext.broadcast(self.centroids), self.parts
        probes = min(probes, len(self.centroids))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, centres = fitted(normed(b.column("vector")), shared.value)
                score = rows @ centres.T
                cell = np.argpartition(-score, probes - 1, axis=1)[:, :probes].ravel()
                row = np.repeat(np.arange(b.num_rows), probes)
                count = np.array([parts.get(int(x), 1) for x in cell], np.int64)
                part = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                out = pa.Table.from_batches([b]).take(pa.array(np.repeat(row, count))).append_column("cell", pa.array(np.repeat(cell, count), pa.int32())).append_column("part", pa.array(part, pa.int32()))
                # a block of questions bounds what a task holds
                yield from out.to_batches()

        q = _clean(queries, "query_id")
        asked = q.mapInArrow(probe, f"query_id long, vector {q.schema['vector'].dataType.simpleString()}, cell int, part int")
        several = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]) if parts else None
        count = F.coalesce(F.try_element_at(several, C("cell")), F.lit(1)) if parts else F.lit(1)
        rows = self.rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), count).cast("int"))
        return asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(_best(k), _FOUND)
