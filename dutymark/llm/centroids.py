"""k-means on integer vectors; the nearest centroid by equal-average equal-variance search.

With S the component sums, V the deviations (root of the summed squares about the mean) and L components,
    |x - c|^2 = (Sx - Sc)^2 / L + |(x - mean) - (c - mean)|^2 >= (Sx - Sc)^2 / L + (Vx - Vc)^2 .
Centroids are sorted by S. A vector scans outward from its own S, below and above in turn. A side ends at the
first centroid whose sum alone is too far; a centroid whose sum and deviation together are too far is skipped;
only the others get the exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import table
from dutymark.llm.vectors import integers, usable

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Vectors searched at once.
AT_ONCE = 8192


class Nearest:
    """The nearest of some centroids; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.k, self.size = centroids.shape
        total = centroids.sum(1)
        self.number = np.lexsort((np.arange(self.k), total))
        self.centroids, self.total = centroids[self.number], total[self.number]
        self.spread = _deviation(self.centroids, self.total)
        self.exact = 0

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of x."""
        n, total = len(x), x.sum(1)
        spread = _deviation(x, total)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        above = np.searchsorted(self.total, total)
        below = above - 1
        up, down = above < self.k, below >= 0
        while up.any() or down.any():
            for at, going, way in ((above, up, 1), (below, down, -1)):
                rows = np.flatnonzero(going)
                if not len(rows):
                    continue
                c = at[rows]
                apart = (total[rows] - self.total[c]).astype(np.float64) ** 2 / self.size
                # bounds in doubles are relaxed a little, so that nothing as near as the best is lost
                near = apart * (1 - 1e-12) <= best[rows]
                going[rows[~near]] = False
                rows, c, apart = rows[near], c[near], apart[near]
                full = apart + (spread[rows] - self.spread[c]) ** 2
                slack = 1e-12 * (full + spread[rows] ** 2 + self.spread[c] ** 2)
                left = full - slack <= best[rows]
                self._compare(x, rows[left], c[left], best, found)
                at[rows] += way
                going[rows] = (at[rows] < self.k) if way > 0 else (at[rows] >= 0)
        return found, best

    def _compare(self, x: np.ndarray, rows: np.ndarray, c: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        self.exact += len(rows)
        gap = x[rows] - self.centroids[c]
        distance, number = np.einsum("ij,ij->i", gap, gap), self.number[c]
        won = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
        best[rows[won]], found[rows[won]] = distance[won], number[won]


def _deviation(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - (total / x.shape[1])[:, None]).sum(1))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """id, vector of the rows with `size` components, none null or non-finite."""
    return df.filter((F.size(vector_col) == size) & usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))


def first_centroids(rows: DataFrame, k: int, scale: int, size: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<id>`; null ids come last, equal ids in the order of their vectors."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(name.asc_nulls_last(), "vector").select("vector").limit(k).toArrow()
    return integers(chosen.column("vector"), scale, size, 4) if chosen.num_rows else np.zeros((0, size), np.int64)


def search_rows(batches: Iterator[pa.RecordBatch], search: Nearest, scale: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, number, distance) of slices of the batches."""
    for b in batches:
        for low in range(0, b.num_rows, AT_ONCE):
            part = b.slice(low, AT_ONCE)
            x = integers(part.column("vector"), scale, size, 4)
            yield (part.column("id"), x, *search.of(x))


def move(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every vector to its nearest centroid, then floor(sum / count); centroids without vectors stay."""
    k, size = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Nearest(shared.value), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x, number, _ in search_rows(batches, search, scale, size):
            order = np.argsort(number, kind="stable")
            count += np.bincount(number, minlength=k)
            at, first = np.unique(number[order], return_index=True)
            total[at] += np.add.reduceat(x[order], first, axis=0)
        live = np.flatnonzero(count)
        place = (live[:, None] * (size + 1) + np.arange(size + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.c_[total[live], count[live]].ravel(), pa.int64())], ["place", "value"])

    # at most k * (size + 1) rows come back
    summed = rows.mapInArrow(sums, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    value = np.zeros(k * (size + 1), np.int64)
    value[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    value = value.reshape(k, size + 1)
    live = value[:, -1] > 0
    moved = centroids.copy()
    moved[live] = value[live, :-1] // value[live, -1:]
    return moved


def assign(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """id, cluster, distance for each row of (id, vector). Map only."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in search_rows(batches, Nearest(shared.value), scale, shared.value.shape[1]):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return rows.mapInArrow(search, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every kept row, the final centroids).

    Kept are rows with `size` components, none null or non-finite; components are floor(scale * x). Repeated rows are rows of
    their own. With fewer than k rows each starts a centroid; with none the result is empty. Components beyond +-2**27 (for 64
    components) stop there, so that distances fit in 64 bits. The input is scanned once a round; k * (size + 1) numbers pass the driver.
    """
    rows = kept_vectors(df, id_col, vector_col, size)
    centroids = first_centroids(rows, k, scale, size)
    if not len(centroids):
        nothing = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return nothing.withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        centroids = move(rows, centroids, scale)
    return assign(rows, centroids, scale).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned plus cluster_inertia, inertia and centroid_sha256; one row for each cluster is broadcast."""
    spark = assigned.sparkSession
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in own)
    facts = [(r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in own]
    return assigned.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned_sql(a: str, c: str) -> str:
    return f"""{a} as materialized (
  select id, v, min(struct_pack(d := cast(vv - 2 * list_inner_product(v, c) + list_inner_product(c, c) as bigint), k := k)) as best
  from kept, {c} group by id, v)"""


def _moved_sql(c: str, a: str, before: str) -> str:
    return f"""{c} as materialized (
  select k, coalesce(m.c, o.c) as c from {before} o left join (
    select k, list(m order by i) as c from (
      select best.k as k, i, floor(sum(v[i]) / count(*)) as m from {a}, (select unnest(range(1, 65)) as i) group by best.k, i) group by k) m using (k))"""


OP13_SQL = f"""
with kept as materialized (
  select *, list_inner_product(v, v) as vv from (
    select vec_id as id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)),
c0 as materialized (select cast(row_number() over (order by sha256('1:' || id), v) - 1 as integer) as k, v as c from kept order by sha256('1:' || id), v limit 16),
{_assigned_sql("a0", "c0")},
{_moved_sql("c1", "a0", "c0")},
{_assigned_sql("a1", "c1")},
{_moved_sql("c2", "a1", "c1")},
{_assigned_sql("a2", "c2")},
{_moved_sql("c3", "a2", "c2")},
{_assigned_sql("a3", "c3")}
select id as vec_id, best.k as cluster, best.d as distance, cast(sum(best.d) over (partition by best.k) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a3 join c3 on c3.k = best.k"""
