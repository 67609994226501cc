import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dutymark.llm import centroids, negatives
from dutymark.llm.vectors import integers, products

VECTORS = "vec_id long, label int, embedding array<float>, cluster string, distance string, score string"
NAN, INF = float("nan"), float("inf")


def awkward_vectors(spark, size=8):
    """Groups about a few centres, ties, repeated rows, repeated ids, nulls, infinities, short and empty vectors, huge components."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 0.4, (4, size))
    rows = [(i, i % 4, [float(np.float32(v)) for v in centre[i % 4] + rng.normal(0, 0.15, size)]) for i in range(300)]
    rows += [(i, 1, [0.25] * size) for i in range(300, 340)] + [(i, 2, [0.25] * size) for i in range(340, 380)]
    rows += rows[50:53] + rows[50:53] + [(50, 3, [0.5] * size), (100, 1, [0.125] * size), (400, 0, [0.0] * size), (450, 9, [0.5] * size)]
    rows += [(500, None, [0.5] * size), (550, 1, None), (600, 1, [None] + [0.5] * (size - 1)), (650, 1, [NAN] + [0.5] * (size - 1)), (700, 1, [INF] + [0.5] * (size - 1)), (None, 1, [0.5] * size)]
    rows += [(750, 2, []), (800, 2, [0.5, -0.5]), (850, 2, [1e30] + [0.0] * (size - 1)), (900, 3, [-1e30] + [0.1] * (size - 1))]
    return spark.createDataFrame([(a, b, c, "x", None, "y") for a, b, c in rows], VECTORS), rows


def floors(vector, scale, size, most):
    got = [min(max(math.floor(scale * float(np.float32(v))), -most), most) for v in vector]
    return tuple(got + [0] * (size - len(got)))


def fine(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


def plain_negatives(rows, size, is_anchor, k=5, top=3):
    own = {(i, y, floors(v, 256, size, 1 << 29)) for i, y, v in rows if i is not None and y is not None and fine(v)}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for i, y, v in own:
        if not is_anchor(i):
            continue
        alike = sorted({(-dot(v, w), j) for j, z, w in own if j != i and z == y})[:k]
        other = sorted({(-dot(v, w), j) for j, z, w in own if j != i and z != y})
        for s, j in alike:
            hits = [(t, n) for t, n in other if 50 * -s <= 100 * -t <= 95 * -s][:top]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("cut", ["as set", "small"])
def test_negatives_equal_plain_ones(spark, monkeypatch, cut):
    if cut == "small":  # many cells, blocks and tiles, single pairs bounded
        for name, value in {"CELL_ROWS": 100, "LEAST_ROWS": 10, "BLOCK": 7, "TILE_ROWS": 40, "TILE_ANCHORS": 3, "PAIRS": 50, "SPARSE": 1.0, "LEVELS": (1, 2, 4)}.items():
            monkeypatch.setattr(negatives, name, value)
    df, rows = awkward_vectors(spark)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 8, lambda i: i % 10 == 0)


def test_negatives_of_nothing(spark):
    df, _ = awkward_vectors(spark)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.filter("label = 1"), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    x, y = (np.floor(256 * (rng.normal(0, 0.1, (60, 64)) + rng.normal(0, 0.2, (60, 8)).repeat(8, 1))).astype(np.int64) for _ in range(2))
    exact, pairs, widths = x @ y.T, negatives.Pairs(negatives.Summary(x), negatives.Summary(y), np.ones((60, 60), bool)), []

    def keep(low, high, i):
        assert (low <= exact).all() and (exact <= high).all()
        widths.append(float((high - low).mean()))
        return np.ones((60, 60), bool)

    while pairs.refined(keep):
        pass
    assert len(widths) == 4 and widths == sorted(widths, reverse=True)
    # a band far from nearly all scores is settled without exact products
    pairs = negatives.Pairs(negatives.Summary(x), negatives.Summary(y), np.ones((60, 60), bool))
    while pairs.refined(lambda low, high, i: high >= 3 * np.abs(exact).std()):
        pass
    assert sum(pairs.settled) > 0.8 * 3600 and (exact[~pairs.open] < 3 * np.abs(exact).std()).all()


def plain_clusters(rows, size, k, rounds, scale=64):
    most = 1 << ((62 - (4 * size - 1).bit_length()) // 2)
    kept = [(i, floors(v, scale, size, most), tuple(v)) for i, _, v in rows if fine(v) and len(v) == size]
    sha = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centre = [v for _, v, _ in sorted(kept, key=lambda r: (sha(r[0]), r[2]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [tuple(sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(centre)]
    return [(i, *reversed(near(v))) for i, v, _ in kept], centre


@pytest.mark.parametrize("k", [1, 5, 16, 1000])
def test_clusters_equal_plain_ones(spark, k):
    df, rows = awkward_vectors(spark)
    got, centre = centroids.cluster(df, size=8, k=k)
    want, plain_centre = plain_clusters(rows, 8, k, 3)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert [tuple(c) for c in centre.tolist()] == plain_centre


def test_inertia_and_nothing(spark):
    df, _ = awkward_vectors(spark)
    got, centre = centroids.cluster(df, size=8, k=4)
    rows = centroids.with_inertia(got, centre).collect()
    assert {r["inertia"] for r in rows} == {sum(r["distance"] for r in rows)}
    for r in rows:
        assert r["cluster_inertia"] == sum(x["distance"] for x in rows if x["cluster"] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centre[r["cluster"]])).encode()).hexdigest()
    for none in (df.limit(0), df.filter("embedding is null")):
        got, centre = centroids.cluster(none)
        assert centroids.with_inertia(got, centre).count() == 0


def test_search_skips_most_centroids_and_finds_the_nearest():
    rng = np.random.default_rng(3)
    c = np.floor(64 * (rng.normal(0, 0.4, (200, 1)) + rng.normal(0, 1, (200, 64)) * rng.uniform(0.05, 0.4, (200, 1)))).astype(np.int64)
    c[7] = c[90]
    x = np.concatenate([c + rng.integers(-2, 3, c.shape), c])
    search = centroids.Nearest(c)
    number, distance = search.of(x)
    full = np.square(x[:, None] - c).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all() and number[400 - 200 + 90] == 7
    assert search.exact < 0.25 * full.size


def test_integers_and_products():
    got = integers(pa.array([[0.5, -0.001], [1e300, -1e300], [1.0], []], pa.list_(pa.float64())), 64, 2)
    assert got.tolist() == [[32, -1], [2**30, -(2**30)], [64, 0], [0, 0]]
    big = np.array([[2**30, 2**30 - 1], [3, -5]])
    assert products(big, big).tolist() == [[2**60 + (2**30 - 1) ** 2, 3 * 2**30 - 5 * (2**30 - 1)], [3 * 2**30 - 5 * (2**30 - 1), 34]]


def test_the_queries_keep_their_columns(spark, sf_dir):
    a, b = negatives.op12_hard_negatives(spark, sf_dir), centroids.op13_centroid_clustering(spark, sf_dir)
    assert a.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert b.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    turned = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(map(tuple, a.collect())) == plain_negatives(turned, 64, lambda i: i % 50 == 0)
    assert sorted(tuple(r)[:3] for r in b.collect()) == sorted(plain_clusters(rows, 64, 16, 3)[0])
