"""Vector search in blocks and by index against plain inner products; the vector part of the hybrid cascade."""

import numpy as np
import pytest

from dutymark.operators import similarity as S
from dutymark.operators import vectors
from dutymark.plans import cascade


def rows(spark, n=400, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (12, size))
    data = [(i, (centre[i % 12] + rng.normal(0, 0.4, size)).tolist()) for i in range(n)]
    data += [(n + i, [1.0] * size) for i in range(n // 2)]  # a third of all rows are equal
    data += [(-1, None), (None, [1.0] * size), (-2, [0.0] * size), (-3, [1.0, 2.0])]
    return spark.createDataFrame(data, "vec_id long, vector array<double>"), [(i, v) for i, v in data if i is not None and v is not None]


def plain_topk(data, asked, k):
    size = max(len(v) for _, v in data)
    unit = {i: np.pad(np.array(v, float), (0, size - len(v))) / max(np.linalg.norm(v), 1e-12) for i, v in data}
    ids, m = np.array(list(unit)), np.array(list(unit.values()))
    out = {}
    for a in asked:
        s = np.round(m @ unit[a], 9)
        out[a] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def close(a, b):
    return a.keys() == b.keys() and all([x for x, _ in a[q]] == [x for x, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=2e-9) for q in a)


@pytest.mark.parametrize("small", [False, True])
def test_exact_and_index_with_all_probes(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 5, "CELL_ROWS": 60, "LEAST_ROWS": 20, "TILE": 50}.items():
            monkeypatch.setattr(vectors, name, value)
    df, data = rows(spark)
    asked = df.filter("vec_id % 25 = 0").selectExpr("vec_id as query_id", "vector")
    want = plain_topk(data, [i for i, _ in data if i % 25 == 0], 7)
    assert close(found(S.vector_topk(asked, df, 7)), want)
    assert close(found(S.vector_index_topk(asked, df, 7, probes=20, centroids=20)), want)
    if small:
        assert max(vectors.VectorIndex.build(df, 20).parts.values()) > 1
    for q, d in ((asked.limit(0), df), (asked, df.limit(0))):
        assert S.vector_topk(q, d, 3).count() == 0 and S.vector_index_topk(q, d, 3).count() == 0


def test_recall_of_the_index(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet").selectExpr("vec_id", "embedding as vector")
    asked = e.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "vector")
    exact, near = found(S.vector_topk(asked, e, 10)), found(S.vector_index_topk(asked, e, 10))
    recall = np.mean([len({x for x, _ in exact[q]} & {x for x, _ in near[q]}) / len(exact[q]) for q in exact])
    print("recall", recall)
    assert len(exact) == 100 and recall >= 0.9


def test_vectors_compete_with_words(spark):
    queries = spark.createDataFrame([(1, "steel bolt"), (2, "exact thing"), (3, "nothing known")], "query_id long, text string")
    data = spark.createDataFrame([(1, "73181500", "steel bolt long", 0.0), (2, "39269099", "exact thing", 0.0), (3, "84821010", "ball bearing", 0.0)], "id long, hsn_code string, description string, bonus double")
    near = spark.createDataFrame([(1, 3, 0.5), (1, 1, 1.0), (2, 3, 1.0), (3, 3, 0.7)], "query_id long, id long, score double")
    got = {}
    for r in cascade.hybrid_cascade(queries, data, 5, near).collect():
        got.setdefault(r["query_id"], {})[r["hsn_code"]] = (round(r["score"], 6), r["rank"])
    # words give steel bolt 0.80 for its phrase at least; 0.9 of the vector is more; exact texts take no vectors
    assert got == {1: {"73181500": (0.913333, 1), "84821010": (0.45, 2)}, 2: {"39269099": (0.82, 1)}, 3: {"84821010": (0.63, 1)}}
