"""Token-set ratios in blocks against all pairs, one by one."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dutymark.operators import ratios
from dutymark.operators import similarity as S

WORD = st.text("abcé", min_size=1, max_size=5)
TEXT = st.lists(WORD, max_size=5).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.lists(TEXT, min_size=1, max_size=12, unique=True), st.integers(1, 4), st.sampled_from([0.0, 40.0, 60.0, 90.0]))
def test_first_ratios_equal_all_pairs(terms, names, k, cutoff):
    ids = np.array([(7 * n) % 13 for n in range(len(names))])
    got = sorted(zip(*(x.tolist() for x in ratios.first_ratios(terms, names, ids, k, cutoff)), strict=True))
    want = []
    for i, a in enumerate(terms):
        every = [(-round(ratios.token_set_ratio(a, b), 4), ids[j], j) for j, b in enumerate(names)]
        want += [(i, j, -r) for r, _, j in sorted(x for x in every if -x[0] >= max(cutoff, 1e-4))[:k]]
    assert got == sorted(want)


def test_long_texts_and_common_lengths():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd "), n)) for n in (0, 1, 5, 63, 64, 65, 130, 200)]
    i, j = (x.ravel() for x in np.meshgrid(range(8), range(8)))
    assert ratios.common_lengths(texts, texts, i, j).tolist() == [ratios.common_subsequence(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]


QUERIES = ["RED Bolt 5g", "rde bolt", "red bolt red", "anvill", "", None, "x", "blue widget 12 ml tab", "Blue", "steel hammer large", "blue widgets deluxe"]
NAMES = ["red bolt", "RED  BOLT", "bolt red 10g", "blue widget", "blue widget large", "bluewidget", "anvil", "hammer of steel", "", None, "rod", "large steel hammers", "blue", "tab"]


def plain_tokens(t):
    import re

    return [w for w in re.sub(r"\b\d+\s*(g|kg|ml|l|mg|gm|pc|pcs|nos|pack|tab|tabs|caps)\b", "", t).split() if len(w) >= 3]


@pytest.fixture
def tables(spark):
    q = spark.createDataFrame(list(enumerate(QUERIES)) + [(20, "RED Bolt 5g")], "query_id long, text string")
    return q, spark.createDataFrame(list(enumerate(NAMES)), "id long, description string")


def names_by_text():
    out = {}
    for i, n in enumerate(NAMES):
        if n is not None and n.strip():
            out.setdefault(" ".join(n.lower().split()), i)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_topk_equals_all_pairs(tables, monkeypatch, small):
    if small:
        for name, value in {"TILE_TERMS": 2, "TILE_NAMES": 3, "CELL_NAMES": 4, "LEAST_NAMES": 2, "BLOCK": 3, "PAIRS": 2}.items():
            monkeypatch.setattr(ratios, name, value)
    got = sorted((r["query_id"], r["id"], r["ratio"], r["rank"]) for r in S.token_set_topk(*tables, 3).collect())
    want = []
    for i, q in [*enumerate(QUERIES), (20, QUERIES[0])]:
        a = " ".join((q or "").lower().split())
        every = [(-max(round(ratios.token_set_ratio(t, n), 4) for t in [a, *plain_tokens(a)]), d) for n, d in names_by_text().items()] if a else []
        want += [(i, d, -r, rank) for rank, (r, d) in enumerate(sorted(x for x in every if -x[0] >= 60)[:3], 1)]
    assert got == sorted(want)


def test_brand_and_type_equals_all_pairs(tables, monkeypatch):
    want = []
    for i, q in [*enumerate(QUERIES), (20, QUERIES[0])]:
        a = " ".join((q or "").lower().split())
        t = plain_tokens(a)
        if len(t) >= 2:
            every = [(-round(0.6 * sum(w in n for w in t[1:]) / (len(t) - 1) + 0.4 * round(ratios.token_set_ratio(a, n), 4) / 100, 6), d) for n, d in names_by_text().items() if n.startswith(t[0])]
            want += [(i, d, -s) for s, d in sorted(every)[:1] if -s >= 0.35]
    assert len(want) >= 4
    for cell in (4, 100_000):
        monkeypatch.setattr(ratios, "CELL_NAMES", cell)
        assert sorted((r["query_id"], r["id"], r["score"]) for r in S.match_brand_type(*tables).collect()) == sorted(want)


def test_nothing(tables):
    q, n = tables
    assert S.token_set_topk(q.limit(0), n, 3).count() == 0 and S.token_set_topk(q, n.limit(0), 3).count() == 0
    assert S.match_brand_type(q.limit(0), n).count() == 0 and S.match_brand_type(q, n.limit(0)).count() == 0
