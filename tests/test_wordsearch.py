"""Word search in blocks against every question with every row."""

import re

import pytest

from dutymark.functions import fixed
from dutymark.operators import similarity as S
from dutymark.operators import wordsearch

ROWS = [
    ("0101", "live horses breeding", "animals"), ("0102", "live cattle", "animals"), ("0201", "meat of cattle fresh", "meat"), ("0202", "frozen meat", "meat animals"), ("0203", "meat", None), ("0203", "pork meat", "meat"),
    ("0301", "live fish", ""), ("0302", None, "fish"), ("0401", "milk and cream", "dairy"), ("0402", "milk powder", "dairy"), ("0403", "milkshake", "dairy drinks"), (None, "milk", "dairy"),
]
QUERIES = ["meat cattle", "live", "milk", "mil", "m", "meat zebra", "", None, "Fresh MEAT fresh", "cattle animals live meat milk fish horses cream extra", "zebra", "milk"]


@pytest.fixture(params=["one cell", "many cells"])
def tables(spark, request, monkeypatch):
    if request.param == "many cells":
        for name, value in {"BLOCK": 3, "CELL_ROWS": 3, "LEAST_ROWS": 2}.items():
            monkeypatch.setattr(wordsearch, name, value)
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string"), spark.createDataFrame(ROWS, "hsn_code string, description string, category string")


def held_words():
    out = {}
    for key, *columns in ROWS:
        for c, weight in zip(columns, (1.0, 0.4), strict=True):
            for w in re.split("[^a-z0-9]+", (c or "").lower()):
                if w and key:
                    own = out.setdefault(key, {})
                    own[w] = max(own.get(w, 0), weight)
    return out


def ranked(places, k, want, prefixes=()):
    rows = []
    for key, words in held_words().items():
        got = []
        for n, alternatives in enumerate(places):
            last = n == len(places) - 1
            got.append(max((v for w, v in words.items() for a in alternatives if w == a or (last and len(a) >= 2 and w.startswith(a))), default=None))
        hit = [g for g in got if g is not None]
        if hit and (want != "and" or len(hit) == len(places)) and (not prefixes or key.startswith(tuple(prefixes))):
            rows.append((-round(sum(hit) / (1 + sum(hit)), 9), key, len(hit) == len(places)))
    return sorted(rows)[:k]


@pytest.mark.parametrize("op", ["or", "and"])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_every_row(tables, op, k):
    got = sorted(map(tuple, S.fts_search(*tables, {"description": 1.0, "category": 0.4}, k, op=op, key="hsn_code").collect()))
    want = []
    for i, q in enumerate(QUERIES):
        words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", (q or "").lower()) if w))[:8]
        want += [(i, key, -s, r) for r, (s, key, _) in enumerate(ranked([[w] for w in words], k, op), 1)]
    assert got == sorted(want)


def test_weighted_search_takes_all_places_first(tables, spark):
    queries, rows = tables
    chapters = spark.createDataFrame([(0, ["02", "4"]), (2, []), (3, ["0.4"]), (9, ["01", "03"])], "query_id long, chapters array<string>")
    synonyms = {"zebra": ["horses", "wild horse", "ox"], "milk": ["dairy"], "live": ["living"]}
    got = {}
    for r in S.weighted_search(queries, rows, 20, chapters, synonyms=synonyms).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["hsn_code"], r["score"], r["whole"]))
    own = {0: ["02"], 3: ["04"], 9: ["01", "03"]}
    least = {}
    for key, d, _ in ROWS:
        if key and d and (key not in least or d < least[key]):
            least[key] = d
    for i, q in enumerate(QUERIES):
        words = [w for w in dict.fromkeys(re.findall("[a-z]{2,}", (q or "").lower())) if w not in fixed.STOPWORDS + fixed.BRANDS][:8]
        places = [[w, *(s for s in synonyms.get(w, []) if len(s) >= 3 and " " not in s)] for w in words[:6]]
        every = ranked(places, 50, "or", own.get(i, ()))
        every = [x for x in every if x[2]] or every
        want = [(n, key, round(min(0.96, -s * 2.8 + min(0.35, 0.08 * len(set(words) & set(least.get(key, "").split()))) + 0.16), 3), whole) for n, (s, key, whole) in enumerate(every[:20], 1) if key in least or key == "0302"]
        assert sorted(got.get(i, [])) == want, q
    # no row has meat and zebra or its synonym, so any place counts; rows with both words shut out the others
    assert [x[1] for x in got[5]] == ["0101", "0201", "0202", "0203"] and not any(x[3] for x in got[5]) and [x[1] for x in got[0]] == ["0201"] and [x[1] for x in got[10]] == ["0101"]


def test_hybrid_equals_every_row(tables, spark):
    queries, _ = tables
    data = [(1, "a", "meat cattle", 0.01), (2, "a", "fresh meat", 0.0), (3, "b", "cattle", 0.02), (4, "b", "live cattle meat of", 0.0), (5, "c", "milk", 0.03), (6, None, "milk", 0.0), (7, "d", None, 0.0), (8, "c", "milk cream", 0.0), (9, "d", "fresh meat", 0.0)]
    got = sorted(map(tuple, S.hybrid_match(queries, spark.createDataFrame(data, "id long, hsn_code string, description string, bonus double"), 2).select("query_id", "hsn_code", "score", "support", "rank").collect()))
    words = lambda t: [w for w in dict.fromkeys(re.findall("[a-z]{2,}", (t or "").lower())) if w not in fixed.STOPWORDS + fixed.BRANDS]
    want = []
    for i, q in enumerate(QUERIES):
        groups = {}
        for _, code, d, bonus in data:
            w, v = words(q), words(d)
            n = len(set(w) & set(v))
            if n and code:
                s = n / len(w) * 0.68 + n / len(v) * 0.2 + 0.1 * (w[-1] in v and re.findall("[a-z]{2,}", q.lower())[-1] in v) + bonus
                qk, dk = q.upper(), d.upper()
                s = max(s, 0.95) if qk == dk else max(s, 0.8) if qk in dk or dk in qk else s
                groups.setdefault(code, []).append(min(1.0, round(s, 9)))
        want += [(i, c, -s, -n, r) for r, (s, n, c) in enumerate(sorted((-max(v), -len(v), c) for c, v in groups.items())[:2], 1)]
    assert [(a, b, round(s, 8), n, r) for a, b, s, n, r in got] == sorted((a, b, round(s, 8), n, r) for a, b, s, n, r in want)


def test_nothing(tables):
    queries, rows = tables
    assert S.fts_search(queries.limit(0), rows, {"description": 1.0}, 3, key="hsn_code").count() == 0
    assert S.fts_search(queries, rows.limit(0), {"description": 1.0}, 3, key="hsn_code").count() == 0
