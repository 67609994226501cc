"""Containment by automata against plain `in`, broadcast and dealt, and the lookups on top of it."""

import pytest

from dutymark.operators import containment
from dutymark.operators import lookups as L

TEXTS = ["blue anvil steel", "BLUE anvil", "ring", "a", "", None, "aaaa", "anvil anvil", "café crème", "x" * 3000 + "anvil", "ring"]
KEYS = ["anvil", "blue", "blue anvil", "ANVIL", "a", "aa", "é", "", None, "steel ", "ring", "ring", "absent"]


def plain():
    return sorted({(t, k) for t in TEXTS for k in KEYS if t and k and k in t})


@pytest.mark.parametrize("way", ["broadcast", "dealt", "many cells"])
def test_pairs_equal_plain_ones(spark, monkeypatch, way):
    if way != "broadcast":
        monkeypatch.setattr(containment, "BROADCAST_BYTES", 0)
    if way == "many cells":
        for name, value in {"SHARD_BYTES": 7, "CELL_TEXTS": 2, "LEAST_TEXTS": 1}.items():
            monkeypatch.setattr(containment, name, value)
    texts, keys = spark.createDataFrame([(t,) for t in TEXTS], "text string"), spark.createDataFrame([(k,) for k in KEYS], "keyword string")
    assert sorted(map(tuple, containment.contained(texts, keys).collect())) == plain()
    assert containment.contained(texts.limit(0), keys).count() == 0 and containment.contained(texts, keys.limit(0)).count() == 0


def test_a_hundred_thousand_keywords(spark):
    keys = spark.range(100_000).selectExpr("concat('key', id, 'z') as keyword", "cast(id as string) as code", "0 as priority")
    texts = [f"some key{i}z and KEY{i + 7}Z here" for i in range(0, 99_000, 97)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {r["query_id"]: r["code"] for r in L.match_keyword(queries, keys).collect()}
    # the longer keyword, of equally long ones the smaller
    want = {i: min((str(n), str(n + 7)), key=lambda c: (-len(c), f"key{c}z")) for i, n in enumerate(range(0, 99_000, 97))}
    assert got == want


def test_keywords_by_length_and_priority(spark):
    keys = spark.createDataFrame([("Blue", "1", 5), ("anvil", "2", 9), ("STEEL", "3", 1), ("anvil", "4", 9)], "keyword string, code string, priority int")
    queries = spark.createDataFrame([(1, "blue ANVIL steel"), (2, "blue ANVIL steel"), (3, "steel blue"), (4, "none"), (5, None)], "query_id long, text string")
    assert sorted(map(tuple, L.match_keyword(queries, keys).collect())) == [(1, "anvil", "2"), (2, "anvil", "2"), (3, "STEEL", "3")]


def test_three_modes_of_words(spark):
    catalog = spark.createDataFrame([(1, "Blue widget deluxe"), (2, "BLUEWIDGET"), (3, "red widget"), (4, "blue thing long name"), (5, None), (6, "jaggery block")], "id long, description string")
    queries = spark.createDataFrame([(1, "blue widget"), (2, "widgets blue"), (3, "x y"), (4, None), (5, "deluxe widget absentee"), (6, "sweetener")], "query_id long, text string")
    run = lambda mode: sorted((r["query_id"], r["id"], r["rank"]) for r in L.match_words(queries, catalog, mode, 2, synonyms={"sweetener": ["raw sugar", "nothing", "jaggery", "blue"]}).collect())
    assert run("all") == [(1, 1, 2), (1, 2, 1)]
    # the longer half of two words; two of three, in their order where equally long
    assert run("most") == [(1, 2, 1), (1, 3, 2)]
    assert run("one") == [(1, 2, 1), (1, 3, 2), (6, 6, 1)]
