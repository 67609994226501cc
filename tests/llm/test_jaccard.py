import random

import numpy as np

from dutymark.llm.jaccard import HASHES, STEP, drop_near_duplicates, least_matches, near_duplicates
from tests.llm.cases import awkward_docs, no_docs, texts_of


def shingle_set(text):
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """(doc_id, text) -> (class_id, n_links) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            low = min([label[i], *(label[j] for j in own)])
            changed |= low != label[i]
            label[i] = low
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    first = {}
    for i in range(len(rows)):
        if label[i] not in first or key(i) < key(first[label[i]]):
            first[label[i]] = i
    return [(rows[i][0], rows[first[label[i]]][0], len(links[i])) for i in range(len(rows))]


def group_of_edits(n, seed=4):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_equals_brute_force_on_edited_copies(spark):
    rows = group_of_edits(330)  # two blocks
    rows += [(1000 + i, f"quite another text number {i} with words of its own {i * 17} and more {i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect())
    assert got == sorted(brute(rows))


def test_equals_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect())
    assert got == sorted(brute(texts_of(docs)))


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    key = lambda r: [(x is not None, x or 0) for x in r]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute(texts_of(docs)), key=key)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [3, 4, 5, 6, 7, 9, 10] and ids.count(None) == 2
    assert near_duplicates(no_docs(spark)).count() == 0 and drop_near_duplicates(no_docs(spark)).count() == 0


def test_pruning_table_keeps_likely_pairs():
    table = least_matches(0.8)
    assert len(table) == HASHES // STEP
    rng = np.random.default_rng(1)
    kept = np.ones(20_000, bool)
    matches = np.zeros(20_000, int)
    for least in table:
        matches += rng.binomial(STEP, 0.8, 20_000)
        kept &= matches >= least
    assert kept.mean() > 0.998
    assert all(m > 0.4 * STEP * (i + 1) for i, m in enumerate(table) if i)
