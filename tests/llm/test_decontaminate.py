import random

import numpy as np

from dutymark.llm.decontaminate import GAP, LEAST_SCATTERED, MATCH, MIN_SCORE, MISMATCH, SEED, Block, align, copies_in, drop_copies, find_copies
from tests.llm.cases import awkward_docs, no_docs

ITEMS = "item_id long, text string, score string"


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if x == y else MISMATCH), h[i - 1][j] - GAP, h[i][j - 1] - GAP)
    return max(map(max, h))


def test_alignment_equals_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert align(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def prose(rng, n):
    return [f"t{rng.randrange(300)}" for _ in range(n)]


def test_exact_and_edited_copies_are_found(spark):
    rng = random.Random(7)
    items = [(i, " ".join(prose(rng, 40)) + ".") for i in range(30)]
    rows, planted = [], set()
    for d in range(120):
        words = prose(rng, 200)
        if d % 4 == 0:
            i = rng.randrange(30)
            copy = items[i][1].upper().split() if d % 8 else items[i][1].split()
            if d % 3 == 0:
                for _ in range(6):
                    k = rng.randrange(len(copy))
                    copy[k : k + 1] = rng.choice([[], ["new"], [copy[k], "more"]])
            at = rng.randrange(200)
            words[at:at] = copy
            planted.add((d, i))
        rows.append((d, " ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (100_000, 2_000):
        found = find_copies(docs, bench, block_chars=block_chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    whole = dict(rows)
    for r in found:
        span = whole[r["doc_id"]].split()[r["first_word"] : r["end_word"]]
        assert r["score"] <= 1 and 25 <= len(span) <= 55
    assert {r["doc_id"] for r in drop_copies(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in planted}


def test_a_copy_in_most_documents_is_still_found(spark):
    rng = random.Random(3)
    item = " ".join(prose(rng, 30))
    docs = spark.createDataFrame([(d, " ".join(prose(rng, 20)) + " " + item) for d in range(50)], "doc_id long, text string")
    assert find_copies(docs, spark.createDataFrame([(1, item, None)], ITEMS)).count() == 50


def test_copies_with_many_edited_words_are_found_without_a_whole_copy(spark):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, 40))) for i in range(60)]
    rows, planted = [], set()
    for i, text in items:
        words = text.split()
        for k in rng.sample(range(40), 6 + i % 5):
            words[k] = f"edit{k}"
        score = align(np.array([hash(w) for w in text.split()]), np.array([hash(w) for w in words]))[0] / (MATCH * 40)
        kept = any(not any(w.startswith("edit") for w in words[k : k + 3]) for k in range(38))
        if score >= 0.45 and kept:
            planted.add((i, i))
        rows.append((i, " ".join(prose(rng, 60) + words + prose(rng, 60))))
    rows += [(100 + i, " ".join(prose(rng, 150))) for i in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(planted) >= 50
    assert planted <= {(r["doc_id"], r["item_id"]) for r in find_copies(docs, bench).collect()}


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    bench = spark.createDataFrame([(1, docs.filter("doc_id = 2").first()["text"], "x"), (1, docs.filter("doc_id = 2").first()["text"], "x"), (2, None, None), (None, "", None), (3, "two words", None)], ITEMS)
    ids = sorted((r["doc_id"] for r in find_copies(docs, bench).collect()), key=lambda x: x or 0)
    assert ids == [None, 1, 1, 2, 7, 8]  # item 3 has two words, which 7 and 8 hold whole
    kept = drop_copies(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6
    nothing = spark.createDataFrame([], ITEMS)
    assert find_copies(docs, nothing).count() == 0 and find_copies(no_docs(spark), bench).count() == 0


def test_equals_alignment_of_all_pairs(spark):
    """Every document and item, short items with a common run of SEED words, whatever was inserted or replaced."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate((1, 2, 12, 40, 40, 60))]
    rows = []
    for d in range(80):
        words = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randrange(30)):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randrange(2)] = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(1, 4))]
        rows.append((d, " ".join([*(f"w{rng.randrange(400)}" for _ in range(rng.randrange(20))), *words])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, text in rows:
        for i, item in items:
            a, b = item.split(), text.split()
            n = min(SEED, len(a))
            runs = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            number = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
            score = align(np.array([number[w] for w in a]), np.array([number[w] for w in b]))[0] / (2 * len(a))
            if score >= MIN_SCORE and (len(a) >= LEAST_SCATTERED or any(tuple(a[k : k + n]) in runs for k in range(len(a) - n + 1))):
                want[d, i] = round(score, 9)
    assert len(want) > 40
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in find_copies(docs, bench).collect()} == want


def test_copies_without_a_run_of_equal_words_are_found(spark):
    """Every third word replaced, a word put between each two, or every word pair: no n-gram is left."""
    rng = random.Random(13)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30 + i))) for i in range(12)]
    rows, want = [], {}
    for i, text in items:
        a = text.split()
        edits = ([f"e{k}" if k % 3 == 1 else w for k, w in enumerate(a)], [x for k, w in enumerate(a) for x in (w, f"e{k}")][:-1], [x for k, w in enumerate(a) for x in ((w, f"e{k}") if k % 2 else (w,))])
        for e, words in enumerate(edits):
            assert not {tuple(a[k : k + 3]) for k in range(len(a) - 2)} & {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
            filler = [[f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(2)]
            number = {w: k for k, w in enumerate(dict.fromkeys([*a, *words, *filler[0], *filler[1]]))}
            whole = filler[0] + words + filler[1]
            score = align(np.array([number[w] for w in a]), np.array([number[w] for w in whole]))[0] / (MATCH * len(a))
            assert score >= MIN_SCORE
            rows.append((3 * i + e, " ".join(whole)))
            want[3 * i + e, i] = round(score, 9)
    found = find_copies(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=3000).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in found} == want


def test_equals_all_pairs_over_few_words(monkeypatch):
    """Few different words, so that chance copies, repeated words and scattered matches abound; rare words are read in small parts."""
    monkeypatch.setattr("dutymark.llm.decontaminate.PLACES", 50)
    rng = random.Random(17)
    for words, floor in ((12, 0.45), (40, 0.45), (40, 0.3), (40, 0.6)):
        rows = [(i, " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(8, 40)))) for i in range(25)]
        block, count = Block.of(rows, floor), 0
        for _ in range(40):
            some = lambda n: [rng.randrange(-1, len(block.vocabulary)) for _ in range(n)]
            edited, rate = [], rng.random()
            for w in rng.choice(block.items):
                edited += rng.choice(([], some(1), [w, *some(1)])) if rng.random() < rate else [w]
            numbers = np.array(some(rng.randrange(0, 60)) + edited + some(rng.randrange(0, 60)), np.int64)
            want = {i: s for i, x in enumerate(block.items) if (s := align(x, numbers)[0] / (MATCH * len(x))) >= floor}
            assert {i: s for i, s, *_ in copies_in(numbers, block, floor)} == want
            count += len(want)
        assert count >= 10
