import random

from dutymark.llm import substrings
from dutymark.llm.substrings import SuffixAutomaton, remove_duplicates, remove_reference_spans
from tests.llm.cases import awkward_docs, no_docs, texts_of


def brute(rows, window=20):
    """Removed windows are those whose words also start at a smaller (doc_id, start)."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, (key(d), s)), (key(d), s))
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (key(d), s):
                gone[s : s + window] = [True] * window
        out.append((d, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def random_rows(n=60, seed=2):
    rng = random.Random(seed)
    passages = [[f"p{k}q{rng.randrange(40)}" for _ in range(rng.randrange(18, 70))] for k in range(4)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p) // 2)
                words += p[a : a + rng.randrange(10, len(p))]
            else:
                words += [f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = random_rows()
    assert got(remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_equals_brute_force_when_common_anchors_are_dealt(spark, monkeypatch):
    rows = random_rows(seed=5)
    monkeypatch.setattr(substrings, "COMMON", 2)
    assert got(remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_equals_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(remove_duplicates(docs)) == brute(texts_of(docs))


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    assert got(remove_duplicates(docs)) == brute(texts_of(docs))
    assert remove_duplicates(no_docs(spark)).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        query = [rng.randrange(3) for _ in range(30)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        known = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        want = [max([n for n in range(i + 2) if n == 0 or tuple(query[i + 1 - n : i + 1]) in known]) for i in range(len(query))]
        assert list(automaton.matching(query)) == want


def test_reference_spans_over_several_shards(spark):
    words = [f"r{i}" for i in range(300)]
    reference = spark.createDataFrame([(" ".join(words[a : a + 60]),) for a in range(0, 300, 60)] + [(None,)], "text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[10:45]) + " c"), (2, " ".join(words[10:25])), (3, None), (3, "x")], "doc_id long, text string")
    out = got(remove_reference_spans(docs, reference, 20, shard_words=20))
    assert out == sorted([(1, 38, 35, "a b c"), (2, 15, 0, " ".join(words[10:25])), (3, 0, 0, ""), (3, 1, 0, "x")], key=repr)
