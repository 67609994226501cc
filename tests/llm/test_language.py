import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutymark.llm import gru, language
from dutymark.llm.common import crc_mod
from tests.llm.cases import awkward_docs, no_docs, texts_of


def network(labels=3, hidden=4, seed=1, kind=np.float64):
    net = gru.Network.blank([f"l{i}" for i in range(labels)], hidden, seed)
    rng = np.random.default_rng(seed)
    net.params = {k: (v + rng.normal(0, 0.1, v.shape)).astype(kind) for k, v in net.params.items()}
    return net


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_labels(net, window):
    """Probabilities of each byte of a window, one byte after another."""
    p, sums = net.params, np.zeros((len(window), len(net.labels))) + net.params["bias"]
    for way in "fb":
        h = np.zeros(len(p[f"{way}_plus"]))
        for t in range(len(window)) if way == "f" else reversed(range(len(window))):
            b = window[t]
            r, z = (sigmoid(p[f"{way}_in_{g}"][b] + h @ p[f"{way}_state_{g}"]) for g in "rz")
            c = np.tanh(p[f"{way}_in_c"][b] + r * (h @ p[f"{way}_state_c"] + p[f"{way}_plus"]))
            h = (1 - z) * c + z * h
            sums[t] += h @ p[f"{way}_out"]
    e = np.exp(sums - sums.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def plain_text(net, data):
    windows = [data[i : i + gru.WINDOW] for i in range(0, len(data), gru.WINDOW)]
    p = np.concatenate([plain_labels(net, w) for w in windows])
    live = gru.LETTERS[np.frombuffer(data, np.uint8)]
    return p, p[live].sum(0) / max(1, live.sum())


TEXTS = [b"a", b"", b"12 34", "hé très bien".encode(), b"some words " * 40, bytes(range(32, 127)) * 3, b"x" * gru.WINDOW, b"y" * (gru.WINDOW + 1)]


def test_scores_equal_a_byte_by_byte_reading():
    net = network()
    got = language.Reader(net).pooled([*TEXTS, None])
    for p, data in zip(got, [*TEXTS, b""], strict=True):
        want = plain_text(net, data)[1] if data else np.zeros(3)
        assert np.allclose(p, want, atol=1e-9)


def test_positions_and_spans():
    net = network(2, seed=4)
    for data in TEXTS:
        if not data:
            continue
        want = plain_text(net, data)[0]
        rows, length = next(gru.windows_of(data))
        got = net.probabilities(rows, length)
        assert np.allclose(np.concatenate([g[:n] for g, n in zip(got, length, strict=True)]), want, atol=1e-9)
        best, spans = want.argmax(1), language.Reader(net).spans(data)
        for i, b in enumerate(data):
            inside = [s for s in spans if s["start"] <= i < s["end"]]
            assert len(inside) <= 1 and (not gru.LETTERS[b] or inside[0]["lang"] == f"l{best[i]}")
        assert all(a["lang"] != b["lang"] for a, b in zip(spans, spans[1:], strict=False))


def test_slices_of_long_texts(monkeypatch):
    net, data = network(), b"lorem ipsum 12 " * 900
    whole = language.Reader(net).pooled([data, b"abc", data])
    monkeypatch.setattr(language, "AT_ONCE", 7)
    assert np.allclose(language.Reader(net).pooled([data, b"abc", data]), whole)


@pytest.mark.parametrize("lengths", [[9, 9, 7, 3, 1], [5], [12, 1, 1]])
def test_gradients_equal_differences(lengths):
    rng = np.random.default_rng(2)
    net, length = network(), np.array(lengths)
    rows = rng.integers(60, 130, (max(lengths), len(lengths))).astype(np.uint8)
    target = rng.integers(0, 3, len(lengths))
    _, g = net.gradients(rows, length, target)
    for name, value in net.params.items():
        places = [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]
        if "_in_" in name:
            places += [(rows[0, 0], 1), (rows[lengths[-1] - 1, -1], 0)]
        for at in places:
            old, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                losses.append(net.gradients(rows, length, target)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-7, name


def test_held_out_texts_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = language.op11_language_id(spark, sf_dir.replace("0.001", "0.01")).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows} <= {"de", "en", "es", "fr", "und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_learning_ignores_held_out_rows_and_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 3) == 1
    turned = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).repartition(7)
    a, b = (language.fit(d, ~held) for d in (docs, turned))
    assert a.labels == b.labels == ["de", "en", "es", "fr"]
    assert all((a.params[k] == b.params[k]).all() for k in a.params)


def test_sample_is_bounded_and_balanced(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language, "DOCS_EACH", 40)
    monkeypatch.setattr(language, "WINDOWS_EACH", 80)
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    drawn = {r["lang"]: r["count"] for r in language.training_windows(docs).groupBy("lang").count().collect()}
    assert set(drawn) == {"de", "en", "es", "fr"} and all(30 <= n <= 2 * 80 for n in drawn.values())


def test_awkward_rows(spark):
    more = spark.createDataFrame([(20, "12 34 --", "en"), (21, "中文", "zh"), (22, "ß", None), (23, "— …", "en"), (24, "tail " * 400_000, "en")], "doc_id long, text string, lang string")
    docs = awkward_docs(spark).unionByName(more, allowMissingColumns=True)
    net = language.fit(docs)
    assert net.labels == ["en", "zh"]
    rows = language.identify(docs, net, spans=True).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "lang_pred", "score", "spans"}
    texts = dict(texts_of(docs.filter("doc_id is not null")))
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            blank = not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == blank and (r["score"] == 0) == blank and (blank <= (not r["spans"]))
    assert len({(r["lang_pred"], round(r["score"], 3)) for r in rows if r["doc_id"] in (1, 2)}) == 1
    for none in (no_docs(spark), docs.withColumn("lang", F.lit(None).cast("string")), docs.filter("doc_id = 20")):
        assert language.fit(none) is None
        assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, None).collect()} == {("und", 0.0)}
    one = language.fit(docs.filter("lang = 'zh'"))
    assert {r["lang_pred"] for r in language.identify(docs, one).collect()} == {"und", "zh"}
    assert language.identify(no_docs(spark), net).count() == 0
