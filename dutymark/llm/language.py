"""Language of texts by a bidirectional gated recurrent network over their bytes.

1. Windows of labelled texts, about as many of each language, are drawn by hashes; their number is bounded.
2. The network is trained on them (gru.py) and broadcast.
3. One pass over the texts: every position gets label probabilities; a document's are the means over its letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import crc_mod, table
from dutymark.llm.gru import AT_ONCE, LETTERS, WINDOW, Network, train, windows_of

#: Bounds of the training sample: languages (the most frequent ones), documents and windows of each language, windows of a document, their bytes.
MAX_LANGUAGES, DOCS_EACH, WINDOWS_EACH, MAX_WINDOWS, TRAIN_WINDOW = 256, 600, 1_200, 16, 64
UNKNOWN = "und"


def _has_letter() -> Column:
    return F.col("text").rlike(r"\p{L}")


def _drawn(budget: int):
    """Windows of training texts that hold a letter: of a document's places those with the least hashed numbers, wherever they lie."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, window, key = [], [], []
            for name, data, k, n in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("pick").to_pylist(), b.column("docs").to_pylist(), strict=True):
                rng = np.random.default_rng(abs(k))
                some = min(MAX_WINDOWS, -(-budget // max(1, min(n, DOCS_EACH))))
                starts = np.unique(np.r_[0, rng.integers(0, max(1, len(data) - TRAIN_WINDOW + 1), 2 * some)]) if len(data) > TRAIN_WINDOW else np.zeros(1, int)
                starts = rng.permutation(starts)
                parts = [data[s : s + TRAIN_WINDOW] for s in starts.tolist()]
                parts = [p for p in parts if LETTERS[np.frombuffer(p, np.uint8)].any()][:some]
                lang += [name] * len(parts)
                window += parts
                key += [k] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(window, pa.binary()), pa.array(key, pa.int64())], ["lang", "window", "pick"])

    return cut


def training_windows(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """(lang, window, pick): at most MAX_LANGUAGES * 2 * DOCS_EACH * MAX_WINDOWS windows, of rows with a language and a letter.

    Languages are counted over all rows; a row is drawn with the rate DOCS_EACH / rows of its language, by a hash of its id and text.
    Rarer languages give more windows a document, WINDOWS_EACH in all as far as their texts reach.
    """
    own = docs.filter(F.col("lang").isNotNull() & _has_letter())
    if keep is not None:
        own = own.filter(keep)
    own = own.select("lang", "text", F.xxhash64(F.lit("windows"), "doc_id", "text").alias("pick"))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(MAX_LANGUAGES)
    drawn = own.join(F.broadcast(sizes), "lang").filter(F.pmod("pick", F.lit(1_000_003)) < F.lit(1_000_003.0 * DOCS_EACH) / F.col("docs"))
    return drawn.select("lang", F.col("text").cast("binary").alias("text"), "pick", "docs").mapInArrow(_drawn(WINDOWS_EACH), "lang string, window binary, pick long")


def fit(docs: DataFrame, keep: Column | None = None) -> Network | None:
    """The network trained on the drawn windows, or None where no row has a language and a letter. keep: condition on doc_id."""
    most = MAX_LANGUAGES * 2 * DOCS_EACH * MAX_WINDOWS
    found = training_windows(docs, keep).orderBy("pick", "lang", "window").limit(most).toArrow()
    if not found.num_rows:
        return None
    labels = sorted(set(found.column("lang").to_pylist()))
    data = found.column("window").to_pylist()
    length = np.array([len(d) for d in data])
    rows = np.zeros((len(data), TRAIN_WINDOW), np.uint8)
    for i, d in enumerate(data):
        rows[i, : len(d)] = np.frombuffer(d, np.uint8)
    return train(rows, length, np.searchsorted(labels, found.column("lang").to_pylist()), labels)


class Reader:
    """Probabilities of documents: windows of several documents are scored together, long ones in slices."""

    def __init__(self, net: Network) -> None:
        self.net = net

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean label probabilities over the letters of each text; 0 where it has none."""
        total, count = np.zeros((len(texts), len(self.net.labels))), np.zeros(len(texts))
        rows, length, owner, held = [], [], [], 0

        def score() -> None:
            r, n, o = np.concatenate(rows), np.concatenate(length), np.concatenate(owner)
            order = np.argsort(-n, kind="stable")
            r, n, o = r[order], n[order], o[order]
            for low in range(0, len(r), AT_ONCE):
                p, letters = self.net.sums(r[low : low + AT_ONCE], n[low : low + AT_ONCE])
                np.add.at(total, o[low : low + AT_ONCE], p)
                np.add.at(count, o[low : low + AT_ONCE], letters)
            rows.clear(), length.clear(), owner.clear()

        with np.errstate(over="ignore"):
            for i, data in enumerate(texts):
                for r, n in windows_of(data or b"", 8 * AT_ONCE):
                    rows.append(r), length.append(n), owner.append(np.full(len(n), i))
                    held += len(n)
                    if held >= 8 * AT_ONCE:
                        score()
                        held = 0
            if rows:
                score()
        return total / np.maximum(1, count)[:, None]

    def spans(self, data: bytes | None) -> list[dict]:
        """Runs of letters' positions with one most probable label, as bytes; what is no letter goes with the letter before."""
        out: list[dict] = []
        at = 0
        for rows, length in windows_of(data or b""):
            with np.errstate(over="ignore"):
                best = self.net.probabilities(rows, length).argmax(2)
            live = np.arange(WINDOW) < length[:, None]
            best, letters = best[live], LETTERS[rows[live]]
            place = np.flatnonzero(letters)
            change = np.flatnonzero(np.r_[True, best[place][1:] != best[place][:-1]]) if len(place) else []
            for i, c in enumerate(change):
                end = place[change[i + 1] - 1] if i + 1 < len(change) else place[-1]
                run = {"start": at + int(place[c]), "end": at + int(end) + 1, "lang": self.net.labels[best[place[c]]]}
                if out and out[-1]["lang"] == run["lang"]:
                    out[-1]["end"] = run["end"]
                else:
                    out.append(run)
            at += int(length.sum())
        return out


def identify(docs: DataFrame, net: Network | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row, and spans (byte ranges of one label) if wanted. Map only.

    A null text, one without a letter, and every text where nothing could be learned is `und` with score 0. The score is the label's mean
    probability over all letters of the whole text; of equal ones the first label counts. Equal texts get equal scores but for the last digits of single-precision sums.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    source = docs.select("doc_id", F.when(_has_letter(), F.col("text").cast("binary")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            if net is None:
                name, value, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            else:
                reader = Reader(net)
                p = reader.pooled(texts)
                best = p.argmax(1)
                name = [UNKNOWN if t is None else net.labels[k] for t, k in zip(texts, best, strict=True)]
                value = [0.0 if t is None else min(1.0, float(r[k])) for t, k, r in zip(texts, best, p, strict=True)]
                runs = [reader.spans(t) for t in texts] if spans else []
            columns = [b.column("doc_id"), pa.array(name, pa.string()), pa.array(value, pa.float64())] + ([pa.array(runs, span_type)] if spans else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return source.mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double{more}")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
