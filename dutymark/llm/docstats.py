"""Rule statistics of a text, computed from its UTF-8 bytes in one pass per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutymark.llm.common import SPACE

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols", "upper", "digits", "marks", "dup_lines", "repeats", "echo", "variety", "word_len", "line_len", "end_marks", "exclaim")


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more in the text, first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    vocabulary = int(ids.max()) + 1
    if vocabulary**width < 2**63:
        keys = ids[:n].copy()
        for j in range(1, width):
            keys = keys * vocabulary + ids[j : j + n]
    else:  # exact as well: number the windows step by step
        keys = ids[:n]
        for j in range(1, width):
            keys = np.unique(keys * vocabulary + ids[j : j + n], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def stats(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, RATIOS) of a text. Ratios are damped so that a few words do not make extremes."""
    words = data.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines, n_lines, n_dup = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            n_lines += 1
            n_dup += line in lines
            lines.add(line)
    inner = data.translate(None, SPACE)
    word_chars = len(inner.translate(None, bytes(range(128, 192))))
    symbols = len(inner) - len(inner.translate(None, SYMBOLS))
    repeats = repeated_words(ids)
    upper, lower = (len(inner) - len(inner.translate(None, x)) for x in (UPPER, LOWER))
    digits = len(inner) - len(inner.translate(None, DIGITS))
    marks = sum(inner.count(x) for x in (b".", b",", b";", b":", b"?"))
    echo = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    ends = sum(inner.count(x) for x in (b".", b"?"))
    ratios = (
        symbols / (n + 20), upper / (upper + lower + 100), digits / (word_chars + 100), marks / (n + 20), n_dup / (n_lines + 5), repeats / (n + 50),
        echo / (n + 20), (len(seen) + 20) / (n + 20) ** 0.85, (word_chars + 100) / (n + 20), np.log1p(n / max(1, n_lines)), (ends + 1) / (n + 20), inner.count(b"!") / (n + 20),
    )
    return (n, word_chars, symbols, n_dup, repeats), ratios


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the COUNTS and `ratios` (array of RATIOS), one row per input row. Null text counts as empty. Map only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stats(t or b"") for t in b.column(1).to_pylist()]
            counts = [pa.array([c[i] for c, _ in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([r for _, r in rows], pa.list_(pa.float64()))], ["id", *COUNTS, "ratios"])

    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {df.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, ratios array<double>"
    return df.mapInArrow(scan, schema).withColumnRenamed("id", id_col)



def labelled(rows: DataFrame, labels: DataFrame, keep=None) -> DataFrame:
    """The rows of with_stats whose document is labelled, with its quality.

    A label row without quality or id is left out; of several labels of a document the lowest counts.
    """
    own = labels.filter("quality is not null and doc_id is not null")
    if keep is not None:
        own = own.filter(keep)
    return rows.join(own.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
