"""Which keywords stand inside which texts: an automaton over all keywords reads each distinct text once.

A table of keywords up to a measured number of bytes is broadcast and the texts stay where they are. A larger one is
dealt in shards; a shard's automaton meets the texts in cells of bounded size. Either way no keyword and no part of a text
is a join key, so that common ones gather nothing; the work is the letters read and the pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutymark.operators.blocks import meet

C = F.col

#: Bytes of keywords that are broadcast at most, and bytes of a shard beyond; texts of a cell at most, least number worth a cell of its own.
BROADCAST_BYTES, SHARD_BYTES, CELL_TEXTS, LEAST_TEXTS = 1 << 20, 4 << 20, 65_536, 1_024

_PAIRS = "text string, keyword string"


def automaton(keywords: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k in keywords:
        out.add_word(k, k)
    out.make_automaton()
    return out


def found(machine: ahocorasick.Automaton, texts: list[str | None]) -> tuple[list[str], list[str]]:
    """(texts, keywords) of all pairs, each once."""
    one, two = [], []
    if len(machine):
        for t in texts:
            if t:
                inside = {k for _, k in machine.iter(t)}
                one += [t] * len(inside)
                two += inside
    return one, two


def contained(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(text, keyword) of all distinct pairs in which the keyword (column keyword) stands inside the text (column text).

    Letters must be equal. Null and empty keywords and null texts have no pairs.
    """
    texts = texts.select("text").distinct().filter("text <> ''")
    keywords = keywords.select("keyword").distinct().filter("keyword <> ''")
    size = keywords.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = texts.sparkSession.sparkContext.broadcast([r["keyword"] for r in keywords.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for b in batches:
                one, two = found(machine, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string())], ["text", "keyword"])

        return texts.mapInArrow(scan, _PAIRS)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = found(automaton(left.column("keyword").to_pylist()), right.column("text").to_pylist()) if left.num_rows and right.num_rows else ([], [])
        return pa.table({"text": pa.array(one, pa.string()), "keyword": pa.array(two, pa.string())})

    return meet(keywords, "keyword", -(-size // SHARD_BYTES), texts, "text", CELL_TEXTS, LEAST_TEXTS, both, _PAIRS)


def containing(df: DataFrame, column: Column, keywords: DataFrame, fold=F.lower) -> DataFrame:
    """df's rows with each row of keywords whose keyword stands inside `column`, both folded; a row may come several times."""
    own = df.withColumn("__text", fold(column))
    folded = keywords.withColumn("__keyword", fold(C("keyword")))
    pairs = contained(own.select(C("__text").alias("text")), folded.select(C("__keyword").alias("keyword"))).select(C("text").alias("__text"), C("keyword").alias("__keyword"))
    return own.join(pairs, "__text").join(folded, "__keyword").drop("__text", "__keyword")
