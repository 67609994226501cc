"""Word search with scores: the k best rows of each question, without pairing the rows of common words in a shuffle.

A question is a list of places, each with alternative words; the last place may also stand for words that it begins. A row scores
at a place the greatest weight of its words there, in all the sum s of its places as s / (1 + s). Questions and rows meet in
blocks: a cell indexes its rows' words, adds up each question's places over whole lists of rows, and gives out its k best; what is
shuffled afterwards is k rows for each question and cell.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutymark.operators.blocks import meet

C = F.col

#: Questions of a block; rows of a cell at most, least number worth a cell of its own.
BLOCK, CELL_ROWS, LEAST_ROWS = 8_192, 32_768, 1_024
#: Texts of a code from which it is dealt over several cells; codes of a cell of code_scores at most, least number worth a cell of its own.
CODE_TEXTS, CELL_CODES, LEAST_CODES = 8_192, 2_048, 512


def plain_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def indexed(reference: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """(key, words: array of (word, weight)): the words of the weighted columns, each with its greatest weight. Rows of one key count as one."""
    own = F.array(*[F.struct(plain_words(C(column)).alias("words"), F.lit(float(weight)).alias("weight")) for column, weight in weights.items()])
    every = reference.select(C(key).alias("key"), F.inline(own)).select("key", "weight", F.explode("words").alias("word")).filter("key is not null")
    return every.groupBy("key", "word").agg(F.max("weight").alias("weight")).groupBy("key").agg(F.collect_list(F.struct("word", "weight")).alias("words"))


class Index:
    """Rows of a cell by word."""

    def __init__(self, keys: list, words: pa.ListArray) -> None:
        self.order = np.empty(len(keys), np.int64)
        self.order[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        self.keys, held = keys, {}
        owner = np.repeat(np.arange(len(keys)), words.value_lengths().to_numpy())
        flat = words.flatten()
        for row, word, weight in zip(owner.tolist(), flat.field("word").to_pylist(), flat.field("weight").to_pylist(), strict=True):
            rows, weights = held.setdefault(word, ([], []))
            rows.append(row)
            weights.append(weight)
        self.held = {w: (np.array(r), np.array(v)) for w, (r, v) in held.items()}
        self.words = sorted(self.held)

    def opened(self, word: str) -> list[str]:
        """Words of the cell that begin with word."""
        at, out = bisect_left(self.words, word), []
        while at < len(self.words) and self.words[at].startswith(word):
            out.append(self.words[at])
            at += 1
        return out

    def scores(self, places: list[list[str]], open_last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the places' weights, number of places found) of every row."""
        total, number, here = np.zeros(len(self.keys)), np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys))
        for n, words in enumerate(places):
            if open_last and n == len(places) - 1:
                # a single letter begins too much: it only stands for itself
                words = {o for w in words for o in ([w] if len(w) < 2 else self.opened(w))}
            found = [self.held[w] for w in words if w in self.held]
            for rows, weights in found:
                here[rows] = np.maximum(here[rows], weights)
            if found:
                rows = np.unique(np.concatenate([r for r, _ in found]))
                total[rows] += here[rows]
                number[rows] += 1
                here[rows] = 0
        return total, number


def best_rows(questions: DataFrame, rows: DataFrame, k: int, want: str, open_last: bool, key_type: str) -> DataFrame:
    """(ask, key, whole, score): each cell's k best rows of each question.

    questions: ask (distinct), places, prefixes (rows of other keys are left out; empty: none is). rows: key, words. want: "or", any
    place; "and", all places (whole); "both", the k best of either kind.
    """

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, picked, whole, score = [], [], [], []
        if left.num_rows and right.num_rows:
            index = Index(right.column("key").to_pylist(), right.column("words").combine_chunks())
            fits: dict[str, np.ndarray] = {}
            for ask, places, prefixes in zip(left.column("ask").to_pylist(), left.column("places").to_pylist(), left.column("prefixes").to_pylist(), strict=True):
                total, number = index.scores(places, open_last)
                live = number > 0
                for p in prefixes or ():
                    if p not in fits:
                        fits[p] = np.fromiter((str(x).startswith(p) for x in index.keys), bool, len(index.keys))
                if prefixes:
                    live &= np.logical_or.reduce([fits[p] for p in prefixes])
                squashed = np.round(total / (1 + total), 9)
                for kind in (True, False) if want == "both" else (want == "and",):
                    at = np.flatnonzero(live & (number == len(places)) if kind else live)
                    at = at[np.lexsort((index.order[at], -squashed[at]))[:k]]
                    asks += [ask] * len(at)
                    picked.append(at)
                    whole.append(np.full(len(at), kind))
                    score.append(squashed[at])
        at = np.concatenate(picked) if picked else np.empty(0, np.int64)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"ask": pa.array(asks, pa.string()), "key": right.column("key").combine_chunks().take(pa.array(at)), "whole": pa.array(flat(whole, bool)), "score": pa.array(flat(score, float))})

    blocks = max(1, -(-questions.count() // BLOCK))
    return meet(questions, "ask", blocks, rows, "key", CELL_ROWS, LEAST_ROWS, find, f"ask string, key {key_type}, whole boolean, score double")


def code_scores(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(ask, hsn_code, score, support): of each question and code the best score and the number of rows that share a word, cell by cell.

    questions: ask (distinct), qk, q (words), core. rows: id, hsn_code, bonus, dk, d (words). Of rows with one text (dk, d) and code the greatest
    bonus counts, and their number. A code's texts are in one cell, which gives out the k best codes of each question by score, support and
    code; codes with over CODE_TEXTS texts are dealt by text over several cells, which give out all of these few codes.
    """

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        codes = []
        if left.num_rows and right.num_rows:
            # distinct texts of the cell, and its entries (text, code) in order of their codes
            kinds = right.column("hsn_code").combine_chunks().dictionary_encode()
            names, code = kinds.dictionary, kinds.indices.to_numpy()
            place = np.empty(len(names), np.int64)
            place[np.argsort(np.array(names.to_pylist(), object), kind="stable")] = np.arange(len(names))
            flat, names, code = right.column("texts").combine_chunks(), names.take(pa.array(np.argsort(place))), place[code]
            code = np.repeat(code, flat.value_lengths().to_numpy())
            order, flat = np.argsort(code, kind="stable"), flat.flatten()
            _, one, owner = np.unique(flat.field("text").to_numpy(), return_index=True, return_inverse=True)
            words, texts, held, equal = flat.field("d").take(pa.array(one)).to_pylist(), flat.field("dk").take(pa.array(one)).to_pylist(), {}, {}
            size = np.fromiter(map(len, words), np.int64, len(words))
            for i, (ws, t) in enumerate(zip(words, texts, strict=True)):
                equal.setdefault(t, []).append(i)
                for w in ws:
                    held.setdefault(w, []).append(i)
            held = {w: np.array(at) for w, at in held.items()}
            code, owner = code[order], owner[order]
            bonus, number = flat.field("bonus").to_numpy(zero_copy_only=False)[order], flat.field("n").to_numpy()[order]
            whole = not right.column("shared")[0].as_py()
            for ask, qk, q, core in zip(*(left.column(c).to_pylist() for c in ("ask", "qk", "q", "core")), strict=True):
                n = np.zeros(len(words), np.int64)
                for w in q:
                    if w in held:
                        n[held[w]] += 1
                found = np.flatnonzero(n)
                if not len(found):
                    continue
                has_core = np.zeros(len(words))
                has_core[held.get(core, np.empty(0, np.int64))] = 0.10
                base, least = n / len(q) * 0.68 + n / size * 0.20 + has_core, np.zeros(len(words))
                least[[i for i in found.tolist() if qk in texts[i] or texts[i] in qk]] = 0.80
                least[equal.get(qk, [])] = 0.95
                at = np.flatnonzero(n[owner])
                score = base[owner[at]] + bonus[at]
                score = np.where(least[owner[at]] > 0, np.maximum(score, least[owner[at]]), score)
                first = np.flatnonzero(np.diff(code[at], prepend=-1))
                own = code[at][first]
                score, number_of = np.round(np.minimum(1.0, np.maximum.reduceat(score, first)), 9), np.add.reduceat(number[at], first)
                if whole:
                    best = np.lexsort((own, -number_of, -score))[:k]
                    own, score, number_of = own[best], score[best], number_of[best]
                out[0].extend([ask] * len(own))
                out[1].append(own)
                out[2].append(score)
                out[3].append(number_of)
            codes = names.take(pa.array(np.concatenate(out[1]))) if out[1] else []
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"ask": pa.array(out[0], pa.string()), "hsn_code": codes if len(codes) else pa.array([], pa.string()), "score": pa.array(flat(out[2], float), pa.float64()), "support": pa.array(flat(out[3], np.int64), pa.int64())})

    entries = rows.groupBy("dk", "d", "hsn_code").agg(F.max("bonus").alias("bonus"), F.count(F.lit(1)).alias("n")).withColumn("text", F.xxhash64("dk", "d"))
    size = entries.groupBy("hsn_code").agg(F.count(F.lit(1)).alias("size"))
    few = entries.join(size.filter(C("size") > CODE_TEXTS).select("hsn_code", "size"), "hsn_code", "left")
    dealt = few.withColumn("shared", C("size").isNotNull()).withColumn("part", F.when(C("shared"), F.pmod("text", F.ceil(C("size") / CODE_TEXTS))).otherwise(F.lit(0).cast("long")))
    owned = dealt.groupBy("hsn_code", "part", "shared").agg(F.collect_list(F.struct("text", "dk", "d", "bonus", "n")).alias("texts")).withColumn("row", F.xxhash64("hsn_code", "part"))
    blocks = max(1, -(-questions.count() // BLOCK))
    cells = [meet(questions, "ask", blocks, owned.filter(kind), "row", CELL_CODES, LEAST_CODES, find, "ask string, hsn_code string, score double, support long") for kind in ("not shared", "shared")]
    return cells[0].unionByName(cells[1])
