"""Benchmark decontamination: n-grams of test items seed, Smith-Waterman alignment scores.

One pass finds the n-grams of the items in each document, and aligns the item with the words around
them. Every n-gram seeds, as an edited copy can have lost any of them; an item shorter than that seeds as a whole.
A copy may have lost all of them and still score: with runs of at most SEED - 1 equal words it must then hold a large share of the item's
words. So of each item the rarest words seed too, so many that such a copy holds several of them close together, wherever it was edited.
Items are handled in blocks of bounded size, each broadcast; a document meets its seeds in its own row, so no text is shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.llm.common import row_key, spare, table

#: Words per seed, score from which a document counts as a copy.
SEED, MIN_SCORE = 3, 0.45
#: Characters of items in a block, which is broadcast; at most 2 ** 20 words, so that SEED word numbers fit in 63 bits.
BLOCK_CHARS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
#: Items of fewer words need a run of SEED equal words: a few scattered words are no copy.
LEAST_SCATTERED = 8
#: Rare words of an item that must stand close together, as a share of the item and at least.
CLOSE_SHARE, LEAST_CLOSE = 0.2, 3
#: Places of rare words that are looked at in one go.
PLACES = 1_000_000

_BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_BLANKS).split()


@dataclass
class Block:
    """Items of one block: word numbers, and the n-grams with their items and places."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    widths: list[int] = field(default_factory=list)
    # rare words: where the items of each word start in seeded; for each item the seeds needed, the places they stand in, its words that must match
    first: np.ndarray | None = None
    seeded: np.ndarray | None = None
    close: np.ndarray | None = None
    span: np.ndarray | None = None
    share: np.ndarray | None = None
    sizes: np.ndarray | None = None
    #: a mark for each word and one for words of no item; False between uses
    marks: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple], min_score: float = MIN_SCORE) -> Block:
        vocabulary: dict[bytes, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in plain_words(t)], np.int64) for _, t in rows]
        block = cls([i for i, _ in rows], items, vocabulary, *(np.empty(0, np.int64),) * 3)
        grams = [block.grams(x, min(SEED, len(x))) for x in items]
        if grams:
            block.keys = np.concatenate([g[1] for g in grams])
            block.place = np.concatenate([g[0] for g in grams])
            block.owner = np.repeat(np.arange(len(items)), [len(g[0]) for g in grams])
        order = np.argsort(block.keys, kind="stable")
        block.keys, block.owner, block.place = block.keys[order], block.owner[order], block.place[order]
        block.widths = sorted({min(SEED, len(x)) for x in items if len(x)})
        block.choose_words(min_score)
        return block

    def choose_words(self, min_score: float) -> None:
        """The rare words of each item.

        With m equal words in runs of at most SEED - 1 at least m / (SEED - 1) - 1 edits lie between them, which bounds m from below; the item's
        other words can be missing, so any len - m + t of its places hold t equal ones. A copy's edits are bounded too, hence its length.
        """
        n = len(self.items)
        self.sizes, self.marks = np.fromiter((len(x) for x in self.items), np.int64, n), np.zeros(len(self.vocabulary) + 1, bool)
        held = [np.unique(x) for x in self.items]
        spread = np.bincount(np.concatenate([np.empty(0, np.int64), *held]), minlength=len(self.vocabulary) + 1)
        letters = np.fromiter((len(w) for w in self.vocabulary), np.int64, len(self.vocabulary))
        self.close, self.span, self.share = np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, min_score)
        words, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cost = min(GAP, -MISMATCH)
        for i, x in enumerate(self.items):
            size = len(x)
            least = max(1, int(np.ceil((MATCH * size * min_score - cost) / (MATCH - cost / (SEED - 1)) - 1e-9)))
            if size < LEAST_SCATTERED or least > size:
                continue
            self.close[i] = min(least, max(LEAST_CLOSE, int(CLOSE_SHARE * size)))
            self.span[i] = size + int(MATCH * size * (1 - min_score)) // cost + 1
            self.share[i] = least / size - 1e-9
            own, times = np.unique(x, return_counts=True)
            order = np.lexsort((own, -letters[own], spread[own]))
            enough = int(np.searchsorted(np.cumsum(times[order]), size - least + self.close[i])) + 1
            words.append(own[order[:enough]])
            owners.append(np.full(len(words[-1]), i))
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        self.seeded = owner[order]
        self.first = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))

    def grams(self, numbers: np.ndarray, width: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the runs of `width` words that are all in the vocabulary; runs under SEED words have negative keys."""
        n = len(numbers) - width + 1
        if n <= 0 or width < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = numbers >= 0
        whole = known[:n].copy()
        key = numbers[:n].copy()
        for j in range(1, width):
            whole &= known[j : j + n]
            key = key * len(self.vocabulary) + numbers[j : j + n]
        at = np.flatnonzero(whole)
        return at, key[at] if width == SEED else -1 - key[at] - (width - 1) * len(self.vocabulary)

    def numbers(self, text: str | None) -> np.ndarray:
        words = plain_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, indices into keys) of all n-grams of the items."""
        found = [self.grams(numbers, w) for w in self.widths]
        at, key = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in range(2))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        return np.repeat(at, count), spread_out(low, count)

    def crowds(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, first places, last places) of rare words of an item that stand close enough together, PLACES at a time."""
        at = np.flatnonzero(numbers >= 0)
        low, high = self.first[numbers[at]], self.first[numbers[at] + 1]
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        total, reach, begin = np.cumsum(count), int(self.span.max(initial=0)), 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES)))
            # those that start here may end within the reach
            until = int(np.searchsorted(at, at[end - 1] + reach, "right"))
            owner = self.seeded[spread_out(low[begin:until], count[begin:until])]
            place = np.repeat(at[begin:until], count[begin:until])
            order = np.argsort(owner, kind="stable")
            owner, place = owner[order], place[order]
            last = np.arange(len(owner)) + self.close[owner] - 1
            inside = last < len(owner)
            k, last = np.flatnonzero(inside), last[inside]
            good = (owner[k] == owner[last]) & (place[last] - place[k] < self.span[owner[k]])
            yield owner[k[good]], place[k[good]], place[last[good]]
            begin = end


def spread_out(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for each count."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment: (score, end in words). Row by row; the gap along a row is a running maximum."""
    best, end = 0, 0
    steps = GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for w in item:
        down = np.maximum(row - GAP, 0)
        down[1:] = np.maximum(down[1:], row[:-1] + np.where(words == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(down + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def regions(numbers: np.ndarray, block: Block, min_score: float) -> Iterator[tuple[int, int, int, int]]:
    """(item index, first word, end word, n-grams) of the parts of a text that may hold a copy; those of an item do not overlap."""
    places, found = block.hits(numbers)
    owner, start = block.owner[found], places - block.place[found]
    # words that an alignment can skip before its score falls below min_score
    reach = (MATCH * block.sizes[owner] * (1 - min_score)).astype(np.int64) // GAP + 1
    parts = [(owner, start - reach, start + block.sizes[owner] + reach, np.ones(len(owner), np.int64))]
    parts += [(i, one - block.span[i], two + block.span[i] + 1, np.zeros(len(i), np.int64)) for i, one, two in block.crowds(numbers)]
    owner, low, high, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(owner):
        return
    low, high = np.maximum(low, 0), np.minimum(high, len(numbers))
    order = np.lexsort((low, owner))
    owner, low, high, grams = owner[order], low[order], high[order], grams[order]
    line = len(numbers) + 1  # each item on a stretch of its own
    ends = np.maximum.accumulate(owner * line + high)
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] * line + low[1:] > ends[:-1])))
    tails = np.append(heads[1:], len(owner)) - 1
    yield from zip(owner[heads].tolist(), low[heads].tolist(), (ends[tails] - owner[heads] * line).tolist(), np.add.reduceat(grams, heads).tolist(), strict=True)


def copies_in(numbers: np.ndarray, block: Block, min_score: float) -> Iterator[tuple[int, float, int, int, int]]:
    """(item index, score, first word, end word, seeds) of the best copy of each item in a text."""
    for i, parts in groupby(regions(numbers, block, min_score), key=lambda r: r[0]):
        item, best = block.items[i], (0.0, 0, 0, 0)
        for _, low, high, grams in parts:
            near = numbers[low:high]
            # each matched word must occur
            block.marks[near] = True
            held = np.count_nonzero(block.marks[item])
            block.marks[near] = False
            if held < (min_score if grams else block.share[i]) * len(item):
                continue
            score, end = align(item, near)
            score = score / (MATCH * len(item))
            if score > best[0]:
                _, back = align(item[::-1], near[:end][::-1])
                best = (score, low + end - back, low + end, grams)
        if best[0] >= min_score:
            yield i, *best


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, min_score: float = MIN_SCORE) -> Iterator[Block]:
    """Blocks of items, one at a time."""
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // block_chars))
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Block.of([(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()], min_score)


def find_copies(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, seeds) for each document and item that align.

    score is the alignment's score over that of the whole item. One row per input row and item: repeated rows
    repeat. Null or empty texts and items match nothing; ids may be null. Found are the best alignments of any length that min_score allows;
    items under LEAST_SCATTERED words need a run of SEED equal words (under SEED words: the whole item). seeds counts the runs of SEED words.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    id_type, item_type = source.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, score double, first_word long, end_word long, seeds long"
    out = spark.createDataFrame([], schema)
    for whole in item_blocks(benchmark, block_chars, min_score):
        if not len(whole.keys):
            continue
        block_b = spark.sparkContext.broadcast(whole)

        def search(batches: Iterator[pa.RecordBatch], block_b=block_b) -> Iterator[pa.RecordBatch]:
            block = block_b.value
            for b in batches:
                rows = [(doc, block.ids[i], *x) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, *x in copies_in(block.numbers(text), block, min_score)]
                names = ["doc_id", "item_id", "score", "first_word", "end_word", "seeds"]
                kinds = [b.schema.field(0).type, None, pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                kinds[1] = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

        out = out.union(source.mapInArrow(search, schema))
    return out


def drop_copies(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that hold no copy of an item, with their columns."""
    rid = spare(docs, "rid")
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    found = find_copies(keyed.select(F.col(rid).alias("doc_id"), "text"), benchmark, min_score).select(F.col("doc_id").alias(rid)).distinct()
    return keyed.join(found, rid, "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
