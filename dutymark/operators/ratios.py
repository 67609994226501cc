"""Token-set ratios of texts against names, all pairs in blocks, without loss.

The ratio of two texts is the greatest of three: common words against the common words with the rest of either text, and
both such texts against each other, each as 200 * (letters in order of both) / (letters of both). Terms and names
meet in blocks of bounded size, whatever words they hold, so that no common word gathers pairs. In a block an index of
words gives the common ones of each pair. From their lengths follow the first two ratios and an upper bound of the
third; pairs whose bound cannot enter the first k are done. The others are bounded by the letters they share, and what
is left is compared letter by letter, many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutymark.operators.blocks import meet, tiles

#: Terms and names of a matrix; names of a cell at most, least number worth a cell of its own, terms of a block; pairs at once.
TILE_TERMS, TILE_NAMES, CELL_NAMES, LEAST_NAMES, BLOCK, PAIRS = 256, 4_096, 32_768, 1_024, 4_096, 65_536


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: of the sorted common words, and these with the other words of each text, the greatest ratio of two, by insertions and deletions."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 100.0
    n, m = (len(both) + len(s) + bool(both) for s in (one, two))
    ratios = [200.0 * (len(both) + bool(both) + common_subsequence(one, two)) / (n + m)]
    if both:
        ratios += [200.0 * len(both) / (len(both) + k) for k in (n, m)]
    return max(ratios)


def common_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """common_subsequence(left[i], right[j]) of many pairs at once; texts over 64 letters on both sides one by one."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    size_l, size_r = (np.fromiter(map(len, s), np.int64, len(s)) for s in (left, right))
    # the side with bits is the shorter one of each pair
    turned = size_l[i] > size_r[j]
    short = np.minimum(size_l[i], size_r[j]) <= 64
    for at in np.flatnonzero(~short).tolist():
        out[at] = common_subsequence(left[i[at]], right[j[at]])
    for pick, bits, read, bit_at, read_at in ((short & ~turned, left, right, i, j), (short & turned, right, left, j, i)):
        pairs = np.flatnonzero(pick)
        if not len(pairs):
            continue
        used_bits, bit_of = np.unique(bit_at[pairs], return_inverse=True)
        used_read, read_of = np.unique(read_at[pairs], return_inverse=True)
        letters = {c: n for n, c in enumerate(sorted(set("".join(bits[u] for u in used_bits))), 1)}
        mask = np.zeros((len(used_bits), len(letters) + 1), np.uint64)
        for r, u in enumerate(used_bits.tolist()):
            for n, c in enumerate(bits[u]):
                mask[r, letters[c]] |= np.uint64(1) << np.uint64(n)
        size = np.array([len(read[u]) for u in used_read])
        text = np.zeros((len(used_read), int(size.max(initial=0))), np.int64)  # letter 0 changes nothing
        for r, u in enumerate(used_read.tolist()):
            text[r, : size[r]] = [letters.get(c, 0) for c in read[u]]
        length = np.array([len(bits[u]) for u in used_bits])
        full = np.where(length == 64, ~np.uint64(0), (np.uint64(1) << (length.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
        order = np.argsort(-size[read_of], kind="stable")  # long texts first: those that are read to the end drop out behind
        pairs, bit_of, read_of = pairs[order], bit_of[order], read_of[order]
        for low in range(0, len(pairs), PAIRS):
            b, r = bit_of[low : low + PAIRS], read_of[low : low + PAIRS]
            row, flat = full[b], mask.ravel()
            reach = np.searchsorted(-size[r], -np.arange(text.shape[1]), "left")
            for t in range(text.shape[1]):
                n = reach[t]
                if not n:
                    break
                hit = row[:n] & flat.take(b[:n] * mask.shape[1] + text[r[:n], t])
                row[:n] = (row[:n] + hit) | (row[:n] - hit)
            out[pairs[low : low + PAIRS]] = length[b] - np.bitwise_count(row & full[b])
    return out


class Texts:
    """Distinct sorted words of texts, their joined form, and its letters counted."""

    def __init__(self, texts: list[str]) -> None:
        self.words = [sorted(set(t.split())) for t in texts]
        self.joined = [" ".join(w) for w in self.words]
        self.length = np.fromiter(map(len, self.joined), np.int64, len(texts))
        self.count = np.fromiter(map(len, self.words), np.int64, len(texts))

    def letters(self, alphabet: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(self.joined), len(alphabet)), np.int32)
        for i, t in enumerate(self.joined):
            for c in t:
                if c in alphabet:
                    out[i, alphabet[c]] += 1
        return out


def ratio_parts(left: Texts, right: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By pair: number of common words, length of the common words joined, the ratio known from lengths alone, an upper bound of the ratio."""
    index: dict[str, list[int]] = {}
    for j, words in enumerate(right.words):
        for w in words:
            index.setdefault(w, []).append(j)
    shape = (len(left.words), len(right.words))
    number, length = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    for i, words in enumerate(left.words):
        for w in words:
            if w in index:
                at = np.array(index[w])
                number[i, at] += 1
                length[i, at] += len(w) + 1
    both = np.maximum(length - 1, 0)
    n, m = left.length[:, None], right.length[None, :]
    some = number > 0
    inside = some & ((number == left.count[:, None]) | (number == right.count[None, :]))
    known = np.where(inside, 100.0, np.where(some, 200.0 * both / np.maximum(both + np.minimum(n, m), 1), 0.0))
    bound = 200.0 * np.minimum(n, m) / np.maximum(n + m, 1)
    upper = np.where(inside, 100.0, np.maximum(known, bound))
    upper[(left.count == 0)[:, None] | (right.count == 0)] = 0.0
    return number, both, known, upper


def compared(left: Texts, right: Texts, number: np.ndarray, both: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The third ratio of pairs (i, j): both texts, common words first."""
    lonely = number[i, j] == 0
    out = np.zeros(len(i), np.int64)
    out[lonely] = common_lengths(left.joined, right.joined, i[lonely], j[lonely])
    rest = np.flatnonzero(~lonely)
    if len(rest):
        ones, twos, known = {}, {}, {}
        at = np.empty((2, len(rest)), np.int64)
        for p, (a, b) in enumerate(zip(i[rest].tolist(), j[rest].tolist(), strict=True)):
            if (a, b) not in known:
                x, y = left.words[a], right.words[b]
                shared = set(x).intersection(y)
                known[a, b] = (ones.setdefault(" ".join(w for w in x if w not in shared), len(ones)), twos.setdefault(" ".join(w for w in y if w not in shared), len(twos)))
            at[:, p] = known[a, b]
        out[rest] = both[i[rest], j[rest]] + 1 + common_lengths(list(ones), list(twos), at[0], at[1])
    return 200.0 * out / np.maximum(left.length[i] + right.length[j], 1)


def first_ratios(terms: list[str], names: list[str], ids: np.ndarray, k: int, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, name, ratio) with each term's first k names of ratio `cutoff` or more, by falling ratio and rising id. Ratios have 4 decimals."""
    left, right = Texts(terms), Texts(names)
    number, both, known, upper = ratio_parts(left, right)
    # as bounds are met by rounded ratios, they get some room
    upper = upper + 1e-4
    kth = np.partition(-known, k - 1, axis=1)[:, k - 1] if known.shape[1] >= k else np.zeros(len(terms))
    floor = np.maximum(-kth, cutoff) - 1e-4
    open_ = (upper >= floor[:, None]) & (known < 100.0)
    i, j = np.nonzero(open_)
    if len(i):
        alphabet = {c: n for n, c in enumerate(sorted(set("".join(left.joined))))}
        x, y = left.letters(alphabet), right.letters(alphabet)
        fits = np.empty(len(i), bool)
        for low in range(0, len(i), PAIRS):
            a, b = i[low : low + PAIRS], j[low : low + PAIRS]
            shared = np.minimum(x[a], y[b]).sum(1)
            fits[low : low + PAIRS] = np.maximum(known[a, b], 200.0 * shared / np.maximum(left.length[a] + right.length[b], 1)) + 1e-4 >= floor[a]
        i, j = i[fits], j[fits]
        known[i, j] = np.maximum(known[i, j], compared(left, right, number, both, i, j))
    ratio = np.round(known, 4)
    i, j = np.nonzero(ratio >= np.maximum(cutoff, 1e-4))
    order = np.lexsort((ids[j], -ratio[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[first], j[first], ratio[i[first], j[first]]


def meet_in_blocks(terms: DataFrame, names: DataFrame, find, schema: str) -> DataFrame:
    return meet(terms, "term", max(1, -(-terms.count() // BLOCK)), names, "name", CELL_NAMES, LEAST_NAMES, find, schema)


def nearest_names(terms: DataFrame, names: DataFrame, k: int, cutoff: float) -> DataFrame:
    """(term, name_id, ratio): of each distinct term each cell's first k names; terms (term), names (name, name_id), distinct."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            asked, own, ids = left.column("term").to_pylist(), right.column("name").to_pylist(), right.column("name_id").to_numpy()
            for s in tiles(len(own), TILE_NAMES):
                for t in tiles(len(asked), TILE_TERMS):
                    i, j, ratio = first_ratios(asked[t], own[s], ids[s], k, cutoff)
                    out[0].extend(asked[t.start + a] for a in i.tolist())
                    out[1].append(ids[s][j])
                    out[2].append(ratio)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"term": pa.array(out[0], pa.string()), "name_id": pa.array(flat(out[1], np.int64), pa.int64()), "ratio": pa.array(flat(out[2], float), pa.float64())})

    return meet_in_blocks(terms, names, find, "term string, name_id long, ratio double")


def brand_scores(asked: list[list[str]], texts: list[str], names: list[str], ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(text, name, score): the best name of each text that opens with its first token, by score and id.

    0.6 of the share of the other tokens that the name holds, plus 0.4 of the token-set ratio. Names with the greatest shares are compared first;
    once no share with a full ratio can reach the best score, the rest is done.
    """
    order = sorted(range(len(names)), key=names.__getitem__)
    own, ids = [names[o] for o in order], ids[order]
    holds: dict[str, np.ndarray] = {}
    rights = Texts(own)
    for i, tokens in enumerate(asked):
        low, high = np.searchsorted(own, tokens[0], "left"), np.searchsorted(own, tokens[0] + chr(0x10FFFF), "right")
        if low == high:
            continue
        share = np.zeros(high - low)
        for w in tokens[1:]:
            if w not in holds:
                holds[w] = np.fromiter((w in n for n in own), bool, len(own))
            share += holds[w][low:high]
        share /= max(1, len(tokens) - 1)
        best, left = None, Texts([texts[i]])
        for level in np.unique(share)[::-1]:
            if best is not None and round(0.6 * level + 0.4, 6) < best[0]:
                break
            at = np.flatnonzero(share == level) + low
            part = Texts.__new__(Texts)
            part.words, part.joined, part.length, part.count = [rights.words[a] for a in at], [rights.joined[a] for a in at], rights.length[at], rights.count[at]
            number, both, known, _ = ratio_parts(left, part)
            todo = np.flatnonzero(known[0] < 100.0)
            known[0, todo] = np.maximum(known[0, todo], compared(left, part, number, both, np.zeros(len(todo), int), todo))
            score = np.round(0.6 * level + 0.4 * np.round(known[0], 4) / 100, 6)
            top = np.lexsort((ids[at], -score))[0]
            if best is None or (score[top], -ids[at[top]]) > (best[0], -best[1]):
                best = (float(score[top]), int(ids[at[top]]))
        yield i, best[1], best[0]


def brand_names(texts: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(term, name_id, score): each cell's best name of each text of two tokens or more, from `floor` on. texts (term, tokens), names (name, name_id), distinct."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            asked, tokens = left.column("term").to_pylist(), left.column("tokens").to_pylist()
            out = [(asked[i], n, s) for i, n, s in brand_scores(tokens, asked, right.column("name").to_pylist(), right.column("name_id").to_numpy()) if s >= floor]
        return pa.table({"term": pa.array([r[0] for r in out], pa.string()), "name_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return meet_in_blocks(texts.filter(F.size("tokens") >= 2), names, find, "term string, name_id long, score double")
