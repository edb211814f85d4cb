"""Periodic runs of words in each text, by Lyndon roots that suffix trees extend.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(LEAST, POWER * q) that no neighbouring word extends keeping period q.

1. Within a run each GRAM words occur again q words further or before, and q is a quarter of the
   run at most. Stretches of words in which each gram has an equal one near enough are kept (equal
   hashes count as equal: that only keeps more); no run lies elsewhere or leaves its stretch.
2. The stretches of a text, apart from each other by marks that occur once, get a suffix tree by
   Ukkonen's algorithm, and so does their reversal. Euler tours of both turn the lowest common
   ancestor of two leaves into a range minimum over string depths, which block minima and a sparse
   table answer in constant time: how far two suffixes, or two prefixes backwards, agree.
3. The longest Lyndon word that starts at a place ends before the next smaller suffix; the tour's
   leaves are the sorted suffixes. With the words in one order or in the opposite one, each run has
   such a word of its period's length as its root. Roots are extended to both sides, and what is
   long enough is a run. Lyndon words are primitive, so that the root's length is the least period.
4. A word is dropped if a run holds it after that run's first period.

Edge cases: null, empty and wordless texts have no words, no runs and an empty collapsed text.
Repeated rows give equal rows, ties don't arise (runs are sorted by start, then period). An empty
table gives an empty result; columns other than doc_id and text are ignored. Memory grows with the
longest text and, by about 1 KB a word, with the longest text's stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import mix, ragged, raw, steps

LEAST, POWER = 6, 4
#: Of a run's words, so many in a row occur again within it at the distance of its period: LEAST - GRAM + 1 >= 2, and POWER * q - GRAM + 1 >= 2 * q from 2 on.
GRAM = 5
STEP = 1 << 20
#: Rounds in which stretches are narrowed.
ROUNDS = 4


class SuffixTree:
    """The suffix tree of ``symbols`` (ints from 1 on) and a last symbol 0, by Ukkonen's algorithm, with an Euler tour."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        base = max(text) + 1
        n = len(text)
        start, stop, link, child = [0], [0], [0], {}
        node, edge, length, left = 0, 0, 0, 0
        for i, c in enumerate(text):
            left += 1
            last = 0  # the inner node of this step that has no suffix link yet
            while left:
                if not length:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    at = start[below]
                    long = (stop[below] if stop[below] <= i else i + 1) - at
                    if length >= long:
                        edge += long
                        length -= long
                        node = below
                        continue
                    if text[at + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start.append(at)
                    start.append(i)
                    stop.append(at + length)
                    stop.append(n)
                    link.append(0)
                    link.append(0)
                    child[middle * base + c] = middle + 1
                    start[below] = at + length
                    child[middle * base + text[at + length]] = below
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._tour(n, base, np.array(start, np.int64), np.array(stop, np.int64), child)

    def _tour(self, n: int, base: int, start: np.ndarray, stop: np.ndarray, child: dict[int, int]) -> None:
        keys, kids = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # by parent, then first symbol
        kids, longs = kids[order].tolist(), (stop - start).tolist()
        following = np.searchsorted(keys[order] // base, np.arange(len(start) + 1)).tolist()
        last = following[1:]
        depth, up, tour, v = [0] * len(longs), [-1] * len(longs), [0], 0
        visit = tour.append
        while v >= 0:
            k, own, end = following[v], depth[v], last[v]
            while k < end:
                w = kids[k]
                k += 1
                depth[w] = own + longs[w]
                visit(w)
                if following[w] < last[w]:  # not a leaf
                    up[w] = v
                    following[v] = k
                    v = w
                    break
                visit(v)
            else:
                v = up[v]
                visit(v)
        tour.pop()
        tour, depth = np.array(tour), np.array(depth)
        leaves = np.flatnonzero(np.r_[0, stop[1:] == n])
        leaf = np.full(len(depth), -1)
        leaf[leaves] = n - depth[leaves]  # the suffix that ends in the leaf
        spot = np.flatnonzero(leaf[tour] >= 0)
        #: Sorted suffixes, and where each suffix stands in the tour.
        self.sorted = leaf[tour[spot]]
        self.at = np.zeros(n, np.int64)
        self.at[self.sorted] = spot
        self.minimum = RangeMinimum(depth[tour])

    def ranks(self) -> np.ndarray:
        out = np.empty(len(self.sorted), np.int64)
        out[self.sorted] = np.arange(len(self.sorted))
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of different suffixes i and j."""
        a, b = self.at[i], self.at[j]
        return self.minimum.of(np.minimum(a, b), np.maximum(a, b))


class RangeMinimum:
    """Minima of ranges in constant time: a sparse table over the minima of blocks, running minima within them."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        size = self.BLOCK
        self.values = np.r_[values, np.full(-len(values) % size, values.max(initial=0))].astype(np.int32)
        blocks = self.values.reshape(-1, size)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << len(self.table) - 1 <= len(blocks):
            half, row = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(row[: len(row) - half], row[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of values[lo : hi + 1]."""
        a, b = lo // self.BLOCK, hi // self.BLOCK
        out = np.minimum(self.back[lo], self.ahead[hi])
        same = np.flatnonzero(a == b)
        for k in range(0, len(same), 1 << 14):
            here = same[k : k + (1 << 14)]
            out[here] = self.values[np.minimum(lo[here, None] + np.arange(self.BLOCK), hi[here, None])].min(axis=1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            x, n = a[far] + 1, b[far] - a[far] - 1
            level = np.log2(n).astype(np.int64)
            for k in np.unique(level):
                here = level == k
                row, y = self.table[k], x[here]
                out[far[here]] = np.minimum(out[far[here]], np.minimum(row[y], row[y + n[here] - (1 << k)]))
        return out


def next_smaller(ranks: list[int]) -> np.ndarray:
    """Of each place, the next one with a smaller rank; the length if there is none."""
    out, stack = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """(run, 3): start, length, period of every run, by start, then period. ``symbols`` are ints from 1 on."""
    n = len(symbols)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    ahead = SuffixTree(symbols.tolist())
    ranks = ahead.ranks()[:n]
    starts, periods = [], []
    for order in (ranks, -ranks):
        end = next_smaller(order.tolist())
        period = end - np.arange(n)
        root = np.flatnonzero((end < n) & (POWER * period <= n))
        starts.append(root)
        periods.append(period[root])
    start, period = np.concatenate(starts), np.concatenate(periods)
    right = ahead.common(start, start + period)
    on = right >= period  # a run's first root begins within its first period, and two more follow it
    start, period, right = start[on], period[on], right[on]
    del ahead
    if not len(start):
        return np.zeros((0, 3), np.int64)
    back = SuffixTree(symbols[::-1].tolist())
    left = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start)
    left[inner] = back.common(n - start[inner], n - start[inner] - period[inner])
    length = left + period + right
    found = np.stack([start - left, length, period], axis=1)[length >= np.maximum(LEAST, POWER * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(words: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that may hold runs. words: numbers of all words; text: the text of each; sizes: words of each text."""
    grams = len(words) - GRAM + 1
    none = np.zeros(0, np.int64)
    if grams < 2:
        return none, none
    with np.errstate(over="ignore"):
        value = mix(text[:grams].astype(np.uint64) + np.uint64(1 << 40))
        for k in range(GRAM):
            value += mix(words[k : k + grams].astype(np.uint64) + np.uint64(k + 1 << 44))
        value = mix(value)
    at = np.flatnonzero(text[:grams] == text[GRAM - 1 :])
    order = at[np.argsort(value[at], kind="stable")]
    gap = np.where(value[order[1:]] == value[order[:-1]], order[1:] - order[:-1], len(words))
    nearest = np.full(grams, len(words))
    np.minimum.at(nearest, order[1:], gap)
    np.minimum.at(nearest, order[:-1], gap)
    most = sizes[text[:grams]]  # words of a run that holds the gram, at most
    for _ in range(ROUNDS):
        alive = np.flatnonzero((POWER * nearest <= most) & (most >= LEAST))
        if not len(alive):
            return none, none
        first = np.r_[True, (alive[1:] != alive[:-1] + 1) | (text[alive[1:]] != text[alive[:-1]])]
        lo, hi = alive[first], alive[np.r_[np.flatnonzero(first)[1:] - 1, len(alive) - 1]]
        now = np.zeros(grams, np.int64)
        now[alive] = np.repeat(hi - lo + GRAM, hi - lo + 1)
        if (now == most)[alive].all():
            break
        most = now
    long = hi - lo + GRAM >= LEAST
    return lo[long], hi[long] + GRAM


def _runs_in(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Runs within the stretches [lo, hi) of one text, by start, then period; places are numbers of words."""
    lens = hi - lo
    place = ragged(lo, lens + 1)
    ends = np.cumsum(lens + 1) - 1
    own = words[np.minimum(place, len(words) - 1)]
    _, symbols = np.unique(own, return_inverse=True)
    symbols = symbols + 1
    symbols[ends] = symbols.max() + 1 + np.arange(len(ends))  # marks between stretches
    found = runs_of(symbols[:-1])
    found[:, 0] = place[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _joined(data: np.ndarray, at: np.ndarray, index: np.ndarray, per_text: np.ndarray) -> pa.Array:
    """Texts of per_text[i] words each, joined by single spaces; word k has the bytes data[at[k] : at[k + 1]]."""
    lens = np.diff(at)[index]
    gap = np.ones(len(index), np.int64)
    gap[np.cumsum(per_text)[per_text > 0] - 1] = 0  # no space after a text's last word
    stops = np.cumsum(lens + gap)
    out = np.full(stops[-1] if len(stops) else 0, 32, np.uint8)
    out[ragged(stops - gap - lens, lens)] = data[ragged(at[:-1][index], lens)]
    offsets = np.r_[0, stops][np.r_[0, np.cumsum(per_text)]]
    return pa.Array.from_buffers(pa.large_string(), len(per_text), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(out)])


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = pc.ascii_split_whitespace(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    flat = parts.flatten().dictionary_encode()
    index = flat.indices.to_numpy()
    data, at = raw(flat.dictionary)
    real = np.diff(at)[index] > 0  # white space at an end leaves an empty word
    ends = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]]
    index, sizes = index[real], np.diff(ends)
    lo, hi = stretches(index, np.repeat(np.arange(len(sizes)), sizes), sizes)
    text = np.searchsorted(ends, lo, side="right") - 1
    cuts = np.r_[0, np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)] if len(text) else np.zeros(1, np.int64)
    many, found, kept = np.zeros(len(sizes), np.int64), [], np.ones(len(index), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = int(text[a])
        first = int(ends[i])
        own = _runs_in(index[first : ends[i + 1]], lo[a:b] - first, hi[a:b] - first)
        many[i] = len(own)
        found.append(own)
        for start, length, period in own.tolist():
            kept[first + start + period : first + start + length] = False
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    structs = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), structs)
    left = np.add.reduceat(np.r_[kept, False].astype(np.int64), ends[:-1]) * (sizes > 0) if len(sizes) else sizes
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, _joined(data, at, index[kept], left)], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period) and collapsed (words outside of repetitions, joined by one space)."""

    def run(batches):
        for batch in steps(batches, STEP):
            yield _batch(batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """Of runs by start, then period, the first with the greatest exact length / period; null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(best["length"] * r["period"] >= r["length"] * best["period"], best).otherwise(r))
