"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become codepoint-class arrays; token boundaries are found by running a small automaton as
an associative scan: every character is a transition function on eight states, functions are
numbered and composed through one table, first along the rows of a blocked array, then across
the blocks. The only lookahead (what follows white space, what follows an apostrophe) goes into
the class. The slices between boundaries are made distinct, encoded by rank-ordered pair merging
with a bounded cache, and put together with numpy. Token end offsets are kept, and decoding
copies each token's bytes to its offset.

Edge cases: a null or empty text has no ids and decodes to nothing. Very long slices merge with
a heap in n log n. Repeated rows are encoded each by itself; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from starling.llm.common import batch_of, binaries, long_parts, ragged, raw, steps

#: Slices that a worker remembers; a full cache is emptied.
CACHE_SLICES = 500_000
#: Texts of about so many bytes are handled in one numpy step, which takes about thirty times as much.
STEP = 1 << 20
#: Slices of more bytes are merged with a heap, one by one.
LONG = 32
NONE = 1 << 60

# Symbols of the automaton. S_LAST and SP_LAST: white space before something else, the latter a plain space.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE, S_LAST, SP_LAST, TEXT_START = range(9)
# States: a match must begin next; in letters; in numbers; in other marks; after a joined space; in white space; one or two characters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, JOINED, IN_S, LEFT1, LEFT2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a match begins at this character."""
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return FRESH, False
    if symbol == SPACE:
        return IN_S, state != IN_S
    if symbol == S_LAST:
        return FRESH, True
    if symbol == SP_LAST:
        return JOINED, True
    if symbol in (APOS1, APOS2):
        if state in (IN_O, JOINED):
            return IN_O, False
        return (LEFT1 if symbol == APOS1 else LEFT2), True
    into = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}[symbol]
    return into, state not in (JOINED, into)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's transition function, the composition table, and each function's state after FRESH."""
    functions = {symbol: tuple(_step(s, symbol)[0] for s in range(8)) for symbol in range(8)}
    functions[TEXT_START] = (FRESH,) * 8
    known = {tuple(range(8)): 0}
    for f in functions.values():
        known.setdefault(f, len(known))
    while True:
        new = {g for a in known for b in known if (g := tuple(b[s] for s in a)) not in known}
        if not new:
            break
        for g in sorted(new):
            known[g] = len(known)
    every = list(known)
    table = np.array([[known[tuple(b[s] for s in a)] for b in every] for a in every], np.uint16)
    return np.array([known[functions[s]] for s in range(9)], np.uint16), table, np.array([f[FRESH] for f in every], np.uint8)


_FUNCTION, _COMPOSE, _AFTER = _monoid()
_BEGINS = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)], bool)
_BLOCK = 512


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of transition functions under composition."""
    n, size, width = len(functions), len(_COMPOSE), _BLOCK
    flat = _COMPOSE.ravel()
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for k in range(1, width):
        grid[k] = flat[grid[k - 1].astype(np.intp) * size + grid[k]]
    if rows > 1:
        before = np.r_[np.uint16(0), scan(grid[-1])[:-1]] if rows > width else np.zeros(rows, np.uint16)
        if rows <= width:
            run = 0
            for r, f in enumerate(grid[-1].tolist()):
                before[r] = run
                run = int(_COMPOSE[run, f])
        grid = flat[before.astype(np.intp)[None, :] * size + grid]
    return grid.T.ravel()[:n]


def class_table() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, as the library's own Unicode tables have it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        # What the pattern doesn't match is left out of the ids, which stand for single bytes here.
        single = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(single.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = symbol
    return out


def starts(cp: np.ndarray, doc_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where matches begin in the code points of several texts; doc_starts: where (non-empty) texts do."""
    n = len(cp)
    symbol = classes[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    space = symbol == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]  # the end of a text doesn't count as something else
    symbol[last] = S_LAST
    symbol[last & (cp == 32)] = SP_LAST
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        ahead = np.append(cp, [0, 0, 0])
        c1, c2 = ahead[apos + 1], ahead[apos + 2]
        in1 = ~first[np.minimum(apos + 1, n)]
        in2 = in1 & ~first[np.minimum(apos + 2, n)]
        one = in1 & np.isin(c1, [ord(c) for c in "stmd"])
        two = in2 & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        symbol[apos[one]] = APOS1
        symbol[apos[two]] = APOS2
    functions = _FUNCTION[symbol]
    # A text's first character forgets what came before.
    functions[doc_starts] = _COMPOSE[_FUNCTION[TEXT_START], functions[doc_starts]]
    state = np.zeros(n, np.uint8)
    state[1:] = _AFTER[scan(functions)[:-1]]
    state[doc_starts] = FRESH
    return _BEGINS[state, symbol]


class Ranks:
    """The vocabulary of a rank file: token bytes in base64 and rank, one per line."""

    _KNOWN: dict[str, "Ranks"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes = class_table()
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Ranks":
        if path not in cls._KNOWN:
            cls._KNOWN[path] = cls(path)
        return cls._KNOWN[path]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent ids make, or NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (uint32) of slices: the leftmost adjacent pair of lowest rank is joined until none is left."""
        out: list[bytes] = [b""] * len(pieces)
        by_len: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            else:
                by_len.setdefault(len(piece), []).append(i)
        for size, rows in by_len.items():
            ids = self.single[np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8).reshape(len(rows), size)]
            done, lens = np.zeros((len(rows), size), np.uint32), np.zeros(len(rows), np.int64)
            ranks, at, live = self._joined(ids[:, :-1], ids[:, 1:]), np.arange(len(rows)), size
            while len(at):
                low = ranks.argmin(axis=1) if live > 1 else np.zeros(len(at), np.int64)
                best = ranks[np.arange(len(at)), low] if live > 1 else np.full(len(at), NONE)
                over = best == NONE
                if over.any():
                    done[at[over], :live], lens[at[over]] = ids[over], live
                    ids, ranks, at, low, best = ids[~over], ranks[~over], at[~over], low[~over], best[~over]
                    if not len(at):
                        break
                # Every row left loses one part: what stands right of the pair moves up.
                row, live = np.arange(len(at)), live - 1
                column = np.arange(live)[None, :]
                ids = np.take_along_axis(ids, column + (column > low[:, None]), axis=1)
                ids[row, low] = best
                if live > 1:
                    column = np.arange(live - 1)[None, :]
                    ranks = np.take_along_axis(ranks, column + (column >= low[:, None]), axis=1)
                    left, right = low > 0, low < live - 1
                    ranks[row[left], low[left] - 1] = self._joined(ids[row[left], low[left] - 1], ids[row[left], low[left]])
                    ranks[row[right], low[right]] = self._joined(ids[row[right], low[right]], ids[row[right], low[right] + 1])
                else:
                    ranks = np.full((len(at), 0), NONE)
            for i, line, n in zip(rows, done, lens.tolist(), strict=True):
                out[i] = line[:n].tobytes()
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each text."""
        data, offsets = raw(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)  # byte where each code point begins
        full = np.flatnonzero(np.diff(offsets))
        begin = starts(cp, np.searchsorted(char_at, offsets[full]), self.classes)
        cuts = np.append(char_at[begin], len(data))
        slices = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = slices.dictionary.to_pylist()
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        new = [piece for piece in distinct if piece not in self.cache]
        self.cache.update(zip(new, self.merge_many(new), strict=True))
        found = [self.cache[piece] for piece in distinct]
        lens = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        index = slices.indices.to_numpy()
        each = lens[index]
        ids = np.frombuffer(b"".join(found), np.uint32)[ragged((np.cumsum(lens) - lens)[index], each)]
        ends = np.r_[0, np.cumsum(each)][np.searchsorted(cuts, offsets)]
        for piece in new:
            if len(piece) > 64:
                del self.cache[piece]
        return ids, np.diff(ends)


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids and ends per document; both are little-endian uint32, ends being the byte where each token ends."""

    def run(batches):
        vocabulary = Ranks.of(ranks)
        for batch in steps(batches, STEP):
            found = [vocabulary.encode(texts) for texts in long_parts(batch)]
            ids, lens = np.concatenate([x for x, _ in found]), found[0][1] if len(found) == 1 else np.array([sum(n.sum() for _, n in found)])
            ends = np.cumsum(vocabulary.lens[ids])
            before = np.r_[0, ends][np.cumsum(lens) - lens]
            ends = (ends - np.repeat(before, lens)).astype(np.uint32)
            yield batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array(lens), ids=binaries(ids, lens).cast(pa.binary()), ends=binaries(ends, lens).cast(pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, ends binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded``, the bytes that each row's ids stand for, laid out by the retained ends."""

    def run(batches):
        vocabulary = Ranks.of(ranks)
        for batch in steps(batches, STEP, column="ids"):
            raw_ids, id_at = raw_binary(batch.column("ids"))
            raw_ends, _ = raw_binary(batch.column("ends"))
            ids, ends, per_row = raw_ids.view(np.uint32), raw_ends.view(np.uint32).astype(np.int64), np.diff(id_at) >> 2
            first = np.cumsum(per_row) - per_row
            sizes = np.diff(ends, prepend=0)
            full = first[per_row > 0]
            sizes[full] = ends[full]
            if not np.array_equal(sizes, vocabulary.lens[ids]):
                raise ValueError("ids and token ends don't belong together")
            total = np.r_[0, np.cumsum(sizes)]
            row_bytes = total[first + per_row] - total[first]
            data = vocabulary.bytes[ragged(vocabulary.at[ids], sizes)]
            yield batch_of(**dict(zip(batch.schema.names, batch.columns, strict=True)), decoded=binaries(data, row_bytes).cast(pa.binary()))

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{before}, decoded binary")


def raw_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]), offsets - offsets[0]
