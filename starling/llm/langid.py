"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled texts:
pieces that lie evenly over the whole of each text, and as evenly from all sampled texts. A
text is parsed against each automaton into longest matches; fewer phrases mean a lower cross
entropy, phrases * log2(sample length) / text length, and the language with the lowest wins.
The transitions of all automata share one sparse table by row displacement (the moves of a state
lie at its base plus their symbols, in slots that remember their owner), so that its size follows
the sample and not the alphabet. Many stretches of text are parsed in step with numpy: texts are
cut into stretches of STRETCH symbols, each of which begins a phrase of its own, and all
stretches of all texts are read to their ends.

What is broadcast is bounded by the sample's bounds, about 0.8 MB a language; training fails on
more than MOST_LANGS languages.

Edge cases: null, empty and letterless texts are ``und`` with score 0; so is every text if no
language was learned. Ties go to the language that sorts first. Symbols that the sample doesn't
have match nothing. Repeated rows are predicted equally; an empty table gives an empty result;
columns other than doc_id and text (and lang for fitting) are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starling.llm.common import batch_of, long_parts, ragged, raw, steps

#: Bounds of the sample: documents of each language, characters of each of them, characters of each automaton.
DOCS_PER_LANG, CHARS_PER_DOC, SYMBOLS_PER_LANG = 96, 600, 24_000
#: Of longer texts, the characters of a sample are pieces of so many.
PIECE = 60
STRETCH = 256
MOST_LANGS = 1000
UNKNOWN = "und"
STEP = 2 << 20
# Symbols that are no letters of the sample.
GAP, STRANGE, FIRST = 0, 1, 2


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is its start."""
    out, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(out)
        out.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(out)
                out.append(dict(out[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return out


def displaced(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row displacement of transitions: base of each state, and owner and target of each slot.

    State s moves by c to target[base[s] + c] if that slot's owner is s. State 0 has no moves.
    """
    size = 2 * width + 2 * sum(map(len, moves))
    used, base = bytearray(size), np.zeros(len(moves), np.int32)
    owner, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
    start: dict[int, int] = {}  # for each number of moves, a place below which search has become hopeless
    for s in sorted((s for s, m in enumerate(moves) if m), key=lambda s: (-len(moves[s]), s)):
        symbols = sorted(moves[s])
        first, others = symbols[0], [c - symbols[0] for c in symbols[1:]]
        at, tries = used.find(0, start.get(len(symbols), width)), 0
        while at < 0 or at + (others[-1] if others else 0) >= len(used) or any(used[at + c] for c in others):
            if at < 0 or at + width >= len(used):
                used += bytearray(size)
                owner, target = np.r_[owner, np.zeros(size, np.int32)], np.r_[target, np.zeros(size, np.int32)]
                continue
            at, tries = used.find(0, at + 1), tries + 1
        if tries > 32 or not others:
            start[len(symbols)] = at
        base[s] = at - first
        for c in symbols:
            used[at - first + c] = 1
            owner[at - first + c], target[at - first + c] = s, moves[s][c]
    end = len(used.rstrip(b"\0")) + width
    return base, np.resize(owner, end) if end > len(owner) else owner[:end], np.resize(target, end) if end > len(target) else target[:end]


class Model:
    """Automata of all languages in one table."""

    _KNOWN: dict[int, "Model"] = {}

    def __init__(self, samples: dict[str, list[str]]):
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.langs = sorted(samples)
        self.letters = {c: FIRST + i for i, c in enumerate(letters)}
        self.width = FIRST + len(letters)
        self._tables()
        self.starts, self.sizes, self.again = [], [], []
        moves: list[dict[int, int]] = [{}]
        for lang in self.langs:
            symbols = [self.symbols(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in samples[lang]]
            text = np.concatenate([np.append(s, GAP) for s in symbols])
            used = len(moves)
            moves += [{c: used + to for c, to in m.items()} for m in suffix_automaton(text.tolist())]
            again = np.full(self.width, used, np.int32)
            again[list(moves[used])] = list(moves[used].values())
            self.starts.append(used)
            self.sizes.append(len(text))
            self.again.append(again)
        self.base, self.owner, self.target = displaced(moves, self.width)
        self.bits = np.log2(np.maximum(self.sizes, 2))

    def _tables(self) -> None:
        """Symbol of every code point: a letter's own or STRANGE, and GAP for what is no letter."""
        self.symbol = np.full(0x110000, GAP, np.int32)
        every = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.symbol[every] = STRANGE
        for c, s in self.letters.items():
            self.symbol[ord(c)] = s
            if len(c.upper()) == 1:
                self.symbol[ord(c.upper())] = s

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        s = self.symbol[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[keep]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "symbol"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._tables()

    @classmethod
    def of(cls, data: bytes) -> "Model":
        if hash(data) not in cls._KNOWN:
            cls._KNOWN.clear()
            cls._KNOWN[hash(data)] = pickle.loads(data)
        return cls._KNOWN[hash(data)]

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases (text, language), and whether each text has a letter."""
        phrases, lens, lettered = self.phrases(data, offsets)
        return phrases * self.bits / np.maximum(lens, 1)[:, None], lettered

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """entropies() of the texts of a step; a very long one is parsed in parts, each of which begins a phrase."""
        found = [self.phrases(*raw(texts)) for texts in long_parts(batch)]
        phrases, lens, lettered = (sum(x[1:], start=x[0]) for x in zip(*found, strict=True))
        return phrases * self.bits / np.maximum(lens, 1)[:, None], lettered > 0

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (text, language), symbols of each text, and whether it has a letter."""
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]  # code points before each text
        s = self.symbol[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        keep[at[:-1][np.diff(at) > 0]] = True
        letter = np.r_[0, np.cumsum(s != GAP)]
        lettered = letter[at[1:]] > letter[at[:-1]]
        at = np.r_[0, np.cumsum(keep)][at]
        s = s[keep]
        lens = np.diff(at)
        count = np.maximum(-(-lens // STRETCH), 1)
        first = np.cumsum(count) - count
        n = int(count.sum())
        grid = np.zeros(n * STRETCH, np.int32)
        grid[ragged(first * STRETCH, lens)] = s
        # The longest stretches come first, so that those which go on at a column are a prefix.
        size_of = np.full(n, STRETCH)
        size_of[first + count - 1] = lens - (count - 1) * STRETCH
        order = np.argsort(-size_of, kind="stable")
        grid = np.ascontiguousarray(grid.reshape(-1, STRETCH)[order].T)
        live = n - np.searchsorted(np.sort(size_of), np.arange(STRETCH), side="right")
        out = np.zeros((len(lens), len(self.langs)))
        for k, (start, again) in enumerate(zip(self.starts, self.again, strict=True)):
            state, phrases = np.full(n, start, np.int32), np.ones(n, np.int32)
            for column, m in zip(grid, live.tolist(), strict=True):
                column, now = column[:m], state[:m]
                slot = self.base[now] + column
                missed = self.owner[slot] != now
                state[:m] = np.where(missed, again[column], self.target[slot])
                phrases[:m] += missed
            back = np.empty_like(phrases)
            back[order] = phrases
            out[:, k] = np.add.reduceat(back, first)
        return out, lens, lettered


def pieces(text: Column) -> Column:
    """The text if it has up to CHARS_PER_DOC characters, else as many in pieces, the first at its start and the last at its end."""
    n, most = F.length(text).cast("long"), CHARS_PER_DOC // PIECE
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.substring(text, (F.floor(i * (n - PIECE) / (most - 1)) + 1).cast("int"), F.lit(PIECE)))
    return F.when(n > CHARS_PER_DOC, spread).otherwise(F.array(text))


def shared(texts: list[list[str]], most: int = SYMBOLS_PER_LANG) -> list[str]:
    """Pieces of all texts with about ``most`` characters together: short texts are whole, longer ones give equally much."""
    level, left, rest = most, most, len(texts)
    for n in sorted(sum(map(len, text)) for text in texts):
        level = left // rest
        if n > level:
            break
        left, rest = left - n, rest - 1
    out = []
    for text in texts:
        if sum(map(len, text)) > level:
            text = [t[at : at + PIECE] for t in text for at in range(0, len(t), PIECE)]
            k = max(1, level // PIECE)
            text = [text[i] for i in np.linspace(0, len(text) - 1, k).round().astype(int)] if k > 1 else [text[len(text) // 2]]
        out += text
    return out


def train(docs: DataFrame, usable: Column, docs_per_lang: int = DOCS_PER_LANG) -> bytes:
    """Learns from at most ``docs_per_lang`` documents of each language among rows where ``usable`` holds.

    More than MOST_LANGS languages are an error, before anything is collected: a table of that many
    automata doesn't fit in a task. Tables with more are for labels that are first mapped to fewer.
    """
    langs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable).select("lang").distinct()
    if langs.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable).select("lang", "doc_id", pieces(F.col("text")).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    samples: dict[str, list[list[str]]] = {}
    for row in rows.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).orderBy("lang", "rank").collect():
        known = samples.setdefault(row["lang"], [])
        if row["text"] not in known and any(map(str.isalpha, "".join(row["text"]))):
            known.append(row["text"])
    return pickle.dumps(Model({lang: shared(texts) for lang, texts in samples.items() if texts}))


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred and score: the winner's share of the languages' inverse entropies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = Model.of(shared.value)
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in steps(batches, STEP):
            entropy, lettered = m.step(batch)
            if not m.langs:
                entropy, lettered = np.ones((len(entropy), 1)), np.zeros(len(entropy), bool)
            best = entropy.argmin(axis=1)
            inverse = 1 / np.maximum(entropy, 1e-9)
            share = inverse[np.arange(len(best)), best] / inverse.sum(axis=1)
            yield batch_of(doc_id=batch.column("doc_id"), lang_pred=pa.array(names[np.where(lettered, best, len(names) - 1)], pa.string()), score=pa.array(np.where(lettered, share, 0.0)))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
