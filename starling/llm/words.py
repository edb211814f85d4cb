"""Encoding with a ``tokenizers`` file that lower-cases and drops white space, word by word.

The file's rules never merge across white space, so the ids of a text are the ids of its
white-space separated chunks. Each distinct chunk is encoded once by the library and kept in a
bounded cache of the Python worker; whole batches are then assembled with numpy. The strings of
the file's special tokens become those tokens wherever a text has them, as the library does it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starling.llm.common import long_parts, ragged, raw

#: Chunks that a worker remembers; a full cache is emptied.
CACHE_WORDS = 300_000
#: Words of plain letters that the library encodes in one call's text.
JOINED = 256
# ASCII marks between a letter or digit and white space are a match of their own: cutting before them changes nothing.
_TRAIL = r"([a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~]+)(\s|$)"
_PLAIN = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_ENCODERS: dict[str, "WordEncoder"] = {}


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A to Z become a to z; all other bytes stay."""
    data, offsets = raw(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])


def distinct_words(dictionary: pa.Array) -> list[str]:
    """The strings of an array, none of which may hold a line feed; several times faster than to_pylist()."""
    data, offsets = raw(dictionary)
    out = np.full(len(data) + len(dictionary), ord("\n"), np.uint8)
    lens = np.diff(offsets)
    out[ragged(offsets[:-1] + np.arange(len(lens)), lens)] = data
    return out.tobytes().decode().split("\n")[:-1]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # chunks are ordinary text: special ones are marked
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # In upper case no other chunk of a lower-cased text can equal them.
        self.marked = {w.upper(): np.array([i], np.uint32).tobytes() for w, i in special.items()}
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = dict(self.marked)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Lower-cased texts in which special tokens stand alone and in upper case."""
        has = np.zeros(len(texts), bool)
        for w in self.marked:
            has |= pc.match_substring(texts, w.lower()).fill_null(False).to_numpy(zero_copy_only=False)
        lower = ascii_lower(texts)
        if not has.any():
            return lower
        at = np.flatnonzero(has)
        found = []
        for t in texts.take(pa.array(at)).to_pylist():
            parts = self.special.split(t)
            parts[::2] = [x.translate(_LOWER) for x in parts[::2]]
            parts[1::2] = [f" {x.upper()} " for x in parts[1::2]]
            found.append("".join(parts))
        return pc.replace_with_mask(lower, pa.array(has), pa.array(found, lower.type))

    def _learn(self, words: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(words, pa.large_string()), _PLAIN).to_pylist()
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for group, enc in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # not one match per word after all
                others += group
                continue
            data, at = ids.tobytes(), 0
            for w, cut in zip(group, (cuts * 4).tolist(), strict=True):
                self.cache[w] = data[at:cut]
                at = cut
        for w, enc in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(enc.ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each text."""
        texts = pc.replace_substring_regex(self._lowered(texts), _TRAIL, r"\1 \2\3")
        chunks = pc.ascii_split_whitespace(texts)
        words = chunks.flatten().dictionary_encode()
        distinct = distinct_words(words.dictionary)
        if len(self.cache) > CACHE_WORDS:
            self.cache = dict(self.marked)
        if new := [w for w in distinct if w not in self.cache]:
            self._learn(new)
        found = [self.cache[w] for w in distinct]
        lens = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), np.uint32)
        index = words.indices.to_numpy()
        each = lens[index]
        ids = flat[ragged((np.cumsum(lens) - lens)[index], each)]
        per_text = chunks.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(each)][np.cumsum(per_text)]
        return ids, np.diff(np.r_[0, ends])

    def encode_step(self, batch: pa.RecordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_closed() for the texts of a step, a very long one in parts."""
        parts = list(long_parts(batch))
        if len(parts) == 1:
            return self.encode_closed(parts[0], end_id)
        ids = np.concatenate([self.encode(p)[0] for p in parts] + [np.array([end_id], np.uint32)])
        return ids, np.array([len(ids)], np.int64)

    def encode_closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with ``end_id`` after each text."""
        ids, lens = self.encode(texts)
        out = np.full(len(ids) + len(lens), end_id, np.uint32)
        out[ragged(np.cumsum(lens + 1) - lens - 1, lens)] = ids
        return out, lens + 1
