"""Suffix arrays and the removal of repeated strings, against brute force."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
import pytest
from hypothesis import given, settings, strategies as st

from starling.llm import suffix_dedup as sd
from starling.llm.suffix_array import suffix_array


@settings(deadline=None, max_examples=300)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)))
def test_suffix_array(text):
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts):
    """Bytes left and number of removed runs of each text."""
    data, seen = [(t or "").encode() for t in texts], defaultdict(int)
    for d in data:
        for i in range(len(d) - sd.WINDOW + 1):
            seen[d[i : i + sd.WINDOW]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - sd.WINDOW + 1):
            if seen[d[i : i + sd.WINDOW]] > 1:
                gone[i : i + sd.WINDOW] = b"\1" * sd.WINDOW
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(d, gone, strict=True) if not g), runs))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(n))

    shared = [prose(60) for _ in range(3)]
    texts = [prose(rng.randint(0, 120)) for _ in range(12)]
    texts += [prose(20) + rng.choice(shared) + prose(20) for _ in range(15)]
    near = prose(150)
    for _ in range(8):
        i = rng.randrange(len(near))
        texts.append(near[:i] + rng.choice("xyz") + near[i + rng.randint(0, 2) :])
    texts += [texts[0], texts[-1], "", None, "short", "a" * 500, "ab" * 300, "é" * 260, "x" * 450 + "y", "z" * 199 + "x" * 300, prose(40) * 2, shared[0][:200], shared[0][:201], shared[1][5:230]]
    return texts


@pytest.mark.parametrize(("seed", "most", "long"), [(1, 8192, 4 << 20), (2, 8192, 300), (3, 3, 4 << 20)])
def test_removal(spark, seed, most, long, monkeypatch):
    """Against brute force; with anchors split into windows; with texts read in short ranges."""
    monkeypatch.setattr(sd, "MOST_SLICES", most)
    monkeypatch.setattr(sd, "RANGE", long)
    monkeypatch.setattr(sd, "STEP", min(long, sd.STEP))
    texts = corpus(seed)
    rows = [(i, t, i, "a", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, spans string, row int").repartition(5)
    for row, text, (left, runs) in zip(sd.suffix_dedup(df).orderBy("doc_id").collect(), texts, brute(texts), strict=True):
        assert (bytes(row.kept), row.n_spans) == (left, runs), row.doc_id
        assert row.n_bytes == len((text or "").encode()) and row.n_removed == row.n_bytes - len(left)
    if seed == 1:
        left = sd.remaining_text(df).orderBy("doc_id").collect()
        assert [(r.text, r.rid, r.spans, r.row) for r in left] == [(None if t is None else b.decode(errors="ignore"), i, "a", 1) for i, (t, (b, _)) in enumerate(zip(texts, brute(texts), strict=True))]


@pytest.mark.parametrize("seed", range(6))
def test_arrays_decide_on_windows(seed):
    """One task's slices, some with copies, against counting."""
    rng = random.Random(seed)
    alphabet = ["ab", "e t", "zk,q", "\u4e2d\u6587\u3042"][seed % 4]
    base = "".join(rng.choice(alphabet) for _ in range(420))
    held = []
    for _ in range(30):
        i, t = rng.randrange(len(base) - 260), list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "X"
        held.append("".join(t).encode()[i : i + rng.randint(200, 330)])
    held = [h for h in dict.fromkeys(held) if len(h) >= sd.WINDOW]
    copies = [rng.choice([1, 1, 1, 2]) for _ in held]
    times = defaultdict(int)
    for h, c in zip(held, copies, strict=True):
        for i in range(len(h) - 199):
            times[h[i : i + 200]] += c
    lens, n = np.array([len(h) for h in held]), np.array([len(h) - 199 for h in held])
    got = sd.repeated_starts(np.frombuffer(b"\0".join(held) + b"\0", np.uint8), np.cumsum(lens + 1) - lens - 1, n, np.array(copies))
    assert got.tolist() == [times[h[i : i + 200]] > 1 for h in held for i in range(len(h) - 199)]


def test_equal_hashes_of_slices_only_cost_work(monkeypatch):
    """Cores whose hashes all collide leave every slice to the array."""
    monkeypatch.setattr(sd.Prefixes, "hashes", lambda self, starts, lens: np.zeros(len(starts), np.uint64))
    assert sd.comparable(np.zeros(900, np.uint8), np.array([0, 400]), np.array([20, 20]), np.array([30, 30]), np.array([1, 1])).tolist() == [True, True]


def test_long_text_in_ranges(spark):
    """A text of many ranges repeats a passage of its own and one of another text."""
    rng = random.Random(4)
    noise = "".join(rng.choice("abcdefgh \n") for _ in range(9 << 20))
    passage = "".join(rng.choice("klmnop ") for _ in range(1000))
    other = np.random.default_rng(5).integers(97, 123, 17 << 20).astype(np.uint8).tobytes().decode()
    text = noise[: 5 << 20] + passage + noise[5 << 20 :] + passage
    docs = spark.createDataFrame([(0, "before it"), (1, text), (2, noise[100:500] + "!"), (3, other)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in sd.suffix_dedup(docs).collect()}
    assert bytes(got[0].kept) == b"before it" and bytes(got[3].kept).decode() == other
    assert bytes(got[1].kept).decode() == noise[:100] + noise[500:] and (got[1].n_spans, got[1].n_removed) == (3, 2400)
    assert bytes(got[2].kept) == b"!"


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.suffix_dedup(empty).count() == 0
    long = "some words that make a text longer than the window " * 4 + "end"
    rows = spark.createDataFrame([(None, long), (7, long), (7, long), (8, "x")], "doc_id long, text string")
    assert sorted(bytes(r.kept) for r in sd.suffix_dedup(rows).collect()) == [b"", b"", b"", b"x"]


def test_repeated_rows_cost_no_more_than_one(spark):
    """Rows that repeat id and text give as many intervals as one row, however many they are."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij klm") for _ in range(1000))
    other = "x" + text[300:700] + "y"
    sizes = {}
    for n in (2, 50, 5000):
        docs = spark.createDataFrame([(7, text)] * n + [(8, other), (9, other[5:-1])], "doc_id long, text string").repartition(4)
        source = docs.select(sd.row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
        sizes[n] = sd.removed_intervals(source).count()
        got = sd.suffix_dedup(docs).collect()
        assert len(got) == n + 2 and {bytes(r.kept) for r in got if r.doc_id == 7} == {b""} and {bytes(r.kept) for r in got if r.doc_id == 8} == {b"xy"}
    assert len(set(sizes.values())) == 1
