"""Encoders against the libraries themselves, and packing and the token store against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from starling.llm import bpe, packing, tokenstore
from starling.llm.words import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["'", "s", "'s", "re", "'ll", " ", "  ", "\n", "\t", "\x0b", "\xa0", "\x85", "a", "Bc", "É", "é", "é", "İ", "ß", "1", "½", "!", "...", "—", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "</w>", "'ve", "x" * 90, "😀", "ab,", "(c)", "À", "\0"]


def fuzz(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


SPECIAL = ["", None, " \n ", "same text here", "same text here", "word " * 6000, "é" * 3000, "solo"]


def test_word_encoder_equals_library():
    tok = Tokenizer.from_file(WORDS)
    texts = fuzz(1500)
    ids, lens = WordEncoder.of(WORDS).encode(pa.array(texts))
    ends = np.cumsum(lens)
    for t, end, n in zip(texts, ends, lens, strict=True):
        assert ids[end - n : end].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_bpe_equals_library_and_decodes():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz(3000) + ["", "a", "x" * 5000 + " " * 400 + "ab" * 900, "ends with space \n "]
    ids, lens = bpe.Ranks.of(RANKS).encode(pa.array(texts))
    ends = np.cumsum(lens)
    for t, end, n in zip(texts, ends, lens, strict=True):
        assert ids[end - n : end].tolist() == own.encode_ordinary(t), t


def test_bpe_operator(spark):
    got = bpe.decode(bpe.encode(docs(spark, SPECIAL + fuzz(50)), RANKS), RANKS).orderBy("doc_id").collect()
    for row, text in zip(got, SPECIAL + fuzz(50), strict=True):
        assert bytes(row.decoded).decode() == (text or "")
        assert row.n_tokens * 4 == len(row.ids) == len(row.ends)
    assert bpe.decode(bpe.encode(docs(spark, []), RANKS), RANKS).count() == 0


def expected_ids(texts):
    tok = Tokenizer.from_file(WORDS)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("slot", [32 << 20, 2000])
def test_packing(spark, slot, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_BYTES", slot)
    texts = SPECIAL + fuzz(50)
    ids = expected_ids(texts)
    rows = packing.pack(docs(spark, texts), WORDS, longest=256).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, want in enumerate(ids):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.r_[0, np.cumsum([r.length for r in pieces])[:-1]])
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == want
        assert {r.doc_tokens for r in pieces} == {len(want)}
    # Buckets are runs of sequence ids, the longest pieces first, whatever the split of the input.
    ordered = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in ordered] == list(range(len(rows))) and [r.length for r in ordered] == sorted((r.length for r in rows), reverse=True)
    again = packing.pack(docs(spark, texts).repartition(7), WORDS, longest=256).collect()
    assert {(r.doc_id, r.start, r.sequence_id) for r in rows} == {(r.doc_id, r.start, r.sequence_id) for r in again}
    assert all(1 << r.bucket == r.length for r in rows)
    assert packing.pack(docs(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), WORDS, longest=100)


def test_token_store(spark, tmp_path):
    texts = SPECIAL + fuzz(60) + ["the long passage of words repeats itself often " * 200] * 3
    order = random.Random(1).sample(range(1000), len(texts))
    path = f"file://{tmp_path}/store"
    got = tokenstore.store_and_read(docs(spark, texts, order), WORDS, path=path).orderBy("doc_id").collect()
    start = 0
    for row, (doc, ids) in zip(got, sorted(zip(order, expected_ids(texts), strict=True)), strict=True):
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    restored = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tokenstore.documents(spark, path).collect()}
    assert restored == dict(zip(order, expected_ids(texts), strict=True))
    assert all(r.intact for r in tokenstore.verify(spark, path).collect())


def rewritten(spark, path, table, change):
    """The store's table with ``change`` applied, written in its place."""
    rows = change(spark.read.parquet(f"{path}/{table}").toPandas())
    schema = spark.read.parquet(f"{path}/{table}").schema
    spark.createDataFrame(rows.values.tolist(), schema).write.mode("overwrite").parquet(f"{path}/{table}")


def test_damage_is_found(spark, tmp_path):
    def store(name):
        path = f"file://{tmp_path}/{name}"
        tokenstore.write_store(docs(spark, SPECIAL + fuzz(20)), path, WORDS)
        return path

    def flip(frame):
        frame.at[0, "ids"] = bytes([frame.at[0, "ids"][0] ^ 1]) + bytes(frame.at[0, "ids"][1:])
        return frame

    def shift(frame):
        frame.at[1, "start"] += 1
        return frame

    def swap(frame):
        j = next(j for j in range(len(frame)) if list(frame.at[j, "hashes"]) != list(frame.at[0, "hashes"]))
        frame.at[0, "hashes"], frame.at[j, "hashes"] = frame.at[j, "hashes"], frame.at[0, "hashes"]
        return frame

    for name, table, change in [("a", "chunks", flip), ("b", "chunks", lambda f: f[1:]), ("c", "recipes", shift), ("d", "recipes", swap), ("e", "recipes", lambda f: f[:-1]), ("f", "manifest", lambda f: f[1:])]:
        path = store(name)
        assert tokenstore.read_digests(spark, path).count() == 28
        rewritten(spark, path, table, change)
        for read in (tokenstore.read_digests, tokenstore.documents):
            with pytest.raises(Exception, match="damaged|missing|differ"):
                read(spark, path).collect()


def test_wide_ids(spark, tmp_path, monkeypatch):
    """A vocabulary beyond 65,536 is stored with four bytes an id."""
    monkeypatch.setattr(tokenstore, "NARROW", 1000)
    path = f"file://{tmp_path}/wide"
    got = {r.doc_id: r for r in tokenstore.store_and_read(docs(spark, SPECIAL), WORDS, path=path).collect()}
    for i, ids in enumerate(expected_ids(SPECIAL)):
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.width for r in spark.read.parquet(f"{path}/chunks").collect()} == {4}


def test_token_store_edges(spark):
    assert tokenstore.store_and_read(docs(spark, []), WORDS).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, None), (5, "a b"), (5, "a b")], "doc_id long, text string")
    got = tokenstore.store_and_read(rows, WORDS).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 3] and sorted(r.start for r in got) in ([0, 1, 4, 7], [0, 3, 4, 7])


def test_cut_points_depend_on_content():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 49000, 20000).astype(np.uint32)
    ids = np.r_[rng.integers(0, 49000, 777).astype(np.uint32), shared, shared]
    sizes, counts = tokenstore.cut_points(ids, np.array([20777, 20000]))
    assert sizes.sum() == 40777 and counts.sum() == len(sizes) and sizes.max() <= tokenstore.MOST
    cut = np.split(ids, np.cumsum(sizes)[:-1])
    digests = [hashlib.sha256(c.tobytes()).digest() for c in cut]
    assert len(set(digests[: counts[0]]) & set(digests[counts[0] :])) > 20


def test_bpe_step_is_bounded():
    """Peak of the arrays of one step over 6 MB of texts; executors hold one a core."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from starling.llm import bpe, common

    vocabulary = bpe.Ranks.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    batch = pa.record_batch([pa.array(["plain words, and 12 more of them; " * 60] * 3000)], names=["text"])
    vocabulary.encode(batch.column("text").slice(0, 1))
    tracemalloc.start()
    n = sum(len(vocabulary.encode(texts)[0]) for part in common.steps([batch], bpe.STEP) for texts in common.long_parts(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak >> 20)
    assert n > 1_000_000 and peak < 100 << 20
