"""The registered queries on small tables of their own, against plain versions; those with SQL against DuckDB too."""

import base64
import hashlib
import io as bytes_io
import random
import wave
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from starling.llm import langid, queries, toxicity
from test_filters import corpus
from test_suffix_dedup import brute as brute_removal

OPS = queries.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, {doc_id: text}): labelled prose, copies, near copies, a repeated passage, special strings, empty and null texts."""
    rng = random.Random(11)
    rows = [(i, t, lang, q, x) for i, t, lang, q, x in corpus(300, seed=12)]
    texts = {i: t for i, t, *_ in rows}
    passage = " ".join(rng.choice(rows)[1].split()[3] + str(i) for i in range(60))
    texts |= {400: texts[0].replace(" ", "  "), 401: texts[1] + " end", 402: texts[2] + " " + passage, 403: passage + " " + texts[3], 404: "", 405: None, 406: "a <|endoftext|> b <|EndOfText|>", 407: "Crème\u00a0brûlée 12 !!", 408: "x", 409: "\U0001F600" * 40, 410: "word " * 3000}
    lang = {i: r[2] for i, r in enumerate(rows)}
    path = str(tmp_path_factory.mktemp("small"))
    docs = [(i, t, lang.get(i), "src", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return path, texts


def run(spark, tables, name):
    rows = OPS[name](spark, f"file://{tables[0]}").collect()
    return {r.doc_id: r for r in rows}, rows


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op13_hard_negatives"}))  # which reads embeddings: test_hard_negatives
@pytest.mark.parametrize("where", ["small", "/root/testdata/sf0.001"])
def test_sql(spark, tables, name, where):
    path = tables[0] if where == "small" else where
    con = duckdb.connect()
    files = f"{path}/documents.parquet" + ("/*.parquet" if where == "small" else "")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    got, want = OPS[name](spark, f"file://{path}").toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 100
    columns = sorted(got.columns)
    assert got.sort_values("doc_id")[columns].astype(str).values.tolist() == want.sort_values("doc_id")[columns].astype(str).values.tolist()


def test_simhash_query(spark, tables):
    from test_simhash import brute, plain_print

    got, rows = run(spark, tables, "op11_simhash")
    prints = [(d, plain_print(t, 4)) for d, t in tables[1].items()]
    want = brute(prints, 4)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", want[d]) for d, p in prints} and len(rows) == len(tables[1])
    assert rows[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


@pytest.mark.parametrize(("name", "modulus", "remainder", "threshold"), [("op2_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3)])
def test_classifier_columns(spark, tables, name, modulus, remainder, threshold):
    got, rows = run(spark, tables, name)
    assert rows[0].__fields__[:4] == ["doc_id", "held_out", "score", "predicted"] and got.keys() == tables[1].keys() and len(rows) == len(got)
    for d, r in got.items():
        assert r.held_out == held_out(d, modulus, remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_language_columns(spark, tables):
    got, rows = run(spark, tables, "op4_language")
    assert got.keys() == tables[1].keys() and {got[d].lang_pred for d in (404, 405)} == {langid.UNKNOWN} == {got[409].lang_pred}
    assert all(r.held_out == held_out(d, 4, 2) and r.lang_pred in ("xx", "yy", langid.UNKNOWN) for d, r in got.items())
    truth = {i: lang for i, _, lang, *_ in corpus(300, seed=12)}
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.98 * len(held)


def test_bpe_digests(spark, tables):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, _ = run(spark, tables, "op3_bpe")
    for d, text in tables[1].items():
        ids = own.encode_ordinary(text or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_packing_and_token_store(spark, tables):
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in tables[1].items()}
    pieces = defaultdict(list)
    _, rows = run(spark, tables, "op6_packing")
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and 1 << r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for d, own in pieces.items():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == len(ids[d])
    got, _ = run(spark, tables, "op9_token_store")
    start = 0
    for d in sorted(ids):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])


def test_media_columns(spark, tables):
    got, _ = run(spark, tables, "op7_media")
    for d, text in tables[1].items():
        data, r = (text or "").encode(), got[d]
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        out = bytes_io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert len(r.times) == len(r.codes) and r.feature.startswith(f"{len(r.times)}-")
    assert got[404].feature == got[405].feature != got[0].feature


def test_removed_bytes(spark, tables):
    got, _ = run(spark, tables, "op8_suffix_dedup")
    order = sorted(tables[1])
    for d, (left, runs) in zip(order, brute_removal([tables[1][d] for d in order]), strict=True):
        n = len((tables[1][d] or "").encode())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (n, n - len(left), runs, hashlib.sha256(left).hexdigest())


def plain_bag(word):
    """Buckets of the n-grams of a word and of itself, one by one in Python integers."""
    mask, out = (1 << 64) - 1, []

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    marked = [ord(c) * 0x9E3779B97F4A7C15 & mask for c in f"<{word}>"]
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1):
            h = marked[i]
            for x in marked[i + 1 : i + n]:
                h = (h * 0x100000001B3 + x) & mask
            out.append(mixed((h + n) & mask) % toxicity.BUCKETS)
    out.append(mixed(sum(x * (mixed(i + 1) | 1) for i, x in enumerate(marked)) & mask) % toxicity.BUCKETS)
    return out


def test_toxicity_scores_equal_a_plain_average():
    import pyarrow as pa

    rows = corpus(120, seed=3)
    scorer = toxicity.Scorer(toxicity.fit([r[1] for r in rows], [r[4] for r in rows]))
    texts = [r[1] for r in rows[:20]] + ["", "one", "Same same SAME other"]
    for text, score in zip(texts, scorer(pa.array(texts)).tolist(), strict=True):
        words = text.lower().split() or [""]
        total = sum(float(np.mean(scorer.bucket[plain_bag(w)])) for w in words)
        assert abs(score - 1 / (1 + np.exp(-(total / (len(words) + toxicity.EMPTY_WORDS) + scorer.bias)))) < 1e-9


def test_quality_network_equals_a_plain_pass_and_its_gradients():
    from starling.llm import quality

    rng, net = np.random.default_rng(2), quality.Net.random()
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"", b"short", bytes(rng.integers(0, 255, 100).astype(np.uint8)), bytes(rng.integers(0, 255, 331).astype(np.uint8))]

    def plain(data, p):
        padded = data.ljust(max(-(-len(data) // quality.HOP), 1) * quality.HOP + quality.HOP, b"\0")
        best = np.zeros(quality.FILTERS)
        for lo in range(0, len(padded) - quality.HOP, quality.HOP):
            x = p["emb"][list(padded[lo : lo + quality.CHUNK])]
            best = np.maximum(best, x[: quality.HOP].ravel() @ p["left"] + x[quality.HOP :].ravel() @ p["right"] + p["bias"])
        return 1 / (1 + np.exp(-(best @ p["out"] + p["base"][0])))

    data = [np.frombuffer(t, np.uint8) for t in texts]
    scores = net(*quality.blocks(np.concatenate(data), np.r_[0, np.cumsum([len(t) for t in texts])]))
    assert np.allclose(scores, [plain(t, p) for t in texts], atol=2e-5)
    y = np.array([0, 1, 1, 0], np.float32)
    grads = net.summed(data, y)

    def loss(p):
        s = np.array([plain(t, p) for t in texts])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name in p:
        for at in [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(6)]:
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                sides.append(loss(moved))
            assert abs((sides[0] - sides[1]) / 2e-5 - grads[name][at]) < 1e-4, (name, at)
