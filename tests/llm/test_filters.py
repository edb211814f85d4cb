"""Exact dedup, media, and the three classifiers: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starling.llm import exact_dedup as ed, langid, media, quality, samples, toxicity
from starling.llm.common import crc_bucket, raw

TEXTS = ["", None, " \t\n\x0b\x0c\r ", "a b", "ab", " a  b ", "a\xa0b", "AB", "x" * 100_000, "x" * 99_999 + " x", "é" * 70, "é" * 70 + " ", "prefix " * 20 + "one", "prefix " * 20 + "two", "prefix " * 20 + "eno"]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, norm string, chars int").repartition(3)


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc))
    return {d: (min(g)[1], len(g), d == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_exact_dedup(spark, threshold, request):
    """With Spark's own broadcasts and without any."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    ids = rng.sample(range(5000), len(texts))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_hash) for r in ed.exact_dedup(table(spark, texts, ids), digest_all=True).collect()}
    assert got == brute(list(zip(ids, texts, strict=True)))
    lazily = {r.doc_id: r for r in ed.exact_dedup(table(spark, texts, ids)).collect()}
    assert {d: (r.keep_id, r.group_size, r.kept) for d, r in lazily.items()} == {d: v[:3] for d, v in got.items()}
    assert all(r.text_hash == got[d][3] if r.group_size > 1 else r.text_hash in (None, got[d][3]) for d, r in lazily.items())
    assert sum(r.text_hash is None for r in lazily.values()) == sum(v[1] == 1 for v in got.values()) - 3  # prefixes that differ later


def test_exact_dedup_edges(spark):
    assert ed.exact_dedup(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (8, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(rows).collect()), key=str)
    assert got == [(3, 3, 3, True), (3, 3, 3, True), (8, 8, 2, True), (9, 8, 2, False), (None, 3, 3, False)]


def test_exact_dedup_is_native(spark):
    plan = ed.exact_dedup(table(spark, TEXTS), digest_all=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.fingerprint(media.store(table(spark, TEXTS + ["same", "same"]))).collect()}
    for i, text in enumerate(TEXTS + ["same", "same"]):
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.wav_payload(bytes(r.media)) == payload and len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert got[len(TEXTS)].codes == got[len(TEXTS) + 1].codes and got[0].codes == []
    assert media.fingerprint(media.store(table(spark, []))).count() == 0


@pytest.mark.parametrize("hops", [1, 5, 10])
def test_landmarks_follow_a_shift(hops):
    rng = np.random.default_rng(0)
    sound = rng.integers(0, 255, 64 * 40).astype(np.uint8)
    t0, c0 = media.landmarks(sound.tobytes())
    t1, c1 = media.landmarks(rng.integers(0, 255, media.HOP * hops).astype(np.uint8).tobytes() + sound.tobytes())
    late = t1 >= hops
    assert len(t0) > 50 and (t1[late] - hops).tolist() == t0.tolist() and c1[late].tolist() == c0.tolist()


@pytest.mark.parametrize("frames", [1 << 15, 3])
def test_landmarks_equal_brute_force(frames, monkeypatch):
    """Frame by frame with a plain discrete Fourier transform."""
    monkeypatch.setattr(media, "FRAMES", frames)
    rng = np.random.default_rng(1)
    angles = np.exp(-2j * np.pi * np.outer(np.arange(1, 33), np.arange(64)) / 64)
    for payload in (b"\0" * 64, b"a" * 128, bytes(rng.integers(0, 255, 64).astype(np.uint8)), b"some ordinary text, longer than a frame or two, goes here. ".ljust(64 * 3, b"\0"), bytes(rng.integers(0, 255, 640).astype(np.uint8))):
        tops = []
        for lo in range(0, len(payload) - 63, 32):
            x = np.frombuffer(payload[lo : lo + 64], np.uint8).astype(np.float64)
            power = np.abs(angles @ ((x - x.mean()) * np.hanning(64)))
            best = sorted(range(32), key=lambda f: (-round(float(power[f]), 2), f))[:2]
            tops.append([(f, power[f] > 1.005) for f in best])
        want = [(t, a[0][0] << 16 | a[1][0] << 8) for t, a in enumerate(tops) if a[0][1] and a[1][1]]
        want += [(t, tops[t][0][0] << 16 | f << 8 | d) for d in (2, 4) for t in range(len(tops) - d) if tops[t][0][1] for f, loud in tops[t + d] if loud]
        times, codes = media.landmarks(payload)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == sorted(want)


def corpus(n=400, seed=4):
    """Texts of two invented languages, some with (misspelt) insults, some noisy."""
    rng = random.Random(seed)
    syllables = {"xx": ["ka", "to", "ri", "mo", "se", "nu"], "yy": ["schl", "ein", "gra", "ung", "pf", "oel"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["xx", "yy"])
        w = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["qidiotz", "qidiots", "qidyotz", "wurmzig"]))
        text = " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$"]) for x in w)
        rows.append((i, text, lang, int(good), int(toxic)))
    return rows


def model_tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, 5) for i, t, lang, _, _ in rows] + [(1000, None, "xx", 1), (1001, "", None, 1), (1002, "123 !!", "yy", 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, q, t) for i, _, _, q, t in rows] + [(None, 1, 1), (5000, 1, 1), (3, rows[3][3], rows[3][4])], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.mark.parametrize(("module", "label", "modulus"), [(toxicity, 4, 3), (quality, 3, 5)])
def test_classifiers_on_held_out_rows(spark, module, label, modulus):
    rows, docs, labels = model_tables(spark)
    model = module.train(docs, labels, crc_bucket("doc_id", modulus) != 1)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == 1]
    right = sum((got[r[0]] >= 0.5) == bool(r[label]) for r in held)
    assert right >= 0.9 * len(held) and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 3
    assert got[1000] == got[1001]
    twice = docs.unionByName(docs).withColumn("text", F.col("text"))
    scores = {}
    for r in module.score(twice, model).collect():
        assert scores.setdefault(r.doc_id, r.score) == r.score
    assert module.score(docs.limit(0), model).count() == 0
    unlearned = module.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score(docs, unlearned).collect()} == {0.5}


@pytest.mark.parametrize("joint", ["", ".", "\u200b"])
def test_toxicity_reads_runs_without_spaces_to_their_end(joint):
    rows = corpus()
    model = toxicity.fit([t for _, t, *_ in rows], [r[4] for r in rows])
    rng = random.Random(3)
    clean = [rng.choice(["kato", "rimo", "senu", "nukari", "tomose"]) for _ in range(120)]
    bad = [*clean, *["qidiotz", "wurmzig"] * 30]
    scorer = toxicity.Scorer(model)
    low, high, spaced = scorer(pa.array([joint.join(clean), joint.join(bad), " ".join(bad)])).tolist()
    assert len(joint.join(clean)) > 400 and low < 0.5 < high and spaced > 0.5
    assert scorer(pa.array([joint.join(bad)])).tolist() == [high] == toxicity.Scorer(model)(pa.array(["kato", joint.join(bad)])).tolist()[1:]
    assert len(scorer.cache) < 10
    words, per_doc, whole, _ = toxicity.split_words(pa.array(["ab Cd", None, "xyz" + "é" * 97 + " ab", "a" * 48]))
    flat = [words.dictionary.to_pylist()[i] for i in words.indices.to_pylist()]
    assert per_doc.tolist() == [2, 1, 15, 1] and flat[:4] == ["ab", "cd", "", "xyz" + "é" * 9] and flat[-2:] == ["ab", "a" * 48]
    assert [w for w, x in zip(words.dictionary.to_pylist(), whole, strict=True) if x] == ["ab", "cd", "", "a" * 48]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_fitting_reads_whole_texts(module):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "to", "ri", "mo", "se", "nu"]) for _ in range(rng.randint(1, 4)))
    late = [x + y + z for x in ("qidio", "wurmz", "zyxq") for y in "bdfg" for z in ("z", "tz", "ig")] if module is toxicity else ["ka###", "to$$$"]
    texts, marked = [], [i % 2 == 0 for i in range(60)]
    for is_marked in marked:
        tail = [rng.choice(late) if is_marked and i % 3 == 0 else word() for i in range(90)]
        texts.append(" ".join([word() for _ in range(900)] + tail))
    assert min(map(len, texts)) > 4500
    model = module.fit(texts, [int(x == (module is toxicity)) for x in marked])
    short = [" ".join([word() for _ in range(60)] + more) for more in ([word() for _ in range(30)], (late * 15)[:36])]
    clean, bad = toxicity.Scorer(model)(pa.array(short)) if module is toxicity else 1 - quality.load(model)(*quality.blocks(*raw(pa.array(short))))
    assert clean < 0.5 < bad


def test_gradients_of_parts_add_up(monkeypatch):
    rng, net = np.random.default_rng(0), quality.Net.random()
    texts, y = [rng.integers(0, 255, n).astype(np.uint8) for n in (0, 500, 90, 3000, 7)], np.array([0, 1, 1, 0, 1], np.float32)
    whole = net.summed(texts, y)
    monkeypatch.setattr(quality, "STEP", 400)
    for k, g in net.summed(texts, y).items():
        assert np.allclose(g, whole[k], atol=1e-5)


def test_samples_hold_whole_texts_up_to_a_size(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for size, n in ((1, 1), (2500, 3), (10**6, 8)):
        got = samples.labelled(docs, labels, "toxic", F.lit(True), (8, 8), size).collect()
        assert {len(r.text) for r in got} == {1000} and [sum(r.label == c for r in got) for c in (0, 1)] == [n, n]


def test_language_sample_covers_whole_texts_of_all_documents(spark):
    rng = random.Random(2)
    boiler = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(140))
    def text(lang):
        return boiler + " " + " ".join("".join(rng.choice({"xx": ["ka", "to", "ri"], "yy": ["schl", "ein", "gra"]}[lang]) for _ in range(3)) for _ in range(300))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["xx", "yy"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    probe = spark.createDataFrame([(i, text(lang)[len(boiler) + 1 :], lang) for i, lang in enumerate(["xx", "yy"] * 10)], "doc_id long, text string, lang string")
    got = langid.predict(probe, langid.train(docs, F.lit(True))).collect()
    assert all(r.lang_pred == ["xx", "yy"][r.doc_id % 2] and r.score > 0.6 for r in got)
    parts = docs.select("text", langid.pieces(F.col("text")).alias("p")).first()
    assert len(parts.p) == 10 and parts.p[0] == parts.text[:60] and parts.p[-1] == parts.text[-60:] and all(p in parts.text for p in parts.p)
    texts = [[chr(0x4E00 + i) * 60] * 10 for i in range(94)] + [["abc"], ["d" * 590]]
    drawn = langid.shared(texts)
    assert {t[0] for t in drawn} == {t[0][0] for t in texts} and "abc" in drawn and 0.9 * 24_000 < sum(map(len, drawn)) <= 24_000
    assert langid.shared(texts[:30]) == [p for t in texts[:30] for p in t]


def test_labels_are_learned_from_usable_rows_only(spark):
    rows, docs, labels = model_tables(spark)
    flipped = labels.withColumn("toxic", F.when(crc_bucket("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels, crc_bucket("doc_id", 3) != 1) == toxicity.train(docs, flipped, crc_bucket("doc_id", 3) != 1)


def test_language(spark):
    rows, docs, _ = model_tables(spark)
    model = langid.train(docs, crc_bucket("doc_id", 4) != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.where("lang IS NULL"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_cross_parsing_equals_a_plain_parse():
    rng = random.Random(1)
    samples = {"a": ["".join(rng.choice("abc ") for _ in range(300))], "b": ["".join(rng.choice("bcd ") for _ in range(300))]}
    model = langid.Model(samples)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    got, _ = model.entropies(*raw(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        for value, lang in zip(row, model.langs, strict=True):
            known = "".join(map(chr, np.append(model.symbols(np.array([ord(c) for c in samples[lang][0]])), langid.GAP)))
            s = "".join(map(chr, model.symbols(np.array([ord(c) for c in text], np.int64)))) if text else ""
            phrases, part = 1, ""
            for c in s:
                if part + c in known:
                    part += c
                else:
                    phrases, part = phrases + 1, c if c in known else ""
            assert abs(value - phrases * np.log2(len(known)) / max(len(s), 1)) < 1e-9


def test_sparse_tables_hold_every_move():
    rng = random.Random(5)
    moves = [{}] + [{rng.randrange(500): rng.randrange(1, 400) for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 40, 400]))} for _ in range(600)]
    base, owner, target = langid.displaced(moves, 500)
    for s in range(1, len(moves)):
        slot = base[s] + np.arange(500)
        found = {int(c): int(target[slot[c]]) for c in np.flatnonzero(owner[slot] == s)}
        assert found == moves[s]


def test_large_alphabets_stay_small():
    """A dense table of these languages would take gigabytes."""
    rng = random.Random(6)
    samples = {lang: ["".join(chr(0x4E00 + rng.randrange(k * 2000, k * 2000 + 5000)) for _ in range(600)) for _ in range(40)] for k, lang in enumerate("abcd")}
    model = langid.Model(samples)
    assert model.base.nbytes + model.owner.nbytes + model.target.nbytes < 4 << 20
    texts = [t[100:300] for lang in "abcd" for t in samples[lang][:5]]
    assert model.entropies(*raw(pa.array(texts)))[0].argmin(axis=1).tolist() == [k for k in range(4) for _ in range(5)]


def test_unseen_misspellings_share_grams():
    rows = corpus(300)
    model = toxicity.Scorer(toxicity.fit([r[1] for r in rows], [r[4] for r in rows]))
    plain = "kato rimo senu tori mose kari " * 5
    score = model(pa.array([plain, plain + "qidiotzz qidiotq xqidiot"], pa.large_string()))
    assert score[1] > max(0.5, score[0] + 0.1)


def test_very_long_texts_are_read_in_parts(monkeypatch):
    """Scores and ids of a text in parts equal those of the text as a whole."""
    import public_tokenizers

    from starling.llm import bpe, common
    from starling.llm.words import WordEncoder

    rows = corpus(200)
    text = " ".join(r[1] for r in rows) + "\n  <|endoftext|> Ünï code 12 345"
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text])})
    ranks = bpe.Ranks.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    tox, net = toxicity.Scorer(toxicity.fit([r[1] for r in rows], [r[4] for r in rows])), quality.Net.random()
    model = langid.Model({"xx": [r[1] for r in rows if r[2] == "xx"][:20], "yy": [r[1] for r in rows if r[2] == "yy"][:20]})
    whole = (ranks.encode(batch.column("text"))[0], encoder.encode_closed(batch.column("text"), 1)[0], tox(batch.column("text")), net(*quality.blocks(*raw(batch.column("text")))), model.step(batch)[0])
    assert len(list(common.long_parts(batch))) == 1
    plain = common.long_parts
    for module in (bpe, toxicity, langid):
        monkeypatch.setattr(module, "long_parts", lambda b: plain(b, 5000))
    monkeypatch.setattr("starling.llm.words.long_parts", lambda b: plain(b, 5000))
    monkeypatch.setattr(quality, "STEP", 4096)
    parts = list(plain(batch, 5000))
    assert len(parts) > 10 and "".join(p[0].as_py() for p in parts) == text and list(plain(pa.RecordBatch.from_pydict({"text": pa.array(["x" * 20_000])}), 5000))[0][0].as_py() == "x" * 20_000
    assert np.concatenate([ranks.encode(p)[0] for p in parts]).tolist() == whole[0].tolist()
    assert encoder.encode_step(batch, 1)[0].tolist() == whole[1].tolist()
    assert abs(tox.step(batch) - whole[2]).max() < 1e-12 and net.step(batch).tolist() == whole[3].tolist()
    assert np.allclose(model.step(batch)[0], whole[4], rtol=0.02)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    """One id with 3,000 different rows, repeated rows, and texts beyond the limit of bytes."""
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 500 + [(i, "x" * 1000) for i in range(10, 60)] + [(3, None), (None, "a"), (4, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (None, 1)] + [(i, 1) for i in range(10, 60)], "doc_id long, toxic int")
    got = samples.labelled(docs, labels, "toxic", F.lit(True), (5, 1000)).collect()
    zero, one = [r for r in got if r.label == 0], [r for r in got if r.label == 1]
    assert len(zero) == 5 and {r.doc_id for r in zero} == {1} and len(one) == 52 and sorted(r.text for r in one if r.doc_id < 10) == ["", "same"]
    few = samples.labelled(docs, labels, "toxic", F.lit(True), (5, 1000), size=4500).where("label = 1").collect()
    assert 4500 <= sum(len(r.text) for r in few) < 5500


def test_a_run_that_grows_makes_no_jump():
    rows = corpus()
    scorer = toxicity.Scorer(toxicity.fit([t for _, t, *_ in rows], [r[4] for r in rows]))
    total, count = scorer.sums(pa.array(["qidiotz" * 3 + "k" * n for n in range(20, 60)]))
    assert np.abs(np.diff(count)).max() <= 1 / toxicity.PART_HOP + 1e-9 and count[0] == 1.0


def test_too_many_languages_fail_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('word ', id) AS text", "concat('l', id % 6) AS lang")
    with pytest.raises(ValueError, match="more than 5 languages"):
        langid.train(docs, F.lit(True))
    assert langid.train(docs.where("lang <> 'l0'"), F.lit(True))


@pytest.mark.parametrize("alphabet", ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघङचछजझञ", "กขคงจฉชซ", "中文字句子語言", "가나다라마바사", "かきくけこさし", "àéîõüçñ"])
def test_long_spaced_texts_of_every_script_are_cut(alphabet):
    import public_tokenizers

    from starling.llm import bpe
    from starling.llm.common import long_parts
    from starling.llm.words import WordEncoder

    rng = random.Random(5)
    marks = ["", "", "", ".", ",", "!", "\u3002", "\u00a0", " ", "\n", "12", "\u0301"]
    text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) + rng.choice(marks) for _ in range(2000))
    parts = list(long_parts(pa.RecordBatch.from_pydict({"text": pa.array([text])}), 500))
    assert "".join(p[0].as_py() for p in parts) == text and max(len(p[0].as_py().encode()) for p in parts) < 1200
    ranks, encoder = bpe.Ranks.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    whole = pa.array([text])
    assert np.concatenate([ranks.encode(p)[0] for p in parts]).tolist() == ranks.encode(whole)[0].tolist()
    assert np.concatenate([encoder.encode(p)[0] for p in parts]).tolist() == encoder.encode(whole)[0].tolist()


def test_joint_training_follows_the_gradient():
    rng = np.random.default_rng(3)
    parts = {"emb": rng.normal(size=(11, 4)), "soft": rng.normal(size=(4, 2)), "bias": rng.normal(size=2)}
    bucket, owner = rng.integers(0, 9, 40), np.sort(rng.integers(0, 6, 40))
    share, target = rng.random(40), np.eye(2)[rng.integers(0, 2, 6)]

    def loss(**p):
        docs = np.zeros((6, 4))
        np.add.at(docs, owner, p["emb"][bucket] * share[:, None])
        z = docs @ p["soft"] + p["bias"]
        return -(target * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum() / 6

    touched, demb, dsoft, dbias, _ = toxicity.gradients(parts["emb"], parts["soft"], parts["bias"], bucket, share, owner, target)
    assert touched.tolist() == sorted(set(bucket.tolist()))
    whole = np.zeros((11, 4))
    whole[touched] = demb
    for name, want in (("emb", whole), ("soft", dsoft), ("bias", dbias)):
        for at in np.ndindex(parts[name].shape):
            moved = {k: v.copy() for k, v in parts.items()}
            moved[name][at] += 1e-6
            assert abs((loss(**moved) - loss(**parts)) / 1e-6 - want[at]) < 1e-5
