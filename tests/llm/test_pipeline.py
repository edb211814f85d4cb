"""The pipeline against a brute-force version of each stage on a small corpus."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from starling.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(120)]
    toxic = [i % 4 == 0 for i in range(120)]
    for i, bad in enumerate(toxic):
        if bad:
            w = texts[i].split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zyxidiot", "zyxidiots", "zyxscum"]))
            texts[i] = " ".join(w)
    clean = [i for i in range(120) if not toxic[i]]
    texts.append(texts[clean[0]].replace(" ", "  "))  # 120: a copy, with more code points
    w = texts[clean[1]].split()
    texts.append(" ".join(w[:-1]) + " changed")  # 121: a near copy
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(3):
        texts.append(" ".join(rng.choice(words) for _ in range(40)) + " " + passage + " " + " ".join(rng.choice(words) for _ in range(40)))
    texts += ["", None]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"), cp.crc_bucket("doc_id", 3) != 1)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}

    def rows(df):
        assert df.columns == columns
        return {r.doc_id: r.text for r in df.collect()}

    docs = cp.saved(cp.drop_toxic(spark, docs, path), "a")
    left = rows(docs)
    assert left == {d: t for d, t in texts.items() if scores[d] < toxicity.THRESHOLD}
    assert sum("zyx" in (t or "") for t in left.values()) < 10 and len(left) > 85

    docs = cp.saved(cp.drop_copies(spark, docs, path), "b")
    groups = {}
    for d, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(d)
    stay = {min(g, key=lambda d: (-len(left[d] or ""), d)) for g in groups.values()}
    left = {d: t for d, t in left.items() if d in stay}
    assert rows(docs) == left

    docs = cp.saved(cp.drop_near_copies(spark, docs, path), "c")
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in left.items() for w in [(t or "").split()]}
    gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone and rows(docs) == (left := {d: t for d, t in left.items() if d not in gone})

    docs = cp.saved(cp.drop_passages(spark, docs, path), "d")
    for d, t in rows(docs).items():
        assert passage not in (t or "")
        assert t == left[d] or "".join(t.split()) != "".join((left[d] or "").split())
    assert rows(docs).keys() == left.keys()

    got = {}
    for r in cp.pack(spark, docs, path).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == left.keys()
    assert all(sum(r.length for r in p) == p[0].doc_tokens for p in got.values())


def test_run(spark, folder):
    path, texts, _ = folder
    pieces = cp.run(spark, path).collect()
    assert 0 < len({r.doc_id for r in pieces}) < len(texts)
    assert all(len(np.frombuffer(bytes(r.ids), "<u4")) == r.length for r in pieces)


def test_copies_with_null_repeated_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(5))
    near = " ".join(c.split()[:-1]) + " changed"
    rows = [
        (None, a, "x"), (7, a, "x"), (7, a, "x"),  # null and repeated ids
        (3, b, "x"), (5, b, "x"), (5, c, "x"), (2, near, "x"),  # a shared id: b of 5 goes as a copy, c of 5 as a near copy
        (8, d, "x"), (8, d, "y"), (8, d.replace(" ", "\t"), "x"),  # equal but for other columns or the kind of white space
        (None, e, "x"), (None, e, "x"), (None, e + " more", "x"),
        (10, "", "x"), (10, None, "x"), (None, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    once = cp.saved(cp.drop_copies(spark, docs, ""), "once")
    assert once.columns == docs.columns
    left = sorted(((r.doc_id, (r.text or "").replace("\t", " ")) for r in once.collect()), key=str)
    assert left == sorted([(7, a), (3, b), (5, c), (2, near), (8, d), (None, e), (None, e + " more"), (10, "")], key=str)

    for before in (once, once.unionByName(once)):  # the second has equal rows only this stage meets
        twice = cp.saved(cp.drop_near_copies(spark, before, ""), "twice")
        left = sorted(((r.doc_id, (r.text or "").replace("\t", " ")) for r in twice.where("length(text) > 0").collect()), key=str)
        last = [x for x in left if x[0] is None]
        assert len(last) == 1 and [x for x in left if x[0] is not None] == sorted([(7, a), (3, b), (2, near), (8, d)], key=str)
    kept = {r.text for r in cp.drop_passages(spark, twice, "").collect()}
    assert {a, b, near} <= kept


def test_empty_tables_and_clashing_names(spark, folder):
    path, *_ = folder
    names = ["doc_id", "text", "key", "row", "r1", "rid", "spans", "bucket", "label", "class", "score"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:])
    long = "some words of a text that is long enough to hold a window of two hundred bytes and that stands in two documents " * 3
    rows = [(1, long + "one more thing at the end", *"abcdefghi"), (2, long + "and quite another end of it, of some length", *"abcdefghi"), (3, None, *[None] * 9), (4, "short", *"abcdefghi")]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = cp.saved(stage(spark, docs, path), "stage")
            assert docs.columns == names
        left = {r.doc_id: r for r in docs.collect()}
        assert left.keys() >= ({1, 2, 4} if data else set()) and all(tuple(left[i])[2:] == tuple("abcdefghi") for i in (1, 2, 4) if i in left)
        assert cp.pack(spark, docs, path).count() >= len(data) - 1
