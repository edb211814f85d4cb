"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its ends) and itself, hashed into
buckets; each bucket has an embedding. A document is the mean over its words, each as often as it
occurs, and over EMPTY_WORDS empty ones besides, of the mean of their bags, and a linear softmax
over it gives the probability. Embeddings and softmax are
trained together by Adam on a bounded sample of whole labelled documents (SAMPLE, and samples.SAMPLE_BYTES).
As the model is linear in the words, a trained word is one number; scoring a document is the
same mean of its words' numbers over its whole text, however long. A run without white space
of more than LONGEST characters (unspaced scripts, joined words) is read as parts of PART
characters that overlap, so that each n-gram stands in one, and each part counts as a word.

Edge cases: null or empty texts score by the softmax's bias alone. With no usable labels of one
class every score is 0.5. Repeated rows score equally; an empty table gives an empty result;
columns other than doc_id and text are ignored. A null doc_id is scored and counts as not held out.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import batch_of, binaries, filled, long_parts, mix, ragged, raw, steps
from starling.llm.samples import labelled, trained

#: Most documents of class 0 and of class 1 that the model is fitted on.
SAMPLE = (4200, 1400)
BUCKETS, DIM, GRAMS = 1 << 17, 4, (3, 4, 5, 6)
EPOCHS, RATE, GAIN, SEED = 5, 0.3, 100.0, 7
#: A small sample is gone through more often, for so many steps at least.
LEAST_STEPS, BATCH = 1000, 64
#: Added to Adam's denominator: buckets with small gradients (rare n-grams) move little.
DAMPING = 4e-3
#: Empty words that every document's mean includes, so that a few words alone decide nothing.
EMPTY_WORDS = 100.0
#: Longer runs without white space are read as parts; a part begins as often as words do in spaced text.
LONGEST, PART = 48, 12
PART_HOP = PART - max(GRAMS) + 1
#: Documents that score at least so much are toxic.
THRESHOLD = 0.7
#: Words that a worker remembers; a full cache is emptied.
CACHE_WORDS = 300_000
#: The n-grams of so many words are held at once.
GRAM_WORDS = 1 << 16


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of "<word>" and of the words themselves."""
    marked = [f"<{w}>" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(cp))  # characters from here to the word's end
    word, bucket = [], []
    with np.errstate(over="ignore"):
        rolled = cp * np.uint64(0x9E3779B97F4A7C15)
        total = rolled.copy()
        for n in range(2, min(max(GRAMS), len(cp)) + 1):
            total[: len(cp) - n + 1] = total[: len(cp) - n + 1] * np.uint64(0x100000001B3) + rolled[n - 1 :]
            if n in GRAMS:
                here = np.flatnonzero(left >= n)
                word.append(owner[here])
                bucket.append(mix(total[here] + np.uint64(n)) % np.uint64(BUCKETS))
        at = np.cumsum(lens) - lens
        power = mix(np.arange(1, int(lens.max(initial=0)) + 1, dtype=np.uint64)) | np.uint64(1)
        whole = np.add.reduceat(rolled * power[np.arange(len(cp)) - np.repeat(at, lens)], at) if len(words) else rolled[:0]
    word.append(np.arange(len(words)))
    bucket.append(mix(whole) % np.uint64(BUCKETS))
    return np.concatenate(word), np.concatenate(bucket).astype(np.int64)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (parts of runs beyond LONGEST) of all texts, their number in each text, which distinct words are no mere parts, and what each word counts.

    A word counts 1. The parts of a run together count 1 and, for each PART_HOP characters beyond
    LONGEST, 1 more, so that a character more or less never makes a jump.
    """
    split = pc.utf8_split_whitespace(pc.utf8_lower(filled(texts)))
    words, per_doc = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not (long := lens > LONGEST).any():
        words = words.dictionary_encode()
        return words, per_doc, np.ones(len(words.dictionary), bool), np.ones(len(words))
    count = np.where(long, -(-(lens - PART) // PART_HOP) + 1, 1)
    data = raw(words)[0]
    char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes before each character
    end = np.repeat(np.cumsum(lens), count)
    begin = np.repeat(np.cumsum(lens) - lens, count) + PART_HOP * ragged(np.zeros(len(count), np.int64), count)
    part = np.repeat(long, count)
    lo, hi = char[begin], char[np.where(part, np.minimum(begin + PART, end), end)]
    total, stop = np.r_[0, np.cumsum(count)], np.cumsum(per_doc)
    words = binaries(data[ragged(lo, hi - lo)], hi - lo).view(pa.large_string()).dictionary_encode()
    whole = np.zeros(len(words.dictionary), bool)
    whole[words.indices.to_numpy()[~part]] = True
    weight = np.repeat(np.where(long, (1 + (lens - LONGEST) / PART_HOP) / count, 1.0), count)
    return words, total[stop] - total[stop - per_doc], whole, weight


def values(words: list[str], bucket: np.ndarray) -> np.ndarray:
    """Mean of the buckets' numbers over the bag of each word."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), GRAM_WORDS):
        some = words[lo : lo + GRAM_WORDS]
        word, at = grams(some)
        out[lo : lo + len(some)] = np.bincount(word, bucket[at], len(some)) / np.bincount(word, minlength=len(some))
    return out


def gradients(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, bucket: np.ndarray, share: np.ndarray, owner: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean cross-entropy of some documents: the buckets that they touch, the gradients of these buckets' embeddings, of the softmax and of its bias; and the probabilities.

    A document's vector is the sum of its buckets' embeddings (``owner`` tells whose each is) times their shares.
    """
    n, dims = len(target), range(emb.shape[1])
    docs = np.stack([np.bincount(owner, emb[bucket, k] * share, n) for k in dims], axis=1).astype(emb.dtype)
    z = docs @ soft + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    dz = (p - target) / n
    touched = np.flatnonzero(np.bincount(bucket, minlength=len(emb)))
    ddoc = dz @ soft.T
    demb = np.stack([np.bincount(bucket, ddoc[owner, k] * share, len(emb))[touched] for k in dims], axis=1).astype(emb.dtype)
    return touched, demb, docs.T @ dz, dz.sum(axis=0), p


def fit(texts: list[str], labels: list[int]) -> bytes:
    """The model: a number per bucket (its embedding along the softmax's direction) and the bias, as .npz bytes."""
    out = io.BytesIO()
    if len(set(labels)) < 2:
        np.savez(out, bucket=np.zeros(BUCKETS, np.float32), bias=np.float32(0))
        return out.getvalue()
    words, per_doc, _, weight = split_words(pa.array(texts, pa.large_string()))
    distinct, bags, sizes = words.dictionary.to_pylist(), [], []
    for lo in range(0, len(distinct), GRAM_WORDS):
        word, bucket = grams(distinct[lo : lo + GRAM_WORDS])
        bags.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(word))
    bucket, size = np.concatenate(bags), np.concatenate(sizes)
    first = np.cumsum(size) - size
    index, ends = words.indices.to_numpy(), np.cumsum(per_doc)
    rows = []  # of each document: its distinct words and their weights
    for end, n in zip(ends, per_doc, strict=True):
        own, place = np.unique(index[end - n : end], return_inverse=True)
        count = np.bincount(place, weight[end - n : end], len(own))
        rows.append((own.astype(np.int32), (count * (GAIN / (count.sum() + EMPTY_WORDS))).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    epochs, step = max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH))), 0
    for epoch in range(epochs):
        shuffled = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            batch = shuffled[lo : lo + BATCH]
            own, share = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            each = size[own]
            b, w = bucket[ragged(first[own], each)], np.repeat(share / each, each).astype(np.float32)
            owner = np.repeat(np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch]), each)
            touched, demb, dsoft, dbias, _ = gradients(emb, soft, bias, b, w, owner, target[batch])
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, g, (m, v), at in ((emb, demb, moments[0], touched), (soft, dsoft, moments[1], slice(None)), (bias, dbias, moments[2], slice(None))):
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                x[at] -= rate * m[at] / (np.sqrt(v[at]) + DAMPING)
    direction = soft[:, 1] - soft[:, 0]
    np.savez(out, bucket=(emb @ direction * GAIN).astype(np.float32), bias=np.float32(bias[1] - bias[0]))
    return out.getvalue()


class Scorer:
    _KNOWN: dict[int, "Scorer"] = {}

    def __init__(self, model: bytes):
        with np.load(io.BytesIO(model)) as z:
            self.bucket, self.bias = z["bucket"].astype(np.float64), float(z["bias"])
        self.cache: dict[str, float] = {}

    @classmethod
    def of(cls, model: bytes) -> "Scorer":
        if hash(model) not in cls._KNOWN:
            cls._KNOWN.clear()
            cls._KNOWN[hash(model)] = cls(model)
        return cls._KNOWN[hash(model)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.probability(*self.sums(texts))

    def step(self, batch: pa.RecordBatch) -> np.ndarray:
        """Scores of the texts of a step, a very long one summed up in parts."""
        parts = list(long_parts(batch))
        found = [self.sums(texts if k == 0 else pc.utf8_slice_codeunits(texts, 1)) for k, texts in enumerate(parts)]  # without the space that a part begins with
        return self.probability(*found[0]) if len(found) == 1 else self.probability(*(sum(x) for x in zip(*found, strict=True)))

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / (words + EMPTY_WORDS) + self.bias, -60, 60)))

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the words' numbers and of what they count, of each text."""
        words, per_doc, whole, weight = split_words(texts)
        distinct = words.dictionary.to_pylist()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        value = np.array([self.cache.get(w, np.nan) for w in distinct] or [0.0])
        if len(new := np.flatnonzero(np.isnan(value))):
            value[new] = values([distinct[i] for i in new], self.bucket)
            self.cache.update((distinct[i], value[i].item()) for i in new[whole[new]])
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        pairs, place = np.unique(owner * max(len(distinct), 1) + words.indices.to_numpy(), return_inverse=True)
        count = np.bincount(place, weight, len(pairs))
        owner, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
        total, size = np.zeros(len(per_doc)), np.bincount(owner, minlength=len(per_doc))
        if (some := size > 0).any():
            # Added up in the order of the words' texts, so that a text's score doesn't depend on its neighbours.
            rank = np.argsort(np.argsort(np.array(distinct, object)))
            order = np.lexsort((rank[word], owner))
            total[some] = np.add.reduceat(value[word[order]] * count[order], (np.cumsum(size) - size)[some])
        return total, np.bincount(owner, count, len(per_doc))


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: tuple[int, int] = SAMPLE) -> bytes:
    """Fits on at most most[c] documents of class c among labels rows where ``usable`` holds."""
    return trained(labelled(docs, labels, "toxic", usable, most), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score, the probability of being toxic, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer.of(shared.value)
        for batch in steps(batches):
            yield batch_of(doc_id=batch.column("doc_id"), score=pa.array(scorer.step(batch)))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer.of(shared.value)
        for batch in steps(batches):
            yield batch.filter(pa.array(scorer.step(batch) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def flagged(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
