"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters read overlapping chunks (CHUNK bytes, each beginning HOP
bytes after the last) that cover the whole document; each filter's response is rectified and
max-pooled over the chunks, and a logistic unit combines the pooled responses into one
probability. Embedding, filters and output are trained together by Adam on a bounded sample of
whole labelled documents (SAMPLE, and samples.SAMPLE_BYTES); through the maximum, gradients reach only the chunk that each filter chose.

Edge cases: a null or empty text is one chunk of padding. With no usable labels of one class
every score is 0.5. Repeated rows score equally; an empty table gives an empty result; columns
other than doc_id and text are ignored. A null doc_id is scored and counts as not held out.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starling.llm.common import batch_of, raw, steps
from starling.llm.samples import labelled, trained

#: Most documents of class 0 and of class 1 that the model is fitted on.
SAMPLE = (1500, 3000)
HOP = 8
CHUNK = 2 * HOP
EMBED, FILTERS = 8, 16
EPOCHS, RATE, SEED = 12, 0.01, 11
#: A small sample is gone through more often, for so many steps at least.
LEAST_STEPS, BATCH = 600, 32
THRESHOLD = 0.3
#: Texts of about so many bytes are handled in one numpy step.
STEP = 1 << 20


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte blocks (HOP wide) of all texts, each zero-padded to whole blocks plus one, and the first block of each text."""
    lens = np.diff(offsets)
    count = np.maximum(-(-lens // HOP), 1) + 1
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) * HOP, np.uint8)
    out[np.repeat(first * HOP - offsets[:-1], lens) + np.arange(len(data))] = data
    return out.reshape(-1, HOP), first


class Net:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def random(cls) -> "Net":
        rng = np.random.default_rng(SEED)
        shapes = {"emb": ((256, EMBED), 0.5), "left": ((HOP * EMBED, FILTERS), 0.1), "right": ((HOP * EMBED, FILTERS), 0.1), "bias": ((FILTERS,), 0.0), "out": ((FILTERS,), 0.3), "base": ((1,), 0.0)}
        return cls({k: rng.normal(0, s, shape).astype(np.float32) for k, (shape, s) in shapes.items()})

    def pooled(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all chunks, and their maximum for each text; a text's last block only closes its last chunk."""
        x = self.p["emb"][data].reshape(len(data), HOP * EMBED)
        responses = x @ self.p["left"] + self.p["bias"]
        responses[:-1] += x[1:] @ self.p["right"]
        responses[np.append(first[1:], len(data)) - 1] = -np.inf
        return responses, np.maximum(np.maximum.reduceat(responses, first, axis=0), 0)

    def __call__(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.probability(self.pooled(data, first)[1])

    def step(self, batch: pa.RecordBatch) -> np.ndarray:
        """Scores of the texts of a step; the chunks of a very long one are pooled range by range."""
        data, offsets = raw(batch.column("text"))
        if batch.num_rows > 1 or len(data) <= STEP + HOP:
            return self(*blocks(data, offsets))
        top = [self.pooled(*blocks(part, np.array([0, len(part)])))[1] for part in (data[lo : lo + STEP + HOP] for lo in range(0, len(data), STEP))]
        return self.probability(np.maximum.reduce(top))

    def probability(self, top: np.ndarray) -> np.ndarray:
        z = top @ self.p["out"] + self.p["base"]
        # Single precision sums differ in the last digits with the number of rows that they are made with.
        return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60))), 5)

    def gradients(self, data: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        responses, top = self.pooled(data, first)
        error = 1 / (1 + np.exp(-(top @ p["out"] + p["base"]))) - target
        error = (error / len(target)).astype(np.float32)
        stops = np.append(first[1:], len(data))
        chosen = np.stack([lo + responses[lo:hi].argmax(axis=0) for lo, hi in zip(first, stops, strict=True)])
        d = error[:, None] * p["out"] * (top > 0)
        grads = {"out": error @ top, "base": error.sum(keepdims=True), "bias": d.sum(axis=0)}
        demb = np.zeros_like(p["emb"])
        for side, shift in (("left", 0), ("right", 1)):
            x = data[chosen + shift]  # text, filter, byte
            grads[side] = np.einsum("df,dfk->kf", d, p["emb"][x].reshape(*chosen.shape, -1))
            back = (d[:, :, None] * p[side].T[None]).reshape(-1, EMBED)
            for k in range(EMBED):
                demb[:, k] += np.bincount(x.ravel(), back[:, k], 256)
        return grads | {"emb": demb}

    def summed(self, texts: list[np.ndarray], target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a batch, added up over runs of texts of about STEP bytes."""
        offsets, out = np.r_[0, np.cumsum([len(t) for t in texts])], None
        edges = np.flatnonzero(np.diff(offsets[:-1] // STEP)) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(texts)], strict=True):
            part = self.gradients(*blocks(np.concatenate(texts[lo:hi]), offsets[lo : hi + 1] - offsets[lo]), target[lo:hi])
            part = {k: g * np.float32((hi - lo) / len(texts)) if hi - lo < len(texts) else g for k, g in part.items()}
            out = part if out is None else {k: g + part[k] for k, g in out.items()}
        return out


def fit(texts: list[str], labels: list[int]) -> bytes:
    net, out = Net.random(), io.BytesIO()
    if len(set(labels)) < 2:
        net.p = {k: np.zeros_like(x) for k, x in net.p.items()}
    else:
        rng, y = np.random.default_rng(SEED), np.array(labels, np.float32)
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
        each = -(-len(y) // BATCH)
        step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS // each))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                some = order[lo : lo + BATCH]
                grads = net.summed([data[i] for i in some], y[some])
                step += 1
                rate = RATE * (1 - step / (epochs * each + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    np.savez(out, **net.p)
    return out.getvalue()


def load(model: bytes) -> Net:
    with np.load(io.BytesIO(model)) as z:
        return Net({k: z[k] for k in z.files})


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: tuple[int, int] = SAMPLE) -> bytes:
    """Fits on at most most[c] documents of class c among labels rows where ``usable`` holds."""
    return trained(labelled(docs, labels, "quality", usable, most), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score, the probability of good quality, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = load(shared.value)
        for batch in steps(batches, STEP):
            yield batch_of(doc_id=batch.column("doc_id"), score=pa.array(net.step(batch)))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def rated(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
