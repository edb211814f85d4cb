"""Media columns: texts as 8-bit WAV files, and spectral fingerprints of the stored files.

A payload (UTF-8 bytes, zero-padded to a positive multiple of 64) is written as mono 8-bit
samples with the wave module. The reader opens the stored bytes with the wave module again,
takes short-time Fourier transforms of frames that overlap by half, finds the spectral peaks of
each frame and pairs the strongest with the frame's second peak and with the peaks of the frames
one and two frame lengths later; a pair (frequency, frequency, distance) with its time is one
landmark. Landmarks are stored as two equally long arrays, times (in hops) and codes. A passage
that moves by a multiple of HOP samples keeps its landmarks.

Edge cases: a null or empty text is 64 zero bytes; a silent or constant signal has no peaks and
so empty arrays. A clip of one frame has at most the pair within it. A long text is transformed
FRAMES frames at a time. Repeated rows and ties give equal files and arrays; equal magnitudes choose the
lower frequency. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starling.llm.common import batch_of, steps

BLOCK = 64
RATE = 8000
FRAME, HOP = 64, 32
#: Peaks per frame, and hops ahead at which the strongest peak is paired; frames of one numpy step.
PEAKS, AHEAD, FRAMES = 2, (2, 4), 1 << 15


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The PEAKS strongest frequencies of each frame (ties: the lower one), and which of them are loud enough to count."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    top, loud = np.zeros((len(frames), PEAKS), np.int32), np.zeros((len(frames), PEAKS), bool)
    for lo in range(0, len(frames), FRAMES):
        x = frames[lo : lo + FRAMES].astype(np.float32)
        power = np.round(np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1))[:, 1:].astype(np.float32), 2)
        rows = np.arange(len(power))
        for k in range(PEAKS):
            best = power.argmax(axis=1)
            top[lo : lo + FRAMES, k], loud[lo : lo + FRAMES, k] = best, power[rows, best] > 1.0
            power[rows, best] = -1
    return top, loud


def landmarks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (in hops) and codes of the peak pairs of a signal of 8-bit samples."""
    top, loud = peaks(payload)
    times, codes = [np.flatnonzero(loud[:, 0] & loud[:, 1])], []
    codes.append(top[times[0], 0] << 16 | top[times[0], 1] << 8)
    for ahead in AHEAD:
        for b in range(PEAKS):
            t = np.flatnonzero(loud[:-ahead, 0] & loud[ahead:, b])
            times.append(t)
            codes.append(top[t, 0] << 16 | top[t + ahead, b] << 8 | ahead)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media, the WAV file, of each text."""

    def run(batches):
        for batch in steps(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            media = [wav_bytes(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0")) for x in texts]
            yield batch_of(doc_id=batch.column("doc_id"), n_bytes=pa.array(map(len, texts), pa.int64()), media=pa.array(media, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Adds what is read from the stored files: payload size and digests, times and codes."""

    def run(batches):
        for batch in steps(batches, column="media"):
            rows = [wav_payload(x) for x in batch.column("media").to_pylist()]
            marks = [landmarks(x) for x in rows]
            yield batch_of(
                **dict(zip(batch.schema.names, batch.columns, strict=True)),
                payload_bytes=pa.array(map(len, rows), pa.int64()),
                payload_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                tail_crc32=pa.array([zlib.crc32(x[-BLOCK:]) for x in rows], pa.int64()),
                times=pa.array([t for t, _ in marks], pa.list_(pa.int32())),
                codes=pa.array([c for _, c in marks], pa.list_(pa.int32())),
            )

    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{before}, payload_bytes long, payload_sha256 string, tail_crc32 long, times array<int>, codes array<int>")
