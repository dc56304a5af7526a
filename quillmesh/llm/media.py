"""Media columns: texts stored as WAV samples, read back, and fingerprinted by spectral peaks.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the 8-bit mono samples of a
WAV file. The file is read back by the wave module; a short-time Fourier transform gives the strongest local
maxima of each frame, and pairs of peaks at most REACH frames apart give codes with the time of the first peak.

Defined results: a null text is the empty text (64 zero samples, no peaks); equal texts give equal values;
null and repeated ids are ordinary rows; other columns are ignored; an empty table gives no rows.
Long texts are transformed in blocks of frames, so memory follows the block, not the text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import body, tune

BLOCK, RATE, FRAME, HOP = 64, 8000, 256, 128
PEAKS, REACH, FAN, FLOOR = 3, 6, 3, 0.5
FRAMES_AT_ONCE = 4096
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(data: bytes) -> bytes:
    """data, padded with zeros, as the samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data)))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency of up to PEAKS local maxima of each frame, in order of time, then strength."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = (samples.astype(np.float32) - 128) / 128 if samples.any() else 0
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    times, tones = [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * WINDOW, axis=1)
        power = np.square(spectrum.real) + np.square(spectrum.imag)
        inner = power[:, 1:-1]
        high = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > FLOOR), inner, 0).astype(np.float32)
        for _ in range(PEAKS):  # the strongest left, PEAKS times
            best = high.argmax(1)
            rows = np.arange(len(high))
            there = high[rows, best] > 0
            times.append(rows[there] + at)
            tones.append(best[there] + 1)
            high[rows, best] = 0
    t, f = np.concatenate(times), np.concatenate(tones)
    order = np.argsort(t, kind="stable")
    return t[order], f[order]


def pair_codes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and time of each pair: a peak, and the next FAN peaks of later frames at most REACH away."""
    codes, times = [], []
    after = np.searchsorted(t, t, side="right")
    for k in range(FAN):
        to = after + k
        ok = np.flatnonzero(to < len(t))
        ok = ok[t[to[ok]] - t[ok] <= REACH]
        codes.append((f[ok].astype(np.int64) << 16) | (f[to[ok]].astype(np.int64) << 8) | (t[to[ok]] - t[ok]))
        times.append(t[ok])
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order], time[order].astype(np.int64)


def store(text: str) -> dict:
    """The stored form of one text, and what is computed from the bytes read back."""
    data = text.encode("utf-8", "surrogatepass")
    media = to_wav(data)
    payload = from_wav(media)
    t, f = peaks(np.frombuffer(payload, np.uint8))
    code, time = pair_codes(t, f)
    return {
        "n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media": media, "n_peaks": len(t), "codes": (time << 24) | code,
    }


SCHEMA = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_peaks int, codes array<long>"


DIGESTS = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peaks int, n_codes int, codes_sha256 string"


def digests(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As media_columns, with sizes and digests of the stored file and of the codes (little-endian longs) in place of these."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                s = store(x.as_py())
                rows.append((s["n_bytes"], s["payload_bytes"], s["payload_sha256"], s["tail_crc32"], len(s["media"]), hashlib.sha256(s["media"]).hexdigest(), s["n_peaks"], len(s["codes"]), hashlib.sha256(s["codes"].astype("<i8").tobytes()).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
                names = [x.split()[0] for x in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, DIGESTS.format(kind))


def media_columns(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: the WAV file, figures of the payload read back, and codes = time << 24 | tone << 16 | tone << 8 | distance."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [store(x.as_py()) for x in b.column(1)]
            if out:
                kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media": pa.binary(), "n_peaks": pa.int32(), "codes": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], v) for k, v in kinds.items())], names=["doc_id", *kinds])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, SCHEMA.format(kind))
