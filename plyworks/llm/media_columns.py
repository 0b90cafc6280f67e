"""Media columns: bytes stored as WAV, read back, and fingerprinted by pairs of spectral peaks.

Bytes become 8-bit mono samples of a WAV file. A short-time Fourier transform of what is read back gives peaks, bins that are
the greatest of their neighbourhood in time and frequency. Frames overlap by three quarters, so every sample has weight in
some frame and a shift moves the frames by half a hop at most. Each peak is paired with all peaks of later frames over a span, and
a pair is stored as one long: time, both bins, and the time between.

Results for odd input: null and empty texts are 64 bytes of zero; silence has no peaks; equal texts have equal values; very
long payloads are transformed in blocks of frames; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import OWN, materialize

UNIT, RATE = 64, 8000
FRAME, HOP, BLOCK = 256, 64, 4096
#: A peak is the greatest within so many bins to either side and one frame; pairs reach over SPAN frames, to any number of peaks.
BINS, FAN, SPAN = 8, math.inf, 16
#: Peaks whose partners are listed at once.
PEAKS = 4096


def store(payload: bytes) -> bytes:
    """payload as the samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of the unit."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def spectrum(samples: np.ndarray, start: int, end: int) -> np.ndarray:
    """Magnitudes of frames [start, end), windowed; samples behind the end are silence."""
    part = samples[start * HOP : (end - 1) * HOP + FRAME].astype(np.float32) - 128
    need = (end - start - 1) * HOP + FRAME
    if len(part) < need:
        part = np.concatenate([part, np.zeros(need - len(part), dtype=np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32)


def _greatest(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Running maximum over `reach` neighbours to either side, in steps that double."""
    width, done = 2 * reach + 1, 1
    edge = [(0, 0), (0, 0)]
    edge[axis] = (reach, reach)
    x = np.pad(x, edge)
    cut = lambda a, b: x[a:b] if axis == 0 else x[:, a:b]
    while done < width:
        step = min(done, width - done)
        n = x.shape[axis]
        x = np.maximum(cut(0, n - step), cut(step, n))
        done += step
    return x


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the peaks by time and frequency. Blocks overlap by a frame, so their borders show nowhere."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for start in range(0, n, BLOCK):
        end = min(n, start + BLOCK)
        low, high = max(0, start - 1), min(n, end + 1)
        level = spectrum(samples, low, high)
        top = _greatest(_greatest(level, BINS, 1), 1, 0)
        t, f = np.nonzero((level == top)[start - low : end - low] & (level[start - low : end - low] > 1))
        times.append(t + start)
        bins.append(f)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(media: bytes) -> np.ndarray:
    """Time-coded pairs of peaks of a stored file: time << 32 | bin << 20 | other bin << 8 | frames between."""
    t, f = peaks(np.frombuffer(load(media), np.uint8))
    first, last = np.searchsorted(t, t, side="right"), np.searchsorted(t, t + SPAN, side="right")
    found = [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(t), PEAKS):
        n = (last - first)[i : i + PEAKS]
        left = np.repeat(np.arange(i, i + len(n)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i : i + PEAKS], n)
        found.append(t[left] << 32 | f[left] << 20 | f[right] << 8 | t[right] - t[left])
    return np.sort(np.concatenate(found)).astype(np.int64)


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_bytes and media: each text's bytes as a stored WAV file."""
    import pyarrow as pa

    columns = list(keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_bytes bigint, media binary"

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                raw = [x or b"" for x in batch.column(len(columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(columns))] + [pa.array([len(x) for x in raw], pa.int64()), pa.array([store(pad(x)) for x in raw], pa.binary())], names=[*columns, "n_bytes", "media"])

    return docs.select(*columns, F.col(text).cast("string").cast("binary").alias(OWN + "raw")).mapInArrow(run, schema)


def store_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode(), written to the shared folder and read back."""
    return materialize(encode(docs, text, keep), "media")


def decode(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns in keep with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and fingerprints array<bigint>, all from the media column."""
    import pyarrow as pa

    columns = list(keep)
    more = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, fingerprints array<bigint>"
    schema = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in columns) + ", " + more
    names = [x.split()[0] for x in more.split(", ")]

    def one(media: bytes):
        payload = load(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(media)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 32):
                batch = whole.slice(i, 32)
                *found, prints = zip(*(one(x.as_py()) for x in batch.column(len(columns))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prints)]), pa.int32()), pa.array(np.concatenate(prints)))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(columns))] + [pa.array(x, kind) for x, kind in zip(found, kinds)] + [lists], names=[*columns, *names])

    return stored.select(*columns, "media").mapInArrow(run, schema)
