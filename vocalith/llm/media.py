"""Media columns (operator 8): bytes kept as 8-bit audio, and audio features as fixed-shape Arrow tensors.

A payload is stored losslessly as the samples of a mono 8-bit PCM WAV file. Features: polyphase resampling to half the
rate by a windowed-sinc filter of which only the kept outputs are computed; overlapping Hann frames of 25 ms every
10 ms; log-mel energies by a triangular filter bank; segments by hysteresis on frame energy (a segment opens above the
high threshold and lasts until the energy falls below the low one). The log-mel frames are cut into tensors of
``TENSOR_FRAMES`` x ``MELS`` (the last one padded with silence) and kept, with their time spans, in an Arrow IPC
stream whose column has the type fixed_shape_tensor.

Nulls and edge cases: a null or empty text is 64 zero bytes; equal texts give equal values; repeated rows give repeated
rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

RATE, DOWN = 16_000, 2
TAPS = 24
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
TENSOR_FRAMES = 64
#: Frames computed at a time.
BLOCK_FRAMES = 4096
#: Frames after which a stream of tensors of several texts is closed.
STREAM_FRAMES = 1 << 15
#: Hysteresis thresholds as shares of the way from the quietest to the loudest frame.
HIGH, LOW = 0.6, 0.4
PAD = 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % PAD if data else PAD)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit PCM samples."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + bytes(n % 2)


def from_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of such a file, found by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.lru_cache(1)
def _kernel() -> np.ndarray:
    """A low-pass filter with its cut-off at the new Nyquist rate, reversed for correlation."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(TAPS)
    return (h / h.sum()).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Every DOWN-th output of the filter: phases of the input times phases of the kernel."""
    n = -(-len(x) // DOWN)
    padded = np.zeros((n + TAPS) * DOWN, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    phases, kernel = padded.reshape(-1, DOWN), _kernel().reshape(-1, DOWN)
    out = np.zeros(n, np.float32)
    for k in range(len(kernel)):
        for p in range(DOWN):
            out += kernel[k, p] * phases[k : k + n, p]
    return out


@functools.lru_cache(1)
def _bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel: FFT bins x MELS."""
    rate = RATE // DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * rate / FFT
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, energy of each frame in dB)."""
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, mels, energy = np.hanning(FRAME + 1)[:-1].astype(np.float32), [], []
    for i in range(0, n, BLOCK_FRAMES):
        part = frames[i : i + BLOCK_FRAMES] * window
        power = np.abs(np.fft.rfft(part, FFT, axis=1)).astype(np.float32) ** 2
        mels.append(np.log10(power @ _bank() + 1e-6))
        energy.append(10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) frames of the stretches that hysteresis marks as loud."""
    lo, hi = float(energy.min()), float(energy.max())
    if hi - lo < 1e-3:
        return []
    level = (energy - lo) / (hi - lo)
    mark = np.where(level >= HIGH, 1, np.where(level < LOW, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def features(wav: bytes):
    """(log-mel frames, energy, segments) of a stored file."""
    _, samples = from_wav(wav)
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mels, energy = log_mel(x)
    return mels, energy, segments(energy)


def tensors(many: list[np.ndarray]) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with item (place in ``many``), start_ms, end_ms."""
    counts = [-(-len(m) // TENSOR_FRAMES) for m in many]
    n, at = sum(counts), 0
    padded = np.full((n * TENSOR_FRAMES, MELS), -6, np.float32)
    for m, c in zip(many, counts):
        padded[at : at + len(m)] = m
        at += c * TENSOR_FRAMES
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, TENSOR_FRAMES, MELS))
    step = TENSOR_FRAMES * HOP * 1000 * DOWN // RATE
    start = np.concatenate([np.arange(c, dtype=np.int64) for c in counts]) * step
    table = pa.table({"item": np.repeat(np.arange(len(many)), counts), "start_ms": start, "end_ms": start + step, "log_mel": column})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def frames_of(stream: bytes) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """(frames x MELS, padding included; (start_ms, end_ms) of every tensor) of each item of such a stream."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    kept = table["log_mel"].chunk(0).to_numpy_ndarray()
    spans = list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist()))
    firsts = np.flatnonzero(np.diff(table["item"].to_numpy(), prepend=-1)).tolist() + [len(spans)]
    return [(kept[a:b].reshape(-1, MELS), spans[a:b]) for a, b in zip(firsts, firsts[1:])]


def feature_texts(wavs: list[bytes]) -> list[str]:
    """The features in short of stored files, whose frames are read back from one stream of tensors."""
    made = [features(w) for w in wavs]
    return [feature_text(kept[: len(m)], e, found, spans) for (m, e, found), (kept, spans) in zip(made, frames_of(tensors([m for m, _, _ in made])))] if made else []


def feature_text(mels: np.ndarray, energy: np.ndarray, found: list[tuple[int, int]], spans_ms: list[tuple[int, int]]) -> str:
    """The features in short: sizes, mean log-mel per band, energy, segments, and a digest of the rounded frames."""
    bands = ",".join(f"{round(float(v) * 10)}" for v in mels.mean(axis=0))
    spans = hashlib.md5(repr(found).encode()).hexdigest()[:12]
    frames = zlib.crc32(np.round(mels * 4).astype("<i2").tobytes())
    return f"frames={len(mels)};mels={MELS};bands={bands};db={round(float(energy.mean()), 1)};segments={len(found)}:{spans};frames_crc32={frames};tensors={len(spans_ms)};end_ms={spans_ms[-1][1]}"


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded), media: every text as a WAV file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [payload_of(x.as_py()) for x in part.column(1)]
                yield batch(schema, doc_id=part.column(0), n_bytes=[n for n, _ in made], media=[to_wav(p) for _, p in made])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, log_mel (Arrow IPC bytes of fixed-shape tensors with time spans), segments (start_ms, end_ms)."""
    span = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("log_mel", pa.binary()), ("segments", pa.list_(span))])
    ms = HOP * 1000 * DOWN // RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = [features(x.as_py()) for x in part.column(1)]
                yield batch(schema, doc_id=part.column(0), log_mel=[tensors([m]) for m, _, _ in got], segments=[[{"start_ms": s * ms, "end_ms": e * ms} for s, e in f] for _, _, f in got])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, log_mel binary, segments array<struct<start_ms: bigint, end_ms: bigint>>")


def digests(media: DataFrame) -> DataFrame:
    """Reads stored media back: payload digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, held, size = [], [], [], 0
            for x in b.column(2):
                wav = x.as_py()
                payload = from_wav(wav)[1]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest()))
                held.append(wav)
                size += max(TENSOR_FRAMES, len(payload) // (DOWN * HOP))
                if size >= STREAM_FRAMES:
                    texts += feature_texts(held)
                    held, size = [], 0
            texts += feature_texts(held)
            rows = [(*r, t) for r, t in zip(rows, texts)]
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield batch(_OUT, doc_id=b.column(0), n_bytes=b.column(1), **{c: [r[i] for r in rows] for i, c in enumerate(names)})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
