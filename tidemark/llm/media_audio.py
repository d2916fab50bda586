"""Media columns: texts or other payloads as 8-bit audio, and features of it.

The payload is stored as the samples of a mono 8-bit WAV file and read back from those bytes. Features are computed from what was
read: the samples are resampled with a polyphase filter, cut into overlapping frames, and turned into log energies of mel bands;
frames whose energy rises over a high threshold open a segment, which lasts until the energy falls under a low one. The frames of
all segments are tiled with patches of a fixed shape, which are stored as an Arrow tensor column beside their time spans, and read again
for the digest.

Everything is computed document by document in blocks of a fixed length, so equal payloads give equal features wherever they are
computed, and memory for one document is bounded by its samples. Resampling is integer arithmetic and the bands are summed in double precision, so that
machines whose libraries add in different orders agree on the rounded features. Null payloads are empty: 64 zero bytes, which hold no segment.
Repeated rows each get their own row; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, table

UNIT, RATE, UP, DOWN = 64, 12_000, 2, 3
FRAME, HOP, FFT, MELS, PATCH = 200, 80, 256, 32, 64
#: Decibels over a document's median frame energy at which a segment opens and closes.
OPEN_DB, CLOSE_DB, FLOOR = 0.5, -0.5, 1e-6
#: Filter taps are integers in this unit, so that resampling is exact on any machine.
TAP_UNIT = 1 << 15
#: Samples and frames that are computed at once.
SAMPLE_BLOCK, FRAME_BLOCK = 1 << 18, 2048


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload with zero bytes up to a positive multiple of unit."""
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of mono 8-bit PCM samples."""
    data = struct.pack("<4sI", b"data", len(samples)) + samples + bytes(len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """The samples and the rate that a stored file holds."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif name == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(4)
def low_pass(up: int, down: int, zeros: int = 8) -> np.ndarray:
    """Windowed sinc at the lower of the two Nyquist rates, one row for each phase; taps[p, k] / TAP_UNIT weighs the input k samples back."""
    half = zeros * max(up, down)
    t = np.arange(-half, half + 1) / max(up, down)
    h = np.sinc(t) * np.kaiser(len(t), 8.0)
    h *= up / h.sum()
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return np.rint(h.reshape(-1, up).T * TAP_UNIT).astype(np.int32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Integer samples x at up/down times their rate, in units of 1 / TAP_UNIT: output n is the inner product of one filter phase with the samples around n * down / up."""
    taps = low_pass(up, down)
    width, delay = taps.shape[1], 8 * max(up, down)
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out, np.int32)
    for start in range(0, n_out, SAMPLE_BLOCK - SAMPLE_BLOCK % up):
        stop = min(n_out, start + SAMPLE_BLOCK - SAMPLE_BLOCK % up)
        low = (start * down + delay) // up - width
        high = ((stop - 1) * down + delay) // up + 1
        part = np.zeros(high - low, np.int32)
        a, b = max(low, 0), min(high, len(x))
        if a < b:
            part[a - low : b - low] = x[a:b]
        for r in range(min(up, stop - start)):
            n = np.arange(start + r, stop, up)
            phase, first = (n[0] * down + delay) % up, (n[0] * down + delay) // up - low
            total = np.zeros(len(n), np.int32)
            for k in range(width):
                total += taps[phase, k] * part[first - k : first - k + (len(n) - 1) * down + 1 : down]
            out[start + r : stop : up] = total
    return out


@lru_cache(4)
def mel_bands(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular bands, evenly spaced in mel from 0 to half the rate; one column each."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log band energies [frames, MELS] and frame energies in decibels, of overlapping windowed frames; the last one is filled with zeros."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y))])
    frames = np.lib.stride_tricks.as_strided(y, (n, FRAME), (y.strides[0] * HOP, y.strides[0]))
    window, bands = np.hanning(FRAME), mel_bands(rate)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n)
    for a in range(0, n, FRAME_BLOCK):
        f = frames[a : a + FRAME_BLOCK] * window
        spectrum = np.fft.rfft(f, FFT, axis=1)
        mel[a : a + FRAME_BLOCK] = np.log((spectrum.real**2 + spectrum.imag**2) @ bands + FLOOR)
        energy[a : a + FRAME_BLOCK] = 10 * np.log10((f * f).mean(axis=1) + FLOOR)
    return mel, energy


def segments(energy: np.ndarray, high: float = OPEN_DB, low: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frame ranges [start, end) by hysteresis around the median energy. Between the thresholds the state stays as it was."""
    level = np.median(energy)
    mark = np.where(energy > level + high, 1, np.where(energy < level + low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray, spans: list[tuple[int, int]], frame_s: float) -> pa.RecordBatch:
    """All frames of the segments as patches of PATCH frames; the last patch of a segment is filled with the floor."""
    tiles, starts, ends = [], [], []
    for a, b in spans:
        for at in range(a, b, PATCH):
            end = min(b, at + PATCH)
            tile = np.full((PATCH, MELS), np.log(np.float32(FLOOR)), np.float32)
            tile[: end - at] = mel[at:end]
            tiles.append(tile)
            starts.append(at * frame_s)
            ends.append(end * frame_s)
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
    flat = pa.array(np.concatenate([t.ravel() for t in tiles]) if tiles else np.empty(0, np.float32))
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))
    return pa.RecordBatch.from_arrays([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), column], names=["start_s", "end_s", "log_mel"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def features(stored: bytes) -> tuple[pa.RecordBatch, int]:
    """The tensors of a stored file, and its number of frames."""
    samples, rate = from_wav(stored)
    y = resample(np.frombuffer(samples, np.uint8).astype(np.int32) - 128)
    mel, energy = log_mel(y / (128.0 * TAP_UNIT), rate * UP // DOWN)
    return tensors(mel, segments(energy), HOP * DOWN / UP / rate), len(mel)


def digest(stored: bytes) -> str:
    """Frames, patches, seconds in segments, mean and checksum of the stored tensors, rounded to hundredths."""
    batch, frames = features(stored)
    back = from_ipc(to_ipc(batch))
    log_mels = back["log_mel"].combine_chunks()
    values = np.concatenate([c.storage.flatten().to_numpy() for c in (log_mels.chunks if isinstance(log_mels, pa.ChunkedArray) else [log_mels])] or [np.empty(0, np.float32)])
    rounded = np.round(values * 100).astype("<i4")
    span = sum(back["end_s"].to_pylist()) - sum(back["start_s"].to_pylist())
    mean = float(rounded.mean(dtype=np.float64)) / 100 if len(rounded) else 0.0
    return f"frames={frames};patches={back.num_rows};voiced_s={span:.3f};mean={mean:.2f};crc={zlib.crc32(rounded.tobytes()):08x}"


def media(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text", with_tensors: bool = False) -> DataFrame:
    """One row for each row of docs: its id, sizes and checksums of the payload as read back, of the stored form, and the features' digest.

    with_tensors adds the stored file (media) and the tensors with their time spans as an Arrow stream (tensors).
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[payload_col].cast("binary").alias("payload"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [p or b"" for p in batch.column("payload").to_pylist()]
            stored = [to_wav(padded(p)) for p in raw]
            read = [from_wav(s)[0] for s in stored]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(p) for p in raw], pa.int64()),
                "payload_bytes": pa.array([len(p) for p in read], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in read], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p in read], pa.int64()),
                "media_bytes": pa.array([len(s) for s in stored], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in stored], pa.string()),
                "feature": pa.array([digest(s) for s in stored], pa.string()),
            }
            if with_tensors:
                columns |= {"media": pa.array(stored, pa.binary()), "tensors": pa.array([to_ipc(features(s)[0]) for s in stored], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        return one

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(rows, make, schema + ", media binary, tensors binary" * with_tensors, 128)


def op1_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
