"""Media columns: texts as WAV bytes, short-time Fourier transforms, and fingerprints of spectral peak pairs."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP = 8000, 256, 128
#: Peaks of a frame (its strongest local maxima), and the frames ahead whose peaks a peak is paired with.
PEAKS, AHEAD = 3, 3


def to_wav(data: bytes, unit: int = 64, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples: data and zeros up to a positive multiple of unit."""
    padded = data + bytes(-len(data) % unit or (0 if data else unit))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_HANN = np.hanning(FRAME).astype(np.float32)


def spectral_peaks(samples: bytes, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks of the whole signal, by frame then strength; at_once frames are transformed together."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP))  # silence up to the next full hop
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), at_once):
        power = np.abs(np.fft.rfft(frames[at : at + at_once] * _HANN, axis=1)).astype(np.float32)
        inner = power[:, 2:-1]  # without the steady level
        peak = (inner > power[:, 1:-2]) & (inner >= power[:, 3:])
        inner = np.where(peak, inner, 0)
        best = np.argsort(-inner, axis=1, kind="stable")[:, :PEAKS]
        real = np.take_along_axis(inner, best, 1) > 0
        t, k = np.nonzero(real)
        times.append(t + at)
        bins.append(best[t, k] + 2)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, hash) of pairs of peaks: hash packs bin, later bin and frames between into 8, 8 and 4 bits."""
    t, h = [], []
    # Peaks come PEAKS to a frame at most, so those of the next AHEAD frames are no further on than this.
    for step in range(1, PEAKS * (AHEAD + 1)):
        gap = times[step:] - times[:-step]
        ok = (gap >= 1) & (gap <= AHEAD)
        t.append(times[:-step][ok])
        h.append((bins[:-step][ok].astype(np.int64) << 12) | (bins[step:][ok].astype(np.int64) << 4) | gap[ok])
    t, h = np.concatenate(t), np.concatenate(h)
    order = np.lexsort((h, t))
    return t[order], h[order]


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, hashes array<int>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: id, sizes and digests of the payload and of the WAV, and its time-coded fingerprints.

    times (frames of HOP samples) and hashes run in parallel, by time then hash. Null and empty texts are one unit of
    zeros, which has no peaks and thus empty arrays. Equal texts give equal values; repeated rows and null ids stay;
    other columns aren't looked at. A text is at most a few buffers of its own length in memory. keep_media adds the
    WAV bytes as column media.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        media = to_wav(data)
        back = from_wav(media)
        times, hashes = fingerprints(*spectral_peaks(back))
        row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), times.astype(np.int32), hashes.astype(np.int32))
        return (*row, media) if keep_media else row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")] + ["media"] * keep_media
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = pd.DataFrame([one(t) for t in part["text"]], columns=names)
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, {FIELDS}" + ", media binary" * keep_media).withColumnRenamed("id", id_col)
