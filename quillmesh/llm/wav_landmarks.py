"""Media columns: texts' bytes as 8-bit WAV, read back, and spectral-peak pair fingerprints as time-coded arrays.

The payload is the text's UTF-8 bytes with bytes 255 appended up to a positive multiple of ``UNIT``. The wave module
writes it as mono unsigned 8-bit samples and reads the samples back. A short-time Fourier transform (Hann window of
``UNIT`` samples, steps of half that) gives magnitudes; in each frame the strongest bin of each of ``BANDS`` bands that
exceeds twice the band's mean is a peak, and each peak is paired with the higher ones of its frame and those of the next ``REACH`` frames. A pair's code is
frame number << 32 | band bins and time distance; the sorted codes are the fingerprint.

Defined cases: a null text is empty (one unit of bytes 255, no peaks). Equal texts give equal values. Ids may be null or
repeated; only the id and text columns are read. Frames are transformed in blocks, so memory is bounded for long texts.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from quillmesh.llm.common import map_rows

UNIT, RATE = 576, 8000
BANDS, REACH = 4, 3
BLOCK_FRAMES = 512


def payload(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes, size: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame and band: the strongest bin, and whether it stands out."""
    wave_form = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(wave_form, size)[:: size // 2]
    window = np.hanning(size).astype(np.float32)
    width = (size // 2) // BANDS
    bins = np.empty((len(frames), BANDS), np.int64)
    clear = np.empty((len(frames), BANDS), bool)
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = (frames[at : at + BLOCK_FRAMES].astype(np.float32) - 128) * window
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part, axis=1))[:, 1 : 1 + width * BANDS].reshape(len(part), BANDS, width)
        best = power.argmax(axis=2)
        top = np.take_along_axis(power, best[:, :, None], axis=2)[:, :, 0]
        bins[at : at + len(part)] = best + 1 + np.arange(BANDS) * width
        clear[at : at + len(part)] = top > np.maximum(2 * power.mean(axis=2), 1e-3)
    return bins, clear


def landmarks(samples: bytes, size: int = UNIT) -> np.ndarray:
    """Sorted time-coded pairs: frame << 32 | first bin << 18 | second bin << 4 | distance in frames."""
    bins, clear = peaks(samples, size)
    codes = []
    for gap in range(min(REACH, len(bins) - 1) + 1):
        first, second = bins[: len(bins) - gap, :, None], bins[gap:, None, :]
        both = clear[: len(bins) - gap, :, None] & clear[gap:, None, :] & (gap > 0 or first < second)
        at = np.arange(len(bins) - gap, dtype=np.int64)[:, None, None]
        codes.append((at << 32 | first << 18 | second << 4 | gap)[both])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def media_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary, landmarks array<bigint>): the media column and its fingerprints."""
    kind = docs.schema[id_column].dataType.simpleString()

    def rows(source):
        for key, text in source:
            size, data = payload(text)
            media = to_wav(data)
            yield key, size, media, landmarks(from_wav(media)).tolist()

    return map_rows(docs.select(id_column, text_column), rows, f"{id_column} {kind}, n_bytes bigint, media binary, landmarks array<bigint>", flush=100)


def media_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The contract's digests of each document's media column and of its fingerprints."""
    media = media_table(docs, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def rows(source):
        for key, size, stored, marks in source:
            back = from_wav(stored)
            feature = f"{len(marks)}:{hashlib.sha256(np.array(marks, '<i8').tobytes()).hexdigest()[:32]}"
            yield key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    return map_rows(media, rows, f"{id_column} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
