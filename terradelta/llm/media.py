"""Operator 1: media columns. Texts as WAV files in a binary column, and spectral-peak fingerprints of WAV columns.

``store_wav`` writes a payload as 8-bit mono samples with the ``wave`` module; ``read_wav`` opens the stored bytes
again, takes short-time Fourier transforms over them and pairs spectral peaks to fingerprints, kept as two arrays of
equal length: ``fp_time`` (frame number of the first peak) and ``fp_hash`` (first bin, second bin, distance in frames).

Frames are centred on every HOP-th sample from the first to the end, with both ends mirrored, so that each sample lies
in several frames with weight and a payload of one unit has pairs.

Defined results: a null or empty text gives one unit of spaces, and samples that are all equal have no pairs; equal texts give equal bytes and fingerprints; a text
of any length is worked on in blocks of frames, so memory beyond the file itself is bounded; null in a WAV column gives
null in all that is read from it; extra columns pass through and win no name clash (the operator's own names are
checked against them).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lone, utf8

UNIT = 192
RATE = 8000
FRAME, HOP = 256, 64
#: Frames transformed at once.
BLOCK = 4096
#: Bands of frequency bins; the strongest bin of each band in a frame is a peak if it stands out of that frame.
BANDS = ((1, 8), (8, 20), (20, 40), (40, 72), (72, 129))
#: A peak's partners: itself, and the next frames' peaks of the following bands.
FAN = 2
STANDS_OUT = 2.0

WAV_COLUMNS = "n_bytes long, wav binary"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_time array<int>, fp_hash array<int>"


def to_wav(text: bytes) -> bytes:
    """The payload (text, then spaces up to a positive multiple of UNIT) as a WAV file of unsigned 8-bit samples."""
    payload = text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band: the strongest bin, and whether it is a peak."""
    x = samples if len(samples) else np.full(1, 128, np.uint8)
    x = np.pad(x, (FRAME // 2, FRAME // 2 + -len(x) % HOP), "reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, strong = [], []
    for at in range(0, len(frames), BLOCK):
        block = frames[at : at + BLOCK].astype(np.float32)
        block = (block - block.mean(axis=1, keepdims=True)) * _WINDOW
        power = np.square(np.abs(np.fft.rfft(block, axis=1))).astype(np.float32)
        mean = power.mean(axis=1)
        top = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        high = np.take_along_axis(power, top, axis=1)
        bins.append(top.astype(np.int32))
        strong.append(high > STANDS_OUT * mean[:, None])
    return np.concatenate(bins), np.concatenate(strong)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of peaks, coded by time: frame numbers in ascending order, and a hash of bins and distance for each."""
    bins, strong = peaks(samples)
    n, bands = bins.shape
    times, hashes = [], []
    for d in range(FAN + 1):
        if n <= d:
            break
        for b in range(bands):
            c = (b + d) % bands
            at = np.flatnonzero(strong[: n - d, b] & strong[d:, c])
            times.append(at)
            hashes.append((bins[at, b] << 16) | (bins[at + d, c] << 4) | d)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.int32()))


def _with(df: DataFrame, columns: str, step) -> DataFrame:
    """``df`` with further columns that ``step`` makes of each Arrow batch."""
    more = T._parse_datatype_string(columns)
    if clash := {x.lower() for x in df.columns} & {f.name.lower() for f in more}:
        raise ValueError(f"these columns exist already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time, as the files of long texts are long
        for part in lone(batches, "media", 256):
            made = step(part)
            yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))


def store_wav(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8 bytes of the text) and ``wav`` (its WAV file)."""

    def step(batch: pa.RecordBatch) -> dict:
        raw = list(utf8(batch, text))
        return {"n_bytes": pa.array([len(x) for x in raw], pa.int64()), "wav": pa.array([to_wav(x) for x in raw], pa.binary())}

    return _with(df, WAV_COLUMNS, step)


def read_wav(df: DataFrame, wav: str = "wav") -> DataFrame:
    """Adds what the stored files hold: sizes and digests of payload and file, and the fingerprint arrays."""

    def step(batch: pa.RecordBatch) -> dict:
        rows, t, h, gone = [], [], [], []
        for data in batch.column(batch.schema.get_field_index(wav)):
            data = data.as_py()
            gone.append(data is None)
            if data is None:
                rows.append((None,) * 5)
                a = b = np.zeros(0, np.int32)
            else:
                payload = from_wav(data)
                a, b = fingerprint(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest()))
            t.append(a)
            h.append(b)
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        made = {n: pa.array(c, k) for n, c, k in zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"), columns, kinds, strict=True)}
        return made | {"fp_time": _lists(t), "fp_hash": _lists(h)}

    return _with(df, READ, step)


def op1_media(docs: DataFrame) -> DataFrame:
    """Every document stored as WAV, read back, with digests; ``feature`` digests its fingerprint arrays."""
    kept = read_wav(store_wav(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "wav"))
    coded = F.concat_ws(";", F.concat_ws(",", F.col("fp_time").cast("array<string>")), F.concat_ws(",", F.col("fp_hash").cast("array<string>")))
    return kept.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat(F.size("fp_hash").cast("string"), F.lit(":"), F.md5(coded)).alias("feature"),
        F.size("fp_hash").cast("long").alias("n_pairs"),
    )
