"""Media columns: telephony audio in WAV containers.

A payload of bytes is held as mu-law or A-law samples (a byte each) or as the data of IMA ADPCM blocks
(64 bytes, two samples a byte, after a header of 4). Companded samples expand by lookup tables; ADPCM blocks
are decoded side by side, one numpy step for the n-th code of every block of a slice. Decoded sound is
resampled by a windowed sinc (in phases, cut off below the lower rate) and kept as 16-bit PCM in a column of the result. Null texts count as empty; an empty text is one block of zero bytes.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from siftwell.llm._arrow import with_columns

BLOCK = 64
RATE = 8000
#: Old samples on either side that a new one is made of, and the form of the window.
REACH, BETA = 8, 7.0
#: Samples whose windows are held at once.
PIECE = 1 << 16
MU_LAW, A_LAW, IMA = "mulaw", "alaw", "ima"
#: WAVE format tags.
TAGS = {A_LAW: 6, MU_LAW: 7, IMA: 17}
#: Fixed values of the IMA ADPCM standard: quantiser steps, and how an index moves by a code's low three bits.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """Linear samples of the 256 mu-law codes (ITU-T G.711)."""
    c = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear samples of the 256 A-law codes (ITU-T G.711)."""
    c = np.arange(256, dtype=np.int32) ^ 0x55
    e = c >> 4 & 7
    size = np.where(e == 0, ((c & 15) << 4) + 8, ((c & 15) << 4) + 264 << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def pad(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def to_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """payload, a positive multiple of 64 bytes, as a WAV file."""
    if codec == IMA:
        n = len(payload) // BLOCK
        blocks = np.zeros((n, BLOCK + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
        data, per = blocks.tobytes(), 2 * BLOCK + 1
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * (BLOCK + 4) // per, BLOCK + 4, 4, 2, per)
        samples = n * per
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    rest = b"".join((b"WAVEfmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, samples), b"data", struct.pack("<I", len(data)), data))
    return b"".join((b"RIFF", struct.pack("<I", len(rest)), rest))


def from_wav(media: bytes) -> tuple[str, int, np.ndarray]:
    """Codec, rate and the bytes of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            codec = next((k for k, v in TAGS.items() if v == tag), None)
            if codec is None:
                raise ValueError(f"format {tag} is not a telephony format")
            return codec, rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * data bytes) of IMA ADPCM blocks, a row each."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0], now = head, head
    for i, byte in enumerate(data):
        for half, code in enumerate((byte & 15, byte >> 4)):
            code = code.astype(np.int32)
            step = STEPS[index]
            by = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            now = np.clip(now + np.where(code & 8, -by, by), -32768, 32767)
            index = np.clip(index + MOVES[code & 7], 0, 88)
            out[1 + 2 * i + half] = now
    return np.ascontiguousarray(out.T)


def decode(media: list[bytes]) -> tuple[list[np.ndarray], list[bytes], list[str], list[int]]:
    """Of each WAV file: 16-bit samples at its own rate, its payload, codec and rate."""
    parts = [from_wav(m) for m in media]
    samples: list = [None] * len(parts)
    payload = [d.tobytes() for _, _, d in parts]
    for codec, lut in TABLES.items():
        for i, (c, _, d) in enumerate(parts):
            if c == codec:
                samples[i] = lut[d]
    own = [i for i, (c, _, _) in enumerate(parts) if c == IMA]
    if own:
        blocks = [parts[i][2].reshape(-1, BLOCK + 4) for i in own]
        every = np.concatenate(blocks)
        sound, at = decode_ima(every), 0
        for i, b in zip(own, blocks):
            samples[i] = sound[at : at + len(b)].reshape(-1)
            payload[i] = b[:, 4:].tobytes()
            at += len(b)
    return samples, payload, [c for c, _, _ in parts], [r for _, r, _ in parts]


@cache
def phases(rate: int, to: int) -> np.ndarray:
    """Filters (phases, 2 * REACH) for the places between two samples at which new samples stand: sinc under a Kaiser window, each of sum 1."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    cut = min(1.0, up / down)
    at = np.arange(1 - REACH, REACH + 1)[None, :] - (np.arange(up) / up)[:, None]
    h = np.sinc(at * cut) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (at / REACH) ** 2)))
    return h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate; sound goes on before and after as its first and last sample."""
    if rate == to or not len(x):
        return x
    h, g = phases(rate, to), gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.full(REACH - 1, x[0]), x, np.full(REACH, x[-1])]).astype(np.float32)
    out = np.empty(n, np.float32)
    for p in range(min(up, n)):
        # New samples p, p + up, ... stand the same part of a step behind an old one, down old ones apart.
        first, part = divmod(p * down, up)
        own, taps = len(out[p::up]), h[part].astype(np.float32)
        if down == 1:
            out[p::up] = np.correlate(padded, taps, "valid")[first : first + own]
            continue
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[first::down]
        for lo in range(0, own, PIECE):
            out[p::up][lo : lo + PIECE] = windows[lo : min(lo + PIECE, own)] @ taps
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def describe(x: np.ndarray, codec: str, rate: int) -> str:
    y = x.astype(np.int32)
    power = int(np.dot(y.astype(np.float64), y)) / max(len(y), 1)
    crossings = int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
    return f"{codec};rate={rate};samples={len(y)};peak={int(np.abs(y).max(initial=0))};rms={power ** 0.5:.3f};crossings={crossings}"


def store(df: DataFrame, text: str = "text", media: str = "media", codec: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with texts as WAV files, in codec, or one of the three by the payload's checksum."""

    def run(texts):
        out = []
        for t in texts.to_pylist():
            p = pad((t or "").encode("utf-8", "replace"))
            out.append(to_wav(p, codec or (MU_LAW, A_LAW, IMA)[zlib.crc32(p) % 3]))
        return [pa.array(out, pa.binary())]

    return with_columns(df, text, [StructField(media, BinaryType())], run, keep)


def read(df: DataFrame, media: str = "media", rate: int = 16000, pcm: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df with payload (the bytes that were stored) and feature, and with pcm the resampled 16-bit samples.

    A null media column gives nulls.
    """

    def run(column):
        files = column.to_pylist()
        there = [i for i, m in enumerate(files) if m is not None]
        samples, payload, codecs, rates = decode([files[i] for i in there])
        out: list[list] = [[None] * len(files) for _ in range(3)]
        for j, i in enumerate(there):
            y = resample(samples[j], rates[j], rate)
            out[0][i], out[1][i] = payload[j], describe(y, codecs[j], rate)
            if pcm:
                out[2][i] = y.astype("<i2").tobytes()
        return [pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), *([pa.array(out[2], pa.binary())] if pcm else [])]

    fields = [StructField("payload", BinaryType()), StructField("feature", StringType())]
    return with_columns(df, media, fields + [StructField("pcm", BinaryType())] * pcm, run, keep, 1 << 20)
