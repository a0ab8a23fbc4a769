import hashlib
import struct
import zlib

import numpy as np
import pytest

from siftwell.llm import audio


def slow_ima(block):
    now, index = struct.unpack_from("<hB", bytes(block))
    out = [now]
    for byte in block[4:]:
        for code in (int(byte) & 15, int(byte) >> 4):
            step = int(audio.STEPS[index])
            by = step >> 3
            by += (step >> 2) if code & 1 else 0
            by += (step >> 1) if code & 2 else 0
            by += step if code & 4 else 0
            now = max(-32768, min(32767, now + (-by if code & 8 else by)))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(now)
    return out


def test_tables():
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_ima_matches_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 68)).astype(np.uint8)
    blocks[:, 2] %= 89
    assert audio.decode_ima(blocks).tolist() == [slow_ima(b) for b in blocks]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima"])
def test_round_trip(spark, codec):
    texts = ["", None, "x" * 64, "é" * 33, "long " * 9000, "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in audio.read(audio.store(df, codec=codec), pcm=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert bytes(out[i].payload) == raw + bytes(-len(raw) % 64 if raw else 64)
        assert out[i].feature.startswith(codec) and len(out[i].pcm) == 2 * int(out[i].feature.split("samples=")[1].split(";")[0])
    assert out[2].feature == out[5].feature and out[2].media == out[5].media


def test_empty_table_and_null_media(spark):
    assert audio.store(spark.createDataFrame([], "doc_id long, text string, Media int")).count() == 0
    out = audio.read(spark.createDataFrame([(1, None)], "a int, media binary")).first()
    assert out.payload is None and out.feature is None


def slow_resample(x, rate, to):
    """Each new sample by its own sum."""
    cut, out = min(1.0, to / rate), []
    for n in range(-(-len(x) * to // rate)):
        at = n * rate / to
        i = n * rate // to
        total = norm = 0.0
        for j in range(i - audio.REACH + 1, i + audio.REACH + 1):
            d = j - at
            w = np.sinc(d * cut) * np.i0(audio.BETA * np.sqrt(max(0.0, 1 - (d / audio.REACH) ** 2)))
            total += w * float(x[min(max(j, 0), len(x) - 1)])
            norm += w
        out.append(total / norm)
    return np.clip(np.array(out), -32768, 32767)


@pytest.mark.parametrize("rate,to", [(8000, 16000), (8000, 11025), (11025, 8000), (16000, 8000), (8000, 8000)])
def test_resampling_against_single_sums(rate, to):
    x = np.random.default_rng(2).integers(-30000, 30000, 130).astype(np.int16)
    for y in (x, x[:1], x[:0], np.full(90, 777, np.int16)):
        want = slow_resample(y, rate, to) if len(y) and rate != to else y
        got = audio.resample(y, rate, to)
        assert got.dtype == np.int16 and len(got) == len(want) and (len(y) == 0 or np.abs(got - want).max() <= 0.51)


def test_a_tone_stays_a_tone():
    t = np.arange(4000)
    x = np.rint(12000 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.int16)
    power = np.abs(np.fft.rfft(audio.resample(x, 8000, 16000)[1000:7000] * np.hanning(6000))) ** 2
    own = np.abs(np.arange(len(power)) * 16000 / 6000 - 1000) < 20
    assert power[own].sum() > 1e4 * power[~own].sum()


def test_query_against_single_files(spark):
    """Every digest of the query from the texts, and its samples and features from the stored form, one file after the other."""
    from siftwell.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op8_telephony(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        codec = ("mulaw", "alaw", "ima")[zlib.crc32(padded) % 3]
        media = audio.to_wav(padded, codec)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
    for r in out[:12]:
        padded = (texts[r.doc_id] or "").encode()
        padded += bytes(-len(padded) % 64 if padded else 64)
        codec = r.feature.split(";")[0]
        if codec == "ima":
            samples = np.concatenate([slow_ima(bytes(4) + padded[i : i + 64]) for i in range(0, len(padded), 64)])
        else:
            samples = np.array([audio.TABLES[codec][b] for b in padded])
        got = np.frombuffer(r.pcm, "<i2")
        assert np.abs(got[:80] - slow_resample(samples[:50], 8000, 16000)[:80]).max() <= 0.51
        assert len(got) == 2 * len(samples) and np.array_equal(got[::2], samples) and r.feature == audio.describe(got, codec, 16000)


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (1, "a", 5, "k"), (None, None, None, None)], "doc_id long, text string, MEDIA int, feature string")
    out = audio.read(audio.store(df), pcm=True)
    assert out.columns == ["doc_id", "text", "media", "payload", "feature", "pcm"]
    rows = [tuple(map(str, r)) for r in out.collect()]
    assert rows[0] == rows[1] and len(rows) == 3
