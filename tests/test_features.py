"""Media descriptors."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features, knn


def tone(hz, seconds=1.0, rate=44100, channels=2):
    x = (np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 20000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x[:, None], channels, axis=1).tobytes())
    return out.getvalue()


def test_wav_and_mfcc(spark):
    x = features.read_wav(tone(440))
    assert len(x) == features.RATE and abs(np.abs(np.fft.rfft(x)).argmax() - 440) <= 1
    frames = features.mfcc(x)
    assert frames.shape == (1 + features.RATE // features.STEP, features.COEFFICIENTS)
    same, other = features.mfcc(features.read_wav(tone(440, channels=1))), features.mfcc(features.read_wav(tone(3000)))
    mid = len(frames) // 2
    assert np.linalg.norm(frames[mid] - same[mid]) < 0.1 * np.linalg.norm(frames[mid] - other[mid])
    df = spark.createDataFrame([(1, tone(440)), (2, b"broken"), (3, None)], "id int, content binary")
    got = {r.id: r.f for r in df.select("id", features.wav_frames("content").alias("f")).collect()}
    assert len(got[1]) == len(frames) and got[2] is None and got[3] is None


def test_plugged_extractor(spark):
    df = spark.createDataFrame([(1, b"\x03\x04"), (2, b"\x00\x00"), (3, b"\x01"), (4, None)], "id int, content binary")
    got = {r.id: r.embedding for r in features.extract(df, "content", lambda: lambda b: np.frombuffer(b, np.uint8).astype(float), 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is got[3] is got[4] is None


def test_kinds_and_numbers(spark):
    df = spark.createDataFrame([("a/B.JPG",), ("x.wav",), ("n.txt",), ("z.bin",)], "p string")
    assert [r[0] for r in df.select(features.kind_of(F.col("p"))).collect()] == ["image", "audio", "text", None]
    assert spark.range(1).select(features.numeric(F.lit(3)).alias("d")).first().d == [[3.0]]


def test_segment_vectors(spark):
    rows = [(1, i, w) for i, w in enumerate([0, 0, 1, 1])] + [(2, i, w) for i, w in enumerate([0, 0, 1, 1])] + [(3, i, w) for i, w in enumerate([1, 1, 0, 0])]
    got = {r.seg: np.array(r.vector) for r in features.segment_vectors(spark.createDataFrame(rows, "seg int, at int, word int"), ["seg"], "at", "word", 2).collect()}
    assert got[1] == pytest.approx([1 / 2**0.5, 0, 0, 1 / 2**0.5]) and got[1] @ got[2] == pytest.approx(1) and got[1] @ got[3] == pytest.approx(0)


def test_quantize_and_histogram(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 4, (rng.normal(size=3) + 10 * (i % 2)).tolist()) for i in range(80)]
    words = knn.quantize(spark.createDataFrame(rows, "doc int, d array<double>"), "d", 2)
    got = {}
    for r in knn.bow_tfidf(words, "doc", "word").collect():
        got.setdefault(r.doc, {})[r.word] = r.weight
    assert got[0] == got[2] and got[1] == got[3] and got[0] != got[1]
    assert all(sum(w * w for w in v.values()) == pytest.approx(1) for v in got.values())
