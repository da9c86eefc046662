"""Descriptors of media: MFCC frames of WAV audio in numpy, numbers as one-dimensional descriptors, and any other extractor
that a caller plugs in (images, faces). Descriptors come out as arrays and go on to ``knn.quantize`` and ``knn.bow_tfidf``.

Files that can't be read have null descriptors: one broken file doesn't end a job.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError

# fixed values: sample rate, coefficients, window and step of the frames
RATE, COEFFICIENTS, WINDOW, STEP, BANDS = 22050, 20, 2048, 512, 128
KINDS = {"image": (".jpg", ".jpeg", ".png"), "audio": (".wav", ".mp3"), "text": (".txt",)}


def kind_of(path: Column) -> Column:
    """image, audio or text by a path's extension; null for others."""
    low, out = F.lower(path), None
    for kind, ends in KINDS.items():
        hit = F.lit(False)
        for e in ends:
            hit = hit | low.endswith(e)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


@cache
def _mel() -> np.ndarray:
    """Triangular bands, evenly spaced in mel and of equal area."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f, float) / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(RATE / 2), BANDS + 2) / 2595) - 1)
    freq = np.linspace(0, RATE / 2, WINDOW // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freq - low) / (mid - low), (high - freq) / (high - mid))) * (2 / (high - low))


@cache
def _cosines() -> np.ndarray:
    """Orthonormal DCT-II of the bands."""
    k, n = np.arange(COEFFICIENTS)[:, None], np.arange(BANDS)[None]
    return np.cos(np.pi * k * (n + 0.5) / BANDS) * np.where(k == 0, np.sqrt(1 / BANDS), np.sqrt(2 / BANDS))


def mfcc(signal: np.ndarray) -> np.ndarray:
    """Frames (n, COEFFICIENTS) of a signal at RATE, centred, the ends padded by silence."""
    padded = np.pad(np.asarray(signal, float), WINDOW // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP] * np.hanning(WINDOW + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    loud = 10 * np.log10(np.maximum(1e-10, power @ _mel().T))
    return np.maximum(loud, loud.max() - 80) @ _cosines().T


def read_wav(content: bytes) -> np.ndarray:
    """One channel at RATE, between -1 and 1."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (8 * width - 1)
    else:
        raise QueryError(f"samples of {8 * width} bits are not read")
    x = x.reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        at = np.arange(int(len(x) * RATE / rate)) * rate / RATE
        x = np.interp(at, np.arange(len(x)), x)
    return x


def _or_none(f: Callable[[bytes], np.ndarray], content) -> list | None:
    try:
        return np.asarray(f(bytes(content)), np.float32).tolist()
    except Exception:  # an extractor may fail in any way on a broken file
        return None


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def wav_frames(content: pd.Series) -> pd.Series:
    """MFCC frames of WAV files' bytes; null for a file that is none."""
    return content.map(lambda b: None if b is None else _or_none(lambda c: mfcc(read_wav(c)), b))


def numeric(value: Column) -> Column:
    """A number, or an array of them, as one descriptor each."""
    return F.transform(F.array(value), lambda x: F.array(x.cast("float")))


def extract(df: DataFrame, content: str, make: Callable[[], Callable[[bytes], np.ndarray]], dim: int, alias: str = "embedding") -> DataFrame:
    """``df`` with an L2-normalised embedding of each file's bytes; ``make`` builds the extractor once a task (a model, say).

    Null where the extractor fails, finds nothing, or gives another dimension.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(alias, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()

        def one(b):
            v = None if b is None else _or_none(extractor, b)
            n = 0 if v is None or len(v) != dim else float(np.linalg.norm(v))
            return (np.array(v, np.float32) / n).tolist() if n and np.isfinite(n) else None

        for pdf in batches:
            yield pdf.assign(**{alias: [one(b) for b in pdf[content]]})

    return df.mapInPandas(run, schema)


def segment_vectors(words: DataFrame, keys: list[str], position: str, word: str, n_words: int) -> DataFrame:
    """(keys, vector): a TF-IDF histogram of quantised frames for each half of a segment, joined and L2-normalised.

    ``words``: a row for each frame, with its place in the segment.
    """
    from pyspark.sql import Window

    half = F.when(F.col(position) * 2 < F.count(F.lit(1)).over(Window.partitionBy(*keys)), 0).otherwise(1)
    counts = words.withColumn("_h", half).groupBy(*keys, "_h", word).agg(F.count(F.lit(1)).alias("_c"))
    df = words.select(*keys, word).distinct().groupBy(word).agg(F.count(F.lit(1)).alias("_df"))
    n = words.select(*keys).distinct().agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_c").over(Window.partitionBy(*keys, "_h"))
    weighted = counts.withColumn("_t", total).join(df, word).crossJoin(F.broadcast(n)).withColumn("_w", F.col("_c") / F.col("_t") * (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1))
    place = F.col("_h") * n_words + F.col(word)
    bag = weighted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), F.col("_w")))).alias("_m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(2 * n_words - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return bag.withColumn("_v", raw).select(*keys, F.transform("_v", lambda x: x / norm).alias("vector"))
