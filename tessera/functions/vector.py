"""Vectors as Column expressions: distances, scores and decoders. Arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_NAMES = {"cosine": "cosine", "cos": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot_product": "dot_product", "dot": "dot_product", "ip": "dot_product", "inner_product": "dot_product"}


def metric_name(name: str) -> str:
    try:
        return METRIC_NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name}") from None


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: 1 - cosine (1 for a zero vector), L2, or the negated inner product."""
    metric = metric_name(metric)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if metric == "dot_product":
        return -dot(a, b)
    na, nb = norm(a), norm(b)
    raw = dot(a, b) / (na * nb)
    sim = F.when(raw > 1, 1.0).when(raw < -1, -1.0).otherwise(raw)
    return F.when((na < 1e-12) | (nb < 1e-12), 1.0).otherwise(1 - sim)


def score(d: Column, metric: str = "cosine") -> Column:
    """Larger is nearer."""
    metric = metric_name(metric)
    if metric == "cosine":
        return 1 - d
    return -d if metric == "dot_product" else 1 / (1 + F.when(d < 0, 0.0).otherwise(d))


def np_distance(q: np.ndarray, x: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Distances of every row of q to every row of x."""
    metric = metric_name(metric)
    if metric == "dot_product":
        return -(q @ x.T)
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T))
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n < 1e-24, 1.0, 1 - np.clip(q @ x.T / n, -1, 1))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector; null if the length is no multiple of four or a component is not finite."""

    def one(b):
        if b is None or len(b) % 4:
            return None
        v = np.frombuffer(b, "<f4")
        return v if np.isfinite(v).all() else None

    return raw.map(one)


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


def from_json(text: Column) -> Column:
    """A JSON list to a vector; null if it is none."""
    return F.from_json(text, "array<float>")


def usable(v: Column, dim: int | None = None) -> Column:
    """A vector without null or non-finite components, of the dimension asked for."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & fine & (F.size(v) == dim if dim else F.size(v) > 0)
