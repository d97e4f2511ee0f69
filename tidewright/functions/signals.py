"""Audio signals as arrays: energy envelopes and where a shared sound begins. numpy in Arrow batches; decoding is outside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def envelope_of(samples: np.ndarray, frame: int) -> np.ndarray:
    """Change of the root mean square from frame to frame, in standard deviations."""
    whole = samples[: len(samples) // frame * frame].reshape(-1, frame)
    if not len(whole):
        return np.zeros(0)
    energy = np.sqrt((whole**2).mean(axis=1))
    change = np.diff(energy, prepend=energy[:1])
    spread = change.std()
    return (change - change.mean()) / (spread if spread > 1e-8 else 1.0)


def best_offset(search: np.ndarray, query: np.ndarray) -> tuple[int, float]:
    """Where `query` fits `search` best, and the cosine there; (-1, 0) if it is longer or empty."""
    n, m = len(search), len(query)
    if not m or m > n:
        return -1, 0.0
    size = 1 << (n + m - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(search, size) * np.conj(np.fft.rfft(query, size)), size)[: n - m + 1]
    at = int(product.argmax())
    norms = np.linalg.norm(search[at : at + m]) * np.linalg.norm(query)
    return at, float(product[at] / norms) if norms > 1e-8 else 0.0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def envelope(samples: pd.Series, frame: pd.Series) -> pd.Series:
    return pd.Series([envelope_of(np.asarray(s, float), int(f)) for s, f in zip(samples, frame)])


@F.pandas_udf(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("score", T.DoubleType())]))
def correlate(search: pd.Series, query: pd.Series) -> pd.DataFrame:
    found = [best_offset(np.asarray(s, float), np.asarray(q, float)) for s, q in zip(search, query)]
    return pd.DataFrame(found, columns=["position", "score"])


def local_anchors(pairs: DataFrame, key: str, reference: str, target: str, hz: float, spacing_sec: float, query_sec: float, radius_sec: float, delta_sec: float = 0.0) -> DataFrame:
    """Anchors of two envelopes: every `spacing_sec` a piece of the reference is sought near its place in the target.

    (key, reference_sec, target_sec, score), one row for each piece that fits inside the target's search range.
    """
    n, step = F.size(reference), int(spacing_sec * hz)
    m, r = int(query_sec * hz), int(radius_sec * hz)
    starts = F.when(n >= m, F.sequence(F.lit(0), n - m, F.lit(step)))
    each = pairs.select(key, reference, target, F.explode(starts).alias("_at"))
    low = F.greatest(F.lit(0), F.col("_at") + int(delta_sec * hz) - r)
    cut = each.select(key, "_at", low.alias("_low"), F.slice(reference, F.col("_at") + 1, m).alias("_q"), F.slice(target, low + 1, m + 2 * r).alias("_s"))
    found = cut.where(F.size("_s") >= m).withColumn("_f", correlate("_s", "_q"))
    return found.select(key, (F.col("_at") / hz).alias("reference_sec"), ((F.col("_low") + F.col("_f.position")) / hz).alias("target_sec"), F.col("_f.score").alias("score"))
