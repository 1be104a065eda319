"""Numbers from short signals held in array columns: loudness, display curves, key, pooled windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published Krumhansl key profiles.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def rms_dbfs(samples: Column, silence: float = -70.0) -> Column:
    """Root-mean-square level in dB of full scale; ``silence`` for nothing or silence."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when((F.size(samples) > 0) & (F.sqrt(square) > 1e-9), 20 * F.log10(F.sqrt(square))).otherwise(F.lit(silence))


def display_curve(values: Column, n: int = 8) -> Column:
    """``n`` evenly placed values scaled to 0..1; 0.5 throughout where flat, 0 where there are none."""
    size = F.size(values)
    step = (size - 1) / F.lit(float(n - 1))
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, F.when(i == n - 1, size - 1).otherwise(F.floor(i * step + 1e-9)).cast("int")).cast("double"))
    lo, hi = F.array_min(points), F.array_max(points)
    scaled = F.when(hi - lo < 1e-9, F.array_repeat(F.lit(0.5), n)).otherwise(F.transform(points, lambda p: (p - lo) / (hi - lo)))
    return F.when(size > 0, scaled).otherwise(F.array_repeat(F.lit(0.0), n))


def pearson(a: Column, b: list[float]) -> Column:
    """Correlation of an array column with fixed values of the same length."""
    y = np.array(b, dtype=float) - np.mean(b)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(b)
    centred = F.transform(a, lambda x: x - mean)
    top = F.aggregate(F.zip_with(centred, F.array(*(F.lit(float(v)) for v in y)), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)) * float(np.sqrt((y * y).sum()))
    return F.when(norm > 0, top / norm)


def key_of(chroma: Column) -> Column:
    """struct(pitch_class, mode) whose profile correlates best with twelve chroma values, the first on ties; C major for flat ones."""
    fits = [F.struct(F.coalesce(pearson(chroma, list(np.roll(p, pc))), F.lit(-2.0)).alias("fit"), F.lit(-(2 * pc + m)).alias("first"), F.lit(pc).alias("pitch_class"), F.lit(name).alias("mode")) for pc in range(12) for m, (name, p) in enumerate((("major", MAJOR), ("minor", MINOR)))]
    best = F.array_max(F.array(*fits))
    return F.struct(best["pitch_class"].alias("pitch_class"), best["mode"].alias("mode"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def windows(seconds: pd.Series, length: pd.Series, most: pd.Series) -> pd.Series:
    """At most ``most`` evenly placed (start, end) windows of ``length`` seconds over a signal; one window over a shorter one."""

    def place(s: float, w: float, n: int) -> list[list[float]]:
        if not s or s <= w:
            return [[0.0, float(s or 0.0)]]
        k = int(min(n, max(1, s // w)))
        return [[float(a), float(a + w)] for a in (np.linspace(0, s - w, k) if k > 1 else [0.0])]

    return pd.Series([place(*x) for x in zip(seconds, length, most)])
