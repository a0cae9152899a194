"""Array-of-samples helpers: crops, padding, normalisation, mixing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NORMALIZE_EPS = 1e-5
DIVISOR_FLOOR = 1e-6
MIX_RMS_EPS = 1e-12
LEVEL_RMS_EPS = 1e-9
LEVEL_TARGET = 0.07
PEAK_LIMIT = 0.98
PREEMPHASIS = 0.97


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)


def mean_square(a: Column) -> Column:
    return F.aggregate(
        a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")
    ) / F.size(a)


def variance(a: Column, mu: Column) -> Column:
    return F.aggregate(
        a, F.lit(0.0), lambda s, v: s + (v.cast("double") - mu) * (v.cast("double") - mu)
    ) / F.size(a)


def rms(a: Column) -> Column:
    return F.sqrt(mean_square(a))


def pad_or_crop(a: Column, length: int, mode: str = "dataset_eval") -> Column:
    """Fixed length view: three quarters of the slack, or the middle whole chunk; zeros fill."""
    n = F.size(a)
    if mode == "dataset_eval":
        start = F.when(n > length, F.floor((n - length) / 4.0 * 3.0)).otherwise(F.lit(0))
    elif mode == "demo_middle":
        start = F.floor(F.floor(n / length) / 2) * length
    else:
        raise ValueError(mode)
    cut = F.slice(a, start.cast("int") + 1, F.lit(length))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size(cut))
    return F.when(n > 0, F.concat(cut, zeros))


def crop(a: Column, limit: int, mode: str = "head") -> Column:
    """Head, centre or tail crop; never pads."""
    n = F.size(a)
    start = {"head": F.lit(0), "center": F.floor((n - limit) / 2), "tail": n - limit}[mode]
    return F.when(n <= limit, a).otherwise(
        F.slice(a, F.greatest(start.cast("int"), F.lit(0)) + 1, F.lit(limit))
    )


def tile_to(a: Column, length: int, start: Column | int = 0) -> Column:
    """Repeat short input, then take ``length`` samples from a clamped start."""
    n = F.size(a)
    start = start if isinstance(start, Column) else F.lit(int(start))
    tiled = F.when(
        n < length, F.flatten(F.array_repeat(a, (F.floor(F.lit(length) / n) + 1).cast("int")))
    ).otherwise(a)
    last = F.size(tiled) - length
    return F.slice(tiled, F.least(F.greatest(start, F.lit(0)), last) + 1, F.lit(length))


def channel_mean(channels: Column) -> Column:
    """Mean over the outer array (channels) of equally long inner arrays."""
    zero = F.transform(channels[0], lambda v: F.lit(0.0))
    total = F.aggregate(
        channels, zero, lambda s, c: F.zip_with(s, c, lambda x, y: x + y.cast("double"))
    )
    return F.transform(total, lambda v: v / F.size(channels))


def preemphasis(a: Column, alpha: float = PREEMPHASIS) -> Column:
    """x[t] - alpha * x[t-1]; the first sample is kept."""
    return F.transform(
        a,
        lambda v, i: F.when(i == 0, v.cast("double")).otherwise(
            v.cast("double") - F.lit(alpha) * F.get(a, i - 1).cast("double")
        ),
    )


def unit_variance(a: Column, mu: Column, var: Column, eps: float = NORMALIZE_EPS) -> Column:
    """Zero mean, unit variance with eps inside the root; mu and var are computed once upstream."""
    return F.transform(a, lambda v: (v.cast("double") - mu) / F.sqrt(var + eps))


def std_scaled(a: Column, var: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double") / F.greatest(F.sqrt(var), F.lit(DIVISOR_FLOOR)))


def minmax_scaled(a: Column) -> Column:
    low = F.array_min(a).cast("double")
    high = F.array_max(a).cast("double") - low
    return F.transform(a, lambda v: (v.cast("double") - low) / F.greatest(high, F.lit(DIVISOR_FLOOR)))


def peak(a: Column) -> Column:
    return F.greatest(F.abs(F.array_min(a)), F.abs(F.array_max(a))).cast("double")


def peak_scaled(a: Column) -> Column:
    p = peak(a)
    return F.transform(a, lambda v: F.when(p > 0, v.cast("double") / p).otherwise(F.lit(0.0)))


def mix_at_snr(signal: Column, other: Column, snr_db) -> Column:
    """signal + scaled other so that their level ratio is snr_db."""
    snr = snr_db if isinstance(snr_db, Column) else F.lit(float(snr_db))
    scale = F.sqrt(mean_square(signal) + MIX_RMS_EPS) / (
        F.sqrt(mean_square(other) + MIX_RMS_EPS) * F.pow(F.lit(10.0), snr / 20.0)
    )
    return F.zip_with(signal, other, lambda x, y: x.cast("double") + scale * y.cast("double"))


def apply_gain(a: Column, gain_db) -> Column:
    g = gain_db if isinstance(gain_db, Column) else F.lit(float(gain_db))
    factor = F.pow(F.lit(10.0), g / 20.0)
    return F.transform(
        a, lambda v: F.greatest(F.least(v.cast("double") * factor, F.lit(1.0)), F.lit(-1.0))
    )


def level_to(a: Column, target: float = LEVEL_TARGET) -> Column:
    factor = F.lit(target) / F.sqrt(mean_square(a) + LEVEL_RMS_EPS)
    return F.transform(a, lambda v: v.cast("double") * factor)


def limit_peak(a: Column, limit: float = PEAK_LIMIT) -> Column:
    p = peak(a)
    return F.when(p > limit, F.transform(a, lambda v: v.cast("double") * (F.lit(limit) / p))).otherwise(
        _doubles(a)
    )
