"""Fusing several detectors' scores; rank normalisation without a global sort task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import accumulate, join_back, probability_bucket

METHODS = ("mean", "max", "min", "rank_mean")


def rank_normalise(df: DataFrame, score: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank scaled to (0, 1]; ties share a rank."""
    keys = list(keys)
    hist = df.groupBy(*keys, F.col(score)).agg(F.count(F.lit(1)).alias("_c"))
    run = accumulate(hist, keys, [F.col(score).asc()], probability_bucket(F.col(score)), ["_c"], descending=False)
    ranks = run.select(
        *keys, score, ((F.col("_c_cum") - (F.col("_c") - 1) / 2.0) / F.col("_c_all")).alias(out)
    )
    return join_back(df, ranks, [*keys, score])


def fuse(df: DataFrame, components: Sequence[str], method: str, weights: Mapping[str, float] | None = None,
         out: str = "fused") -> DataFrame:
    """One fused score; rank_mean depends on the evaluated set and is not per-file safe."""
    if method not in METHODS:
        raise ValueError(method)
    w = {c: 1.0 for c in components} if weights is None else {c: float(weights[c]) for c in components}
    total = sum(w.values())
    if min(w.values()) < 0 or total <= 0:
        raise ValueError("fusion weights must be non-negative with a positive sum")
    cols = list(components)
    d = df
    if method == "rank_mean":
        for c in components:
            d = rank_normalise(d, c, f"_rank_{c}")
        cols = [f"_rank_{c}" for c in components]
    if method in ("mean", "rank_mean"):
        value = sum((F.lit(w[c] / total) * F.col(k) for c, k in zip(components, cols)), F.lit(0.0))
    else:
        value = (F.greatest if method == "max" else F.least)(*[F.col(c) for c in cols])
    clipped = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))
    return d.withColumn(out, clipped).withColumn("per_file_safe", F.lit(method != "rank_mean")).drop(
        *[c for c in d.columns if c.startswith("_rank_")]
    )
