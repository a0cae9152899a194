"""Cumulative sums and ranks without a single-partition window.

A cumulative sum over all rows of a key would put that key into one task. Both
helpers here use two levels: rows are cut into many ordered buckets, bucket
totals (a few thousand rows per key) are accumulated first, and the running sum
inside each bucket then starts from its bucket's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket

SCORE_BUCKETS = 4096


def probability_bucket(score: Column, buckets: int = SCORE_BUCKETS) -> Column:
    """Ordered buckets, equal steps on the logit scale.

    log and log1p are monotone, so a higher score never lands in a lower bucket,
    and saturated scores near 0 and 1 still spread over many buckets. Scores outside
    [0, 1] have buckets of their own on a log scale.
    """
    p = F.greatest(F.least(score, F.lit(1.0 - 1e-12)), F.lit(1e-12))
    z = F.log(p) - F.log1p(-p)
    inside = F.floor((z + F.lit(28.0)) * F.lit(buckets / 56.0))
    above = F.lit(buckets) + F.floor(F.log1p(score - 1) * 64)
    below = -F.lit(1) - F.floor(F.log1p(-score) * 64)
    return F.when(score > 1, above).when(score < 0, below).otherwise(inside).cast("int")


def with_quantile_bucket(df: DataFrame, value: str, name: str = "_q", buckets: int = 256) -> DataFrame:
    """Adds ordered buckets between quantiles of the data, so values in any range spread over all of them.

    The quantiles are approximate, but every value is dealt by exact comparison.
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = df.agg(F.percentile_approx(value, shares, 20 * buckets).alias("_bounds"))
    below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    return attach(df, bounds, []).withColumn(name, F.coalesce(below, F.lit(0))).drop("_bounds")


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right["_r_" + n])
    return cond


def join_back(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named key columns, NULL keys included."""
    if not names:
        raise ValueError("at least one key is needed")
    r = right
    for n in names:
        r = r.withColumnRenamed(n, "_r_" + n)
    return left.join(r, null_safe(left, r, names), how).drop(*["_r_" + n for n in names])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a table with one row per key; without keys, of a one-row aggregate.

    The one-row case is a scalar subquery, so no cross join is planned.
    """
    if keys:
        return join_back(left, right, keys, how)
    return left.withColumn("_one_row", right.select(F.struct("*")).scalar()).select(
        *left.columns, "_one_row.*"
    )


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    values: Sequence[str],
    descending: bool = True,
) -> DataFrame:
    """Add ``<v>_cum`` (running sum, this row included) and ``<v>_all`` (key total).

    ``bucket`` must be monotone in ``order``.
    """
    keys = list(keys)
    # one key that is never NULL serves the join and the window alike, so the rows move once
    cut = df.withColumn("_b", bucket).withColumn("_k", F.struct(*keys, F.lit(0))).withColumn("_kb", F.struct("_k", "_b"))
    totals = cut.groupBy("_k", "_b", "_kb").agg(*[F.sum(v).alias("_t_" + v) for v in values])
    b_order = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy("_k").orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_k")
    offsets = totals.select(
        F.col("_kb").alias("_kb_total"),
        *[F.coalesce(F.sum("_t_" + v).over(before), F.lit(0)).alias("_o_" + v) for v in values],
        *[F.sum("_t_" + v).over(whole).alias(v + "_all") for v in values],
    )
    inside = Window.partitionBy("_kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, F.col("_kb") == F.col("_kb_total"))
    for v in values:
        joined = joined.withColumn(v + "_cum", F.sum(v).over(inside) + F.col("_o_" + v))
    return joined.drop("_b", "_k", "_kb", "_kb_total", *["_o_" + v for v in values])


def hash_rank(df: DataFrame, keys: Sequence[str], digest: str, tie: str) -> DataFrame:
    """Add ``pos`` (1..n in digest order within keys) and ``n`` (rows of the key)."""
    ranked = accumulate(
        df.withColumn("_one", F.lit(1).cast("long")),
        keys,
        [F.col(digest).asc(), F.col(tie).asc()],
        F.conv(hash_bucket(F.col(digest)), 16, 10).cast("int"),
        ["_one"],
        descending=False,
    )
    return ranked.withColumnRenamed("_one_cum", "pos").withColumnRenamed("_one_all", "n").drop("_one")
