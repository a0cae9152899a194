"""Submission ledger: running best, implied error change, daily quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import join_back

HEAD_WEIGHTS = {"file": 0.5, "voice": 0.2, "music": 0.3}  # fixed weights of the composite


def running_best(df: DataFrame, bucket: Column, order: list[Column], score: str) -> DataFrame:
    """Best score before each row, new-best flag and gain, in ledger order.

    ``bucket`` (a day, say) must be monotone in the order: bucket maxima are accumulated
    first, so the whole ledger is never in one task.
    """
    d = df.withColumn("_b", bucket)
    tops = d.groupBy("_b").agg(F.max(score).alias("_top"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = tops.select("_b", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = join_back(d, offset, ["_b"]).withColumn("previous_best", F.greatest(F.max(score).over(inside), F.col("_before")))
    new = F.col("previous_best").isNull() | (F.col(score) > F.col("previous_best"))
    return j.withColumn("new_best", new).withColumn("gain", F.when(new, F.col(score) - F.col("previous_best"))).drop("_b", "_before")


def implied_error_change(gain: Column, head: str) -> Column:
    """Change of one head's error that would explain a change of the weighted score."""
    return -gain / F.lit(HEAD_WEIGHTS[head])


def quota_by_day(events: DataFrame, ts: str, daily_limit: int, offset_hours: int = 9) -> DataFrame:
    """Uses per local day against a limit, days without use included."""
    local = F.to_date(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))
    used = events.groupBy(local.alias("day")).agg(F.count(F.lit(1)).alias("used"))
    span = used.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    u = F.coalesce("used", F.lit(0))
    return days.join(used, "day", "left").select(
        "day", u.alias("used"), F.greatest(F.lit(daily_limit) - u, F.lit(0)).alias("remaining"), (u > daily_limit).alias("over"))


def budget(df: DataFrame, now: str, deadline: str, daily_limit: int, used_today: str, campaign_limit: int | None = None,
           campaign_used: str | None = None, offset_hours: int = 9) -> DataFrame:
    """Remaining allowance of each row's (now, exclusive deadline) in local days."""
    shift = F.make_dt_interval(F.lit(0), F.lit(offset_hours))
    n, d = F.col(now) + shift, F.col(deadline) + shift
    today, last = F.to_date(n), F.to_date(d)
    closed = F.col(now) >= F.col(deadline)
    full = F.when(closed, 0).otherwise(F.greatest(F.datediff(last, today) - 1, F.lit(0)))
    partial = F.when(closed | (last <= today), 0).otherwise((d > last.cast("timestamp_ntz")).cast("int"))
    now_left = F.when(closed, 0).otherwise(F.lit(daily_limit) - F.col(used_today))
    platform = now_left + F.lit(daily_limit) * (full + partial)
    left = None if campaign_limit is None else F.lit(campaign_limit) - F.col(campaign_used)
    return df.withColumn("closed", closed).withColumn("full_days", full).withColumn("partial_days", partial).withColumn(
        "platform_remaining", platform).withColumn("effective_remaining", platform if left is None else F.least(platform, left))
