"""Start offsets of analysis windows, as array expressions over a sample count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed window geometry (samples at 16 kHz).
SAMPLE_RATE = 16_000
SEGMENT_SAMPLES = 64_600
WINDOW_SAMPLES = 64_000
HOP_SAMPLES = 32_000
MAX_WINDOWS = 150
FIVE_POINT_CROP = 34_398


def sliding_starts(n: Column, width: int = WINDOW_SAMPLES, hop: int = HOP_SAMPLES) -> Column:
    """Regular starts plus a right-aligned last one; a short file has the single start 0."""
    n = n.cast("long")
    last = F.greatest(n - F.lit(width), F.lit(0)).cast("long")
    grid = F.sequence(F.lit(0).cast("long"), last, F.lit(hop).cast("long"))
    return F.when(n.isNotNull(), F.array_union(grid, F.array(last)))


def tumbling_starts(n: Column, width: int = SEGMENT_SAMPLES) -> Column:
    return sliding_starts(n, width, width)


def capped_sliding_starts(
    n: Column, width: int = WINDOW_SAMPLES, hop: int = HOP_SAMPLES, limit: int = MAX_WINDOWS
) -> Column:
    """Sliding starts, at most ``limit`` of them, spread evenly (half-even rounding).

    Start k is min(k * hop, last), so only the kept indices are ever built.
    """
    n = n.cast("long")
    last = F.greatest(n - F.lit(width), F.lit(0)).cast("long")
    top = F.ceil(last / F.lit(hop)).cast("long")  # index of the last start
    picks = F.when(top < limit, F.sequence(F.lit(0).cast("long"), top)).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long")),
            lambda i: F.rint(i * (top / F.lit(float(limit - 1)))).cast("long"),
        )
    )
    starts = F.transform(F.array_distinct(picks), lambda k: F.least(k * hop, last))
    return F.when(n.isNotNull(), starts)


def first_middle_last(n: Column, width: int = SEGMENT_SAMPLES) -> Column:
    last = F.greatest(n.cast("long") - F.lit(width), F.lit(0)).cast("long")
    return F.array_sort(
        F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(last / 2).cast("long"), last))
    )


def five_point_starts(n: Column, width: int = FIVE_POINT_CROP) -> Column:
    span = F.greatest(n.cast("long") - F.lit(width), F.lit(0)).cast("long")
    return F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * span / 4).cast("long"))
    )
