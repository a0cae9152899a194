"""Waveform measurements from frames: file_id, frame number, samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import join_back

# Fixed analysis values.
CLIP_LEVEL = 0.999
SILENT_RMS = 0.001
SPECTRUM_FFT = 512
SAMPLE_RATE = 16_000
PRINT_BAND = (1000.0, 8000.0)
PRINT_MIN_DB, PRINT_MAX_DB = -45.0, 5.0
PRINT_HULL = 10


def time_measures(frames: DataFrame) -> DataFrame:
    """RMS, clipped share, silent-frame share. frames(file_id, frame, samples) do not overlap."""
    x = F.col("samples")
    sq = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    per = frames.select("file_id", F.size(x).alias("n"), sq.alias("sq"), F.size(F.filter(x, lambda v: F.abs(v) >= CLIP_LEVEL)).alias("clipped"))
    silent = F.sqrt(F.col("sq") / F.col("n")) <= SILENT_RMS
    return per.groupBy("file_id").agg(
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"), (F.sum("clipped") / F.sum("n")).alias("clipped_sample_fraction"),
        F.avg(silent.cast("double")).alias("silent_frame_fraction"))


def frame_power(frames: DataFrame, n_fft: int, db: bool = False) -> DataFrame:
    """(file_id, bin, value, frames) partial sums per Arrow batch: power, or clamped dB."""
    schema = "file_id long, bin int, total double, frames long"

    def work(batches):
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["samples"].to_numpy()).astype(np.float64)
            power = np.abs(np.fft.rfft(x * window, axis=1)) ** 2
            if db:
                power = 10 * np.log10(np.clip(power, 1e-10, 1e6))
            ids, at = np.unique(pdf["file_id"].to_numpy(), return_inverse=True)
            total = np.zeros((len(ids), power.shape[1]))
            np.add.at(total, at, power)
            yield pd.DataFrame(dict(
                file_id=np.repeat(ids, power.shape[1]), bin=np.tile(np.arange(power.shape[1], dtype=np.int32), len(ids)),
                total=total.ravel(), frames=np.repeat(np.bincount(at), power.shape[1])))

    part = frames.select("file_id", "samples").mapInPandas(work, schema)
    return part.groupBy("file_id", "bin").agg((F.sum("total") / F.sum("frames")).alias("value"))


def spectral_measures(power: DataFrame, n_fft: int = SPECTRUM_FFT) -> DataFrame:
    """Highband share, 95 % roll-off and flatness from mean power per bin (DC left out)."""
    p = power.filter("bin > 0").withColumn("hz", F.col("bin") * F.lit(SAMPLE_RATE / n_fft))
    w = Window.partitionBy("file_id")  # one file has n_fft / 2 bins
    run = Window.partitionBy("file_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("cum", F.sum("value").over(run)).withColumn("total", F.sum("value").over(w)).withColumn("top", F.max("value").over(w))
    bounded = F.greatest("value", F.col("top") * 1e-12)
    some = F.max("total") > 0
    return p.groupBy("file_id").agg(
        F.when(some, F.sum(F.when(F.col("hz") >= 4000, F.col("value")).otherwise(0.0)) / F.max("total")).otherwise(0.0).alias("highband_power_fraction"),
        F.when(some, F.coalesce(F.min(F.when(F.col("cum") >= 0.95 * F.col("total"), F.col("hz"))), F.max("hz")) / (SAMPLE_RATE / 2)).otherwise(0.0).alias("rolloff95_nyquist"),
        F.when(some, F.exp(F.avg(F.log(bounded))) / F.avg(bounded)).otherwise(0.0).alias("spectral_flatness"))


def fakeprint(db: DataFrame, n_fft: int = 8192) -> DataFrame:
    """Residue of the mean dB spectrum over its running minimum, scaled to its maximum."""
    hz = F.col("bin") * F.lit(SAMPLE_RATE / n_fft)
    band = db.filter((hz >= PRINT_BAND[0]) & (hz <= PRINT_BAND[1]))
    near = Window.partitionBy("file_id").orderBy("bin").rowsBetween(-(PRINT_HULL // 2), PRINT_HULL - PRINT_HULL // 2 - 1)
    hull = F.greatest(F.min("value").over(near), F.lit(PRINT_MIN_DB))
    res = band.select("file_id", "bin", F.least(F.greatest(F.col("value") - hull, F.lit(0.0)), F.lit(PRINT_MAX_DB)).alias("res"))
    top = res.groupBy("file_id").agg(F.max("res").alias("top"))
    return join_back(res, top, ["file_id"]).select("file_id", "bin", (F.col("res") / (F.col("top") + 1e-6)).alias("value"))
