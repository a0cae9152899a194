"""Segment scores to file scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra as A
from .prefix import join_back

# name -> (kind, parameter); the default axis of the formula grid.
POOLINGS = {
    "max": ("max", 0),
    "mean": ("mean", 0),
    "top2": ("topk", 2),
    "top3": ("topk", 3),
    "mix0.25": ("mix", 0.25),
    "mix0.5": ("mix", 0.5),
    "mix0.75": ("mix", 0.75),
}


TASK_ROWS = 1_000_000


def column_name(pooling: str) -> str:
    return "p_" + pooling.replace(".", "_")


def pool(df: DataFrame, keys: Sequence[str], score: str = "score", poolings=None, rows: int | None = None) -> DataFrame:
    """One column per pooling. Top-k rows are cut before the shuffle (group limit).

    For very many keys of a few rows each give the number of rows: they are then dealt once, by key, to tasks of about
    TASK_ROWS each, and ranked and summed there without a join. So a task's memory doesn't follow the table.
    """
    keys = list(keys)
    poolings = dict(POOLINGS if poolings is None else poolings)
    s = F.col(score)
    ks = sorted({int(p) for kind, p in poolings.values() if kind == "topk"})
    if ks and min(ks) < 1:
        raise ValueError("top-k needs k >= 1")
    plain = [F.max("_s").alias("_max"), F.avg("_s").alias("_mean")]
    tops = [F.avg(F.when(F.col("_r") <= k, F.col("_s"))).alias(f"_top{k}") for k in ks]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_s").desc()))
    data = df.select(*keys, s.alias("_s"))
    if rows is not None:
        dealt = data.repartition(max(1, -(-rows // TASK_ROWS)), *keys)
        base = (dealt.withColumn("_r", rank) if ks else dealt).groupBy(*keys).agg(*plain, *tops)
    else:
        base = data.groupBy(*keys).agg(*plain)
        if ks:
            top = data.withColumn("_r", rank).filter(F.col("_r") <= max(ks)).groupBy(*keys).agg(*tops)
            base = join_back(base, top, keys)
    out = []
    for name, (kind, p) in poolings.items():
        if kind == "mix" and not 0.0 <= p <= 1.0:
            raise ValueError("mix needs alpha in [0, 1]")
        expr = {
            "max": lambda: F.col("_max"),
            "mean": lambda: F.col("_mean"),
            "topk": lambda: F.col(f"_top{int(p)}"),
            "mix": lambda: F.lit(float(p)) * F.col("_mean") + F.lit(1.0 - float(p)) * F.col("_max"),
        }[kind]()
        out.append(expr.alias(column_name(name)))
    return base.select(*keys, *out)


def pool_array(segments: Column, kind: str, p: float = 0) -> Column:
    """The same poolings on one file's short array; an empty (silent) array is 0.0."""
    mean = A.array_mean(segments)
    top = F.array_max(segments)
    body = {
        "max": lambda: top,
        "mean": lambda: mean,
        "topk": lambda: A.array_mean(F.slice(F.sort_array(segments, asc=False), 1, int(p))),
        "mix": lambda: F.lit(float(p)) * mean + F.lit(1.0 - float(p)) * top,
    }[kind]()
    return F.when(F.size(segments) == 0, F.lit(0.0)).otherwise(body)


def silence(segments: Column, rms: Column) -> Column:
    """A stream below the silence level has no segments at all."""
    return F.when(rms < A.SILENCE_RMS, F.array().cast("array<double>")).otherwise(segments)


OPEN_ROWS = 200_000  # partial results a task holds before it merges them


def _codes(keys: pa.Table) -> np.ndarray:
    """A number for each distinct combination of the key columns."""
    out = np.zeros(keys.num_rows, np.int64)
    for column in keys.columns:
        coded = column.combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        # numbers stay below the number of rows after each column
        out = out * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _merge(keys: pa.Table, states: np.ndarray, taus: Sequence[float]) -> tuple[pa.Table, np.ndarray]:
    """One state a key: for each pool the maximum, the weights' sum, and for each tau a sum scaled by the maximum."""
    codes = _codes(keys)
    order = np.argsort(codes, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
    sizes = np.diff(np.append(edge, len(order)))
    out = np.empty((len(edge), states.shape[1]))
    width = 2 + len(taus)
    for i in range(0, states.shape[1], width):
        s = states[order, i : i + width]
        top = np.maximum.reduceat(s[:, 0], edge)
        with np.errstate(invalid="ignore"):
            below = s[:, 0] - np.repeat(top, sizes)
        below[np.isnan(below)] = 0.0  # no logit yet on either side: all its sums are 0
        out[:, i], out[:, i + 1] = top, np.add.reduceat(s[:, 1], edge)
        for k, t in enumerate(taus):
            out[:, i + 2 + k] = np.add.reduceat(s[:, 2 + k] * np.exp(below / t), edge)
    return keys.take(pa.array(order[edge])), out


def smooth_max_pools(df: DataFrame, keys: Sequence[str], pools: Sequence[tuple[Column, Column | None]], taus: Sequence[float] = (1.0,)) -> DataFrame:
    """tau * log(sum w exp(z / tau) / sum w) for every pool (z, w) and tau, in one pass: columns ``x_<pool>_<tau>``.

    Each task first merges its own rows to one state a key (maximum and scaled sums, which can be merged again), so a
    file of any length, also with equal logits only, leaves its tasks as a few rows. Rows without a logit count with
    their weight only; a key with none is NULL.
    """
    keys, taus, width, n_pools = list(keys), [float(t) for t in taus], 2 + len(taus), len(pools)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, state array<double>"

    def emit(k: pa.Table, s: np.ndarray):
        for at in range(0, len(s), 10_000):
            part = s[at : at + 10_000]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * s.shape[1], pa.int32()), pa.array(part.ravel()))
            rows = k.slice(at, len(part)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*rows.columns, flat], names=[*keys, "state"])

    def merged(parts):
        """parts: (keys, states); merges whenever many are open, and passes on what stays large."""
        held, rows = [], 0
        for part in parts:
            if not len(part[1]):
                continue
            held.append(part)
            rows += len(part[1])
            if rows >= OPEN_ROWS:
                one = _merge(pa.concat_tables([k for k, _ in held]), np.concatenate([s for _, s in held]), taus)
                held, rows = [one], len(one[1])
                if rows >= OPEN_ROWS // 2 and not final[0]:
                    yield from emit(*one)
                    held, rows = [], 0
        if held:
            yield from emit(*_merge(pa.concat_tables([k for k, _ in held]), np.concatenate([s for _, s in held]), taus))

    final = [False]

    def states(batches):
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, n_pools * width))
            for i in range(n_pools):
                z = batch.column(len(keys) + 2 * i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
                w = batch.column(len(keys) + 2 * i + 1).fill_null(0.0).to_numpy(zero_copy_only=False)
                none = np.isnan(z)
                out[:, i * width] = np.where(none, -np.inf, z)
                out[:, i * width + 1] = w
                out[:, i * width + 2 : (i + 1) * width] = np.where(none, 0.0, w)[:, None]
            yield pa.Table.from_batches([batch]).select(keys), out

    def first(batches):
        yield from merged(states(batches))

    def last(batches):
        final[0] = True  # all rows of a key are here: nothing may leave before the end
        def read():
            for batch in batches:
                s = batch.column(len(keys))
                yield pa.Table.from_batches([batch]).select(keys), s.flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1)
        yield from merged(read())

    columns = [c for i, (z, w) in enumerate(pools) for c in (z.cast("double").alias(f"_z{i}"), (F.lit(1.0) if w is None else w.cast("double")).alias(f"_w{i}"))]
    partial = df.select(*keys, *columns).mapInArrow(first, schema)
    whole = partial.repartition(*keys).mapInArrow(last, schema)

    def value(i: int, k: int) -> Column:
        m, sw, e = (F.col("state")[i * width + j] for j in (0, 1, 2 + k))
        x = F.lit(taus[k]) * F.log(e / F.greatest(sw, F.lit(1e-12))) + m
        return F.when(m > float("-inf"), x).alias(f"x_{i}_{k}")

    return whole.select(*keys, *[value(i, k) for i in range(len(pools)) for k in range(len(taus))])


def pool_smooth_max(df: DataFrame, keys: Sequence[str], z: str, weight: Column | None = None, taus: Sequence[float] = (1.0,)) -> DataFrame:
    """One pool of ``smooth_max_pools``, one column ``lse_<i>`` per tau."""
    found = smooth_max_pools(df, keys, [(F.col(z), weight)], taus)
    return found.select(*keys, *[F.col(f"x_0_{i}").alias(f"lse_{i}") for i in range(len(taus))])


def presence_weight(z: Column, gamma: float) -> Column:
    """Window weight from a presence logit; gamma 0 gives equal weights."""
    return F.lit(1.0) if gamma == 0 else F.pow(A.sigmoid(z), F.lit(float(gamma))) + F.lit(1e-6)


def weighted_mean(df: DataFrame, keys: Sequence[str], z: str, w: str, out: str = "z") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(w) * F.col(z)) / F.sum(w)).alias(out))


def bag_features(df: DataFrame, keys: Sequence[str], vector: str, w: str) -> DataFrame:
    """Weighted mean vector per key in long form (key, bin, value)."""
    long = df.select(*keys, F.col(w).alias("_w"), F.posexplode(vector).alias("bin", "_x"))
    return long.groupBy(*keys, "bin").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("value")
    )


def presence_from_classes(probs: Column, indices: Sequence[int]) -> Column:
    """Highest probability over the given classes."""
    return F.array_max(F.transform(F.array(*[F.lit(int(i)) for i in indices]), lambda i: F.get(probs, i)))


def crop_mean(scores: Column, policy: str = "all") -> Column:
    """Mean over crop scores.

    all:    one invalid score rejects the file (NULL).
    finite: only finite scores count.
    sorted: like all, summed in sorted order so the result ignores crop order.
    """
    valid = F.forall(scores, A.is_probability) & (F.size(scores) > 0)
    if policy == "all":
        return F.when(valid, A.array_mean(scores))
    if policy == "sorted":
        return F.when(valid, A.array_mean(F.array_sort(scores)))
    if policy == "finite":
        return A.array_mean(F.filter(scores, A.is_number))
    raise ValueError(policy)
