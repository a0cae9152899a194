"""Whitening of integer-scaled embeddings with an exact covariance.

Each vector entry becomes an integer. Entries are shifted by the least value of their dimension, so they need few bits;
a task packs bit b of dimension i of all its rows into 64-bit words. The number of rows in which bit b of i and bit c of j
are both set is a popcount of the ANDed words, and 2**(b+c) times these counts, added up, is the exact cross-product of
i and j. Tasks add up such counts, Spark adds their products, and centring is done on integers before ``eigh``.

What reaches the driver is a few numbers for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
ROWS = 1 << 14  # of a block of bit planes
LIMB = 40  # bits of a part of a sum that Spark adds
FLAT = 1e-12  # an eigenvalue below this share of the trace counts as none
_FAR = 2.0**62


def usable(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector isn't null and holds no null or non-finite entry, their lengths and their entries end to end."""
    lists = batch.column(column)
    if not (pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type)):
        lists = lists.cast(pa.list_(lists.type.value_type))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = lists.flatten()  # leaves null lists out
    values = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (wrong[at[1:]] == wrong[at[:-1]]) & (sizes > 0) & np.asarray(lists.is_valid())
    return np.flatnonzero(fine), sizes[fine], values[np.repeat(fine, sizes)]


def matrix(batch: pa.RecordBatch, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable rows of dimension d and their integers, one row each."""
    rows, sizes, values = usable(batch, column)
    right = sizes == d
    x = values[np.repeat(right, sizes)].reshape(-1, d)
    return rows[right], (np.clip(np.floor(x * SCALE), -_FAR, _FAR)).astype(np.int64) + OFFSET


def bounds(vectors: DataFrame, column: str) -> DataFrame:
    """(d, dim, n, low, high, total as limbs) for every dimension of vectors of every length."""
    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            rows, sizes, _ = usable(batch, column)
            for d in np.unique(sizes).tolist():
                _, x = matrix(batch, column, d)
                old = kept.setdefault(d, [0, x[0], x[0]])
                old[0] += len(x)
                old[1], old[2] = np.minimum(old[1], x.min(axis=0)), np.maximum(old[2], x.max(axis=0))
        for d, (n, low, high) in kept.items():
            whole = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=["d", "dim", "n", "low", "high"])

    return vectors.select(column).mapInArrow(run, "d int, dim int, n long, low long, high long")


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Row (i, b) holds bit b of dimension i of all rows, 64 rows in a word."""
    n, width = len(y), -(-len(y) // 64) * 64
    out = np.zeros((int(bits.sum()), width // 8), np.uint8)
    at = 0
    for i, b in enumerate(bits.tolist()):
        if b:
            on = (y[:, i][None, :] >> np.arange(b, dtype=np.uint64)[:, None] & np.uint64(1)).astype(bool)
            out[at : at + b, : -(-n // 8)] = np.packbits(on, axis=1)
        at += b
    return out.view(np.uint64)


class Products:
    """Exact sums of y_i and of y_i * y_j (i <= j) over blocks of rows, from counts of bits set together.

    The weight 2**(b+c) of a pair of planes is kept as a place (b+c) // STEP and a factor below 2**STEP, so places are
    plain 64-bit sums: d * d * places numbers, whatever the number of rows.
    """

    STEP = 20

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.d = bits, len(bits)
        self.at = np.concatenate([[0], np.cumsum(bits)])
        self.dim = np.repeat(np.arange(self.d), bits)
        self.power = np.arange(self.at[-1]) - self.at[self.dim]
        self.places = 2 * int(bits.max(initial=0)) // self.STEP + 1
        self.sums = np.zeros((self.d, self.d * self.places), np.int64)
        self.ones = np.zeros(self.at[-1], np.int64)

    def add(self, p: np.ndarray) -> None:
        self.ones += np.bitwise_count(p).sum(axis=1, dtype=np.int64)
        for i in range(self.d):
            start = self.at[i]
            for b in range(self.bits[i]):
                both = np.bitwise_count(p[start + b] & p[start:]).sum(axis=1, dtype=np.int64)
                power = self.power[start:] + b
                place = self.dim[start:] * self.places + power // self.STEP
                # at most ROWS * 2**STEP * 64 for each place: exact as doubles
                self.sums[i] += np.bincount(place, both << power % self.STEP, self.d * self.places).astype(np.int64)

    def total(self, i: int) -> int:
        return sum(int(c) << b for b, c in enumerate(self.ones[self.at[i] : self.at[i + 1]].tolist()))

    def pair(self, i: int, j: int) -> int:
        row = self.sums[i, j * self.places : (j + 1) * self.places].tolist()
        return sum(v << self.STEP * k for k, v in enumerate(row))


def limbs(value: int) -> list[int]:
    return [value & (1 << LIMB) - 1, value >> LIMB & (1 << LIMB) - 1, value >> 2 * LIMB & (1 << LIMB) - 1, value >> 3 * LIMB]


def scatter(vectors: DataFrame, column: str, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(i, j, l0..l3): parts of the sum over rows of (x_i - low_i) * (x_j - low_j); j = -1: of x_i - low_i."""
    d = len(low)
    bits = np.array([(int(b) - int(a)).bit_length() for a, b in zip(low, high)])
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def run(batches):
        sums, seen = Products(bits), 0
        for batch in batches:
            _, x = matrix(batch, column, d)
            y = x.astype(np.uint64) - low.astype(np.uint64)
            for k in range(0, len(y), ROWS):
                sums.add(planes(y[k : k + ROWS], bits))
            seen += len(y)
        if not seen:
            return
        for i in range(d):
            rows = [(i, -1, *limbs(sums.total(i)))] + [(i, j, *limbs(sums.pair(i, j))) for j in range(i, d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["i", "j", "l0", "l1", "l2", "l3"])

    parts = vectors.select(column).mapInArrow(run, "i int, j int, l0 long, l1 long, l2 long, l3 long")
    return parts.groupBy("i", "j").agg(*[F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(4)])


@dataclass
class Whitening:
    """n fitted rows, their sums S for each dimension, eigenvalues falling, unit eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    low: np.ndarray
    high: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)**2, exact."""
        reach = max((max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(self.low, self.high, self.sums)), default=0)
        if self.d * reach * reach < 1 << 63 and self.n * max(map(abs, [*map(int, self.low), *map(int, self.high)])) < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates; NaN where a component has no variance."""
        mean_whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        centred = (x - mean_whole).astype(np.float64) - rest
        e = self.values[:k]
        ok = e > FLAT * self.trace
        scale = np.where(ok, 1 / np.sqrt(np.where(ok, e, 1.0)), np.nan)
        # one fixed order of addition, whatever rows stand beside
        out = np.zeros((len(x), k))
        for i in range(self.d):
            out += centred[:, i : i + 1] * self.vectors[i, :k]
        return out * scale


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Whitening from all usable vectors of the most frequent dimension (ties: the larger); None if there are none."""
    b = bounds(vectors, column).groupBy("d", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = b.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if best is None:
        return None
    d, n = int(best["d"]), int(best["n"])
    edges = b.where(F.col("d") == d).orderBy("dim").collect()  # one row a dimension
    low, high = (np.array([r[c] for r in edges], np.int64) for c in ("low", "high"))
    found = {(r["i"], r["j"]): sum(int(r[f"l{k}"]) << LIMB * k for k in range(4)) for r in scatter(vectors, column, low, high).collect()}
    shifted = [found[i, -1] for i in range(d)]
    cov = np.zeros((d, d))
    total = 0
    for i in range(d):
        for j in range(i, d):
            exact = n * found[i, j] - shifted[i] * shifted[j]  # n**2 times the covariance; a shift doesn't change it
            total += exact if i == j else 0
            cov[i, j] = cov[j, i] = exact / (n * n)
    values, axes = np.linalg.eigh(cov)
    return Whitening(n, [s + n * int(a) for s, a in zip(shifted, low)], values[::-1].copy(), axes[:, ::-1].copy(), total / (n * n), low, high)


def transform(vectors: DataFrame, model: Whitening, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation: decimal(38,0), whitened: array of at most k doubles) of every usable vector."""
    k = min(k, model.d)

    def run(batches):
        for batch in batches:
            rows, x = matrix(batch, column, model.d)
            for at in range(0, len(x), ROWS):
                part, ids = x[at : at + ROWS], rows[at : at + ROWS]
                w = pa.array(model.project(part, k).ravel(), pa.float64(), from_pandas=True)  # NaN as null
                far = [v if abs(v) < 10**38 else None for v in model.deviations(part)]
                text = pa.array([None if v is None else str(v) for v in far], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids)), text, pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), w)],
                    names=[key, "deviation", "whitened"],
                )

    kind = vectors.schema[key].dataType.simpleString()
    out = vectors.select(key, column).mapInArrow(run, f"{key} {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(found: DataFrame, n: int, k: int, column: str = "whitened") -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity; components without variance are left out."""
    w = F.col(column)
    means = found.agg(*[(F.sum(w[c]) / F.lit(n)).alias(f"m{c}") for c in range(k)]).first()
    live = [c for c in range(k) if means[c] is not None]

    def entry(a: int, b: int) -> Column:
        return (F.sum((w[a] - F.lit(means[a])) * (w[b] - F.lit(means[b]))) / F.lit(n)).alias(f"c{a}_{b}")

    pairs = [(a, b) for a in live for b in live if a <= b]
    if not pairs:
        return None
    row = found.agg(*[entry(a, b) for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, k: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per usable vector and component: key, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite entries, are dropped, and those of another length than the
    most frequent one (ties: the larger). An entry beyond 2**62 / 1024 counts as that bound. Rows that repeat a key, or
    have none, are rows like others; equal vectors give equal rows. Components without variance (constant dimensions, a
    single row) have a null ``whitened``; with no variance at all ``explained`` is null too. ``deviation`` is null beyond
    38 digits. Extra columns are not read. An empty table gives no row.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    model = fit(vectors, column)
    if model is None:
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    k = min(k, model.d)
    found = transform(vectors, model, k, key, column)
    error = identity_error(found, model.n, k)
    shares = F.array(*[F.lit(max(0.0, float(e)) / model.trace if model.trace > 0 else None).cast("double") for e in model.values[:k]])
    long = found.select(key, "deviation", F.posexplode("whitened").alias("_c", "whitened"))
    return long.select(
        key, (F.col("_c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
