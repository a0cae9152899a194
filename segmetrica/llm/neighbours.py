"""Approximate nearest neighbours by learned partitions.

On a sample, the graph of nearest neighbours is cut into balanced parts with few edges between them, and a small
classifier learns to tell a vector's part. All vectors are then dealt to the part the classifier finds most probable.
A query is sent to its several most probable parts, and all vectors there are ranked by the exact cosine. The number
of parts to look into is the smallest that reaches ``RECALL`` on queries from the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SAMPLE = 4096  # vectors the partitions and the classifier are fitted on
CHECK = 400  # further sample vectors that serve as queries to choose the number of probes
DEGREE = 10
PART_ROWS = 2048  # wanted vectors in a part; no more than SAMPLE / 64 parts
HIDDEN, EPOCHS, STEP = 128, 30, 0.01
RECALL = 0.97
BLOCK = 4096  # vectors or queries in one task's group


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of all edges, each in both directions."""
    n = len(x)
    degree = min(degree, n - 1)
    near = []
    for k in range(0, n, 1024):
        s = x[k : k + 1024] @ x.T
        s[np.arange(len(s)), np.arange(k, k + len(s))] = -np.inf
        near.append(np.argpartition(-s, degree - 1, axis=1)[:, :degree])
    a, b = np.repeat(np.arange(n), degree), np.concatenate(near).ravel()
    pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = pair // n, pair % n
    return np.concatenate([a, b]), np.concatenate([b, a])


def balanced_parts(a: np.ndarray, b: np.ndarray, n: int, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Halves the graph again and again: a smooth vector over the edges is cut at its middle, then pairs are swapped
    while that removes cut edges. Parts differ by at most a few nodes."""
    part = np.zeros(n, np.int64)

    def halve(nodes: np.ndarray, base: int, count: int) -> None:
        if count == 1:
            part[nodes] = base
            return
        left = count // 2
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        u, v, m = place[a[inside]], place[b[inside]], len(nodes)
        weight = np.bincount(u, minlength=m) + 1.0
        x = rng.standard_normal(m)
        for _ in range(60):
            x = (np.bincount(u, x[v], minlength=m) + x) / weight
            x = x - np.average(x, weights=weight)
            x = x / (np.linalg.norm(x) or 1.0)
        size = m * left // count
        side = np.ones(m, bool)
        side[np.argsort(x, kind="stable")[:size]] = False
        for _ in range(20):
            cross = side[u] != side[v]
            gain = np.bincount(u, np.where(cross, 1.0, -1.0), minlength=m)
            go = [np.flatnonzero(side == s)[np.argsort(-gain[side == s], kind="stable")] for s in (False, True)]
            k = min(len(go[0]), len(go[1]), max(1, m // 50))
            swap = int(np.searchsorted(-(gain[go[0][:k]] + gain[go[1][:k]]), -2.0))
            if not swap:
                break
            was = np.count_nonzero(cross)
            moved = np.concatenate([go[0][:swap], go[1][:swap]])
            side[moved] = ~side[moved]
            if np.count_nonzero(side[u] != side[v]) >= was:
                side[moved] = ~side[moved]
                break
        halve(nodes[~side], base, left)
        halve(nodes[side], base + left, count - left)

    halve(np.arange(n), 0, parts)
    return part


@dataclass
class Router:
    """A classifier with one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    """Cross-entropy by Adam."""
    d = x.shape[1]
    p = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            at = order[k : k + 256]
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            e[np.arange(len(at)), part[at]] -= 1
            e /= len(at)
            back = (e @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


@dataclass
class Partitions:
    router: Router
    parts: int
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.router.logits(unit(x)), axis=1, kind="stable").astype(np.int32)


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 5) -> Partitions:
    """Partitions for a table of so many rows, from at most SAMPLE + CHECK of its vectors."""
    rng = np.random.default_rng(seed)
    x = unit(sample.astype(np.float64))
    check = x[SAMPLE:] if len(x) > SAMPLE + 50 else x[:: max(1, len(x) // CHECK)]
    x = x[:SAMPLE]
    parts = int(min(max(1, len(x) // 64), max(1, rows // PART_ROWS)))
    if parts == 1:
        zero = np.zeros
        return Partitions(Router(zero((x.shape[1], 1)), zero(1), zero((1, 1)), zero(1)), 1, 1)
    a, b = neighbour_graph(x, DEGREE)
    router = fit_router(x, balanced_parts(a, b, len(x), parts, rng), parts, rng)
    found = Partitions(router, parts, parts)
    home, order = found.ranked(x)[:, 0], found.ranked(check)
    s = check @ x.T
    s[s > 1 - 1e-9] = -np.inf  # the query itself, where it is in the sample
    best = np.argsort(-s, axis=1)[:, :k]
    # how many probes reach the part of each true neighbour
    need = (order[:, None, :] == home[best][:, :, None]).argmax(axis=2) + 1
    found.probes = int(np.quantile(need, RECALL, method="higher"))
    return found


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec: array<double>) of vectors that aren't null or zero and hold no null or non-finite component."""
    x = F.col(column).cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("vec"))
    return rows.where(F.col("vec").isNotNull() & F.coalesce(F.forall("vec", fine), F.lit(False)) & F.exists("vec", lambda v: v != 0))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the same for equal rows wherever they stand."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query by cosine: (query_id, rank, vec_id, score), nearest first, ties to the smaller id.

    queries are rows of the same table (key, column); a row is no candidate of a query with its id. Vectors that are
    null or zero, or hold null or non-finite components, take no part, nor do those of another than the most frequent
    dimension (of equally frequent ones the largest). Fewer candidates than k give fewer rows; an empty table none.
    A repeated id is a candidate each time. If the probed parts hold fewer than k candidates, the query is searched in
    all parts.

    A part's vectors and its queries are cut into blocks of at most about ``BLOCK`` rows, so a part with very many equal
    vectors is shared by many tasks; each block pair returns k rows a query.
    """
    spark = vectors.sparkSession
    base = written(usable(vectors, key, column), "vectors")
    dims = base.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    d, rows = int(dims[0]), int(dims[1])
    base = base.where(F.size("vec") == d)
    # every row has the same chance, by a hash of its id; a few more than needed, cut to the bound
    part = min(1.0, 1.2 * (SAMPLE + CHECK) / rows)
    few = base.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    few = few.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE + CHECK).select("vec").toArrow()
    model = fit(few["vec"].combine_chunks().values.to_numpy().reshape(-1, d), rows, k)
    shared = spark.sparkContext.broadcast(model)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, d)

    def dealt(probes: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    order = shared.value.ranked(matrix(b.column(1)))[:, :probes]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order), pa.list_(pa.int32()))], names=["id", "vec", "parts"])

        return run

    kinds = "id long, vec array<double>, parts array<int>"
    home = base.mapInArrow(dealt(1), kinds).select("id", "vec", F.col("parts")[0].alias("part"))
    asked = usable(queries, key, column).where(F.size("vec") == d)

    def blocks_of(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def look(asked: DataFrame, probes: int) -> DataFrame:
        sent = asked.mapInArrow(dealt(probes), kinds).select("id", "vec", F.explode("parts").alias("part"))
        sizes = blocks_of(home, "nv").join(blocks_of(sent, "nq"), "part")  # one row a part
        deal = lambda side, n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        v = home.join(sizes, "part").withColumn("vb", deal(home, "nv", 3)).withColumn("qb", every("nq"))
        q = sent.join(sizes, "part").withColumn("qb", deal(sent, "nq", 4)).withColumn("vb", every("nv"))
        cell = ["part", "vb", "qb"]

        def rank(left: pa.Table, right: pa.Table) -> pa.Table:
            none = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
            if not len(left) or not len(right):
                return pa.table(none)
            vid, qid = left["id"].to_numpy(), right["id"].to_numpy()
            x, y = matrix(left["vec"].combine_chunks()), matrix(right["vec"].combine_chunks())
            ux, uy, found = unit(x), unit(y), []
            for at in range(0, len(y), 256):
                s = uy[at : at + 256] @ ux.T
                s[qid[at : at + 256, None] == vid[None, :]] = -2
                if s.shape[1] > k:
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-9
                else:
                    least = np.full((len(s), 1), -1.5)
                i, j = np.nonzero((s >= least) & (s > -1.5))
                score = exact_cosine(y[at + i], x[j])
                order = np.lexsort((vid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                top = np.arange(len(i)) - first < k
                found.append((qid[at + i[top]], vid[j[top]], score[top]))
            return pa.table({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(none)})

        v, q = (side.select("id", "vec", *cell) for side in (v, q))
        return v.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(rank, "query_id long, vec_id long, score double")

    found = written(look(asked, model.probes), "found")
    if model.probes < model.parts:
        enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, rows - 1)).select(F.col("query_id").alias("id"))
        rest = written(asked.join(enough, "id", "left_anti"), "short")
        if not rest.isEmpty():
            found = found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(look(rest, model.parts))
    # at most k rows a query and block pair
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
