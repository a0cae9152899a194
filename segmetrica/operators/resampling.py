"""Cluster bootstrap of the EER with counts instead of rows.

1. Counts a fine score bucket give the difference of the error rates along the scores of each key. Edges at
   0, +-FINEST, +-2 FINEST, ... of that difference cut the scores into a few coarse buckets, narrow where replicates cross.
2. (key, group, coarse bucket) counts, combined before any shuffle, meet the groups' draws in blocks: one matrix product a
   block and key gives the counts of every replicate. Their running sums name each replicate's crossing bucket.
3. Only the rows of those buckets are read exactly, each for the replicates that cross there.

A very large group is at most one row a key and coarse bucket in step 2. In step 3 it is cut into salts, each of which
gets a copy of the group's draws (two bytes a replicate).

For score columns (``wide``) files meet the draws themselves, a few columns in a pass, first to be counted, then to be weighed
exactly; what leaves a task is counts and distinct scores of blocks, compressed. Shuffle files of a pass go before the next one,
so what lies on disk at once does not grow with the columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_text
from .crossing import class_counts, running
from .prefix import hash_rank, join_back, probability_bucket
from ..session import materialize, scratch_path, shuffles_removed
from .wide import _ready, some

FINEST = 0.0005
EDGES = tuple(FINEST * 2**k for k in range(11))
EDGES_ALL = (*[-e for e in reversed(EDGES)], 0.0, *EDGES)
CELLS = len(EDGES_ALL) + 1  # coarse buckets of a key
BLOCK_GROUPS = 1024  # groups of a block of draws, at most 65,536
PART_BLOCKS = 16  # blocks whose draws a task holds at once
COLUMN_SHARE = 32  # score columns counted in one pass
PART_FILES = 1_000_000  # files of a part that share a task
DRAWS, REPLICATES = 1 << 20, 8  # draws and replicates a task makes at once
SALT_ROWS = 50_000  # rows of a group that share a salt
MERGE = 32  # partial sums added up by one task


def edge_number(d: Column) -> Column:
    """How many edges the difference has passed: 0 to CELLS - 1, the middle one starts at 0."""
    passed = F.lit(0)
    for e in EDGES_ALL:
        passed = passed + (d >= F.lit(e)).cast("int")
    return passed


def coarse_bounds(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bounds): the highest fine bucket that has passed each edge, for edge 1 to CELLS - 1."""
    cum = running(counts, keys)
    d = F.try_divide(F.col("fp0") + F.col("neg"), F.col("n_neg")) + F.try_divide(F.col("tp0") + F.col("pos"), F.col("n_pos")) - 1.0
    rows = cum.select(*keys, "_b", edge_number(F.coalesce(d, F.lit(-2.0))).alias("_e"))
    tops = [F.max(F.when(F.col("_e") >= k, F.col("_b"))) for k in range(1, CELLS)]
    return rows.groupBy(*keys).agg(F.array(*tops).alias("bounds"))


def coarse_bucket() -> Column:
    """Number of bounds at or above the row's fine bucket: rises as scores fall."""
    passed = F.lit(0)
    for k in range(CELLS - 1):
        passed = passed + F.coalesce((F.col("_b") <= F.col("bounds")[k]).cast("int"), F.lit(0))
    return passed


def _zipped(values: np.ndarray) -> bytes:
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unzipped(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], size), kind) if size else np.zeros(0, kind)


def draw_blocks(n_groups: int, n_resamples: int, seed: int, spark) -> DataFrame:
    """(block, counts): how often each group of a block is drawn in each replicate, 16-bit numbers by group, compressed.

    The draws are those of ``metrics.resample_counts``: draw i of replicate r is the first 32 bits of md5("seed:r:i") modulo
    the groups. A task makes the draws of a few replicates over a stretch of i and sends each block of groups its counts.
    """
    stretches = max(1, -(-n_groups // DRAWS))
    shares = -(-n_resamples // REPLICATES)

    def draw(batches):
        for batch in batches:
            for job in batch.column(0).to_pylist():
                stretch, share = divmod(job, shares)
                numbers = [b"%d" % i for i in range(stretch * DRAWS, min(n_groups, (stretch + 1) * DRAWS))]
                reps = range(share * REPLICATES, min(n_resamples, (share + 1) * REPLICATES))
                hit = []
                for r in reps:
                    head = hashlib.md5(b"%d:%d:" % (seed, r), usedforsecurity=False)
                    first = []
                    for i in numbers:
                        h = head.copy()
                        h.update(i)
                        first.append(h.digest()[:4])
                    hit.append((np.frombuffer(b"".join(first), ">u4").astype(np.int64) % n_groups) * len(reps) + r - reps[0])
                cell, size = np.sort(np.concatenate(hit)), BLOCK_GROUPS * len(reps)
                blocks, at = np.unique(cell // size, return_index=True)
                counts = [_zipped(np.bincount(x % size, minlength=size).astype(np.uint16)) for x in np.split(cell, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([share] * len(blocks), pa.int32()), pa.array(counts, pa.binary())], names=["block", "share", "counts"])

    def fill(key, table):
        full = np.zeros((BLOCK_GROUPS, n_resamples), np.uint16)
        for share, counts in zip(table.column("share").to_pylist(), table.column("counts").to_pylist()):
            # a group can be drawn in several stretches
            full[:, share * REPLICATES : (share + 1) * REPLICATES] += _unzipped(counts, np.uint16).reshape(BLOCK_GROUPS, -1)
        block = key[0].as_py()
        return pa.table({"block": [block], "counts": pa.array([_zipped(full[: n_groups - block * BLOCK_GROUPS])], pa.binary())})

    jobs = stretches * shares if n_groups else 0
    made = spark.range(0, jobs, 1, max(1, min(jobs, 1024))).mapInArrow(draw, "block long, share int, counts binary")
    return made.groupBy("block").applyInArrow(fill, "block long, counts binary")


def draw_matrix(n_groups: int, n_resamples: int, seed: int, spark) -> DataFrame:
    """(block, idx, counts): how often the group with number idx is drawn in each replicate, as 16-bit numbers."""
    def rows(batches):
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = _unzipped(counts, np.uint16).reshape(-1, n_resamples)
                drawn = np.flatnonzero(full.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), block)), pa.array(drawn + block * BLOCK_GROUPS), pa.array([full[i].tobytes() for i in drawn], pa.binary())], names=["block", "idx", "counts"])

    return draw_blocks(n_groups, n_resamples, seed, spark).mapInArrow(rows, "block long, idx long, counts binary")


def block_of(idx: str = "idx") -> Column:
    return F.expr(f"{idx} div {BLOCK_GROUPS}").cast("long")


def numbered_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    """(grp, idx, n_groups): groups by the order of their hash, from 0."""
    groups = df.select(F.col(group).alias("grp")).distinct().withColumn("_h", hash_text(seed, F.col("grp")))
    return hash_rank(groups, [], "_h", "grp").select("grp", (F.col("pos") - 1).alias("idx"), F.col("n").alias("n_groups"))


def _matrix(draws: pa.Table) -> np.ndarray:
    rows = draws.column("counts").to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _rows_of(groups: pa.ChunkedArray, draws: pa.Table) -> np.ndarray:
    """Row of each group in the draws, -1 for none."""
    import pyarrow.compute as pc

    found = pc.index_in(groups.combine_chunks(), value_set=draws.column("idx").combine_chunks())
    return found.fill_null(-1).to_numpy().astype(np.int64)


COUNT_KINDS = "kid int, part int, counts binary"


def _added(parts: DataFrame, n_resamples: int) -> DataFrame:
    """(kid, counts): partial counts (kid, part, counts) of a key added up."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * CELLS * n_resamples, np.int64)
        for chunk in table.column("counts").chunks:
            for v in chunk:
                total += _unzipped(v.as_py(), np.int64)
        return pa.table({"kid": table.column("kid").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([_zipped(total)], pa.binary())})

    once = parts.groupBy("kid", "part").applyInArrow(add, COUNT_KINDS)
    return once.groupBy("kid").applyInArrow(add, COUNT_KINDS).select("kid", "counts")


def replicate_counts(cells: DataFrame, draws: DataFrame, n_resamples: int) -> DataFrame:
    """(kid, counts): int64 of CELLS x (pos, neg) x replicates, compressed, from cells (block, kid, idx, _c, pos, neg)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"kid": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        t = _matrix(right).astype(np.float64)
        row = _rows_of(left.column("idx"), right)
        kid, cell = left.column("kid").to_numpy(), left.column("_c").to_numpy().astype(np.int64)
        pos, neg = left.column("pos").to_numpy(), left.column("neg").to_numpy()
        ids, out = [], []
        order = np.argsort(kid, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(kid[order])) + 1):
            at = at[row[at] >= 0]
            if not len(at):
                continue
            c = np.zeros((2 * CELLS, len(t)))
            np.add.at(c, (2 * cell[at], row[at]), pos[at])
            np.add.at(c, (2 * cell[at] + 1, row[at]), neg[at])
            ids.append(kid[at[0]])
            out.append(_zipped((c @ t).astype(np.int64)))
        part = int(left.column("block")[0].as_py() % MERGE)
        return pa.table({"kid": pa.array(ids, pa.int32()), "part": pa.array([part] * len(ids), pa.int32()), "counts": pa.array(out, pa.binary())})

    return _added(cells.groupBy("block").cogroup(draws.groupBy("block")).applyInArrow(run, COUNT_KINDS), n_resamples)


def _blocks(left: pa.Table, right: pa.Table, n_resamples: int, size: int):
    """Files and draws of a part: for each block its files, the row of each one's group in the draws, and the draws."""
    left = left.sort_by("idx")
    files_at = left.column("idx").to_numpy() // size
    for block, counts in zip(right.column("block").to_pylist(), right.column("counts")):
        i, j = np.searchsorted(files_at, [block, block + 1])
        if i < j:
            rows = left.slice(i, j - i).combine_chunks().to_batches()[0]
            yield rows, rows.column("idx").to_numpy() - block * size, _unzipped(counts.as_py(), np.uint16).reshape(-1, n_resamples)


def column_counts(files: DataFrame, draws: DataFrame, columns, numbers: Sequence[int], bounds: np.ndarray, n_resamples: int, places: int | None) -> DataFrame:
    """``replicate_counts`` of some score columns (``wide``) from files with their group's idx. The blocks of a part meet in a
    task, so what leaves it does not grow with the blocks."""
    first = min(numbers)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros((len(numbers), 2 * CELLS, n_resamples))
        for rows, row, t in _blocks(left, right, n_resamples, BLOCK_GROUPS):
            t = t.astype(np.float64)
            for k, score, label, pick in columns(rows):
                at = row if pick is None else row[pick]
                cell = cell_of(_ready(score, places), bounds[k])
                c = np.bincount((2 * cell + 1 - label) * len(t) + at, minlength=2 * CELLS * len(t)).reshape(2 * CELLS, len(t))
                total[k - first] += c.astype(np.float64) @ t
        some = total.any(axis=(1, 2)) if left.num_rows else np.zeros(len(numbers), bool)
        ids = np.flatnonzero(some)
        return pa.table({"kid": pa.array(ids + first, pa.int32()), "part": pa.array([(key[0].as_py() + key[1].as_py()) % MERGE] * len(ids), pa.int32()),
                         "counts": pa.array([_zipped(total[i].astype(np.int64)) for i in ids], pa.binary())})

    k = ["_part", "_salt"]
    return _added(files.groupBy(*k).cogroup(draws.groupBy(*k)).applyInArrow(run, COUNT_KINDS), n_resamples)


def column_eers(files: DataFrame, draws: DataFrame, columns, bounds: np.ndarray, crossings: DataFrame, n_resamples: int, places: int | None) -> DataFrame:
    """(kid, eer) a replicate, from the files of crossing buckets. A block's files of the same score are one row."""
    # the replicates of each crossing bucket of a few columns
    chosen: dict = {}
    for r in crossings.select("kid", "_c", "reps").collect():
        chosen.setdefault(r["kid"], {})[r["_c"]] = bytes(r["reps"])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for rows, row, t in _blocks(left, right, n_resamples, BLOCK_GROUPS):
            for k, score, label, pick in columns(rows):
                s = _ready(score, places)
                at = row if pick is None else row[pick]
                cell = cell_of(s, bounds[k])
                for c, reps in chosen.get(k, {}).items():
                    inside = np.flatnonzero(cell == c)
                    if not len(inside):
                        continue
                    mine = t[:, np.frombuffer(reps, np.int32)]
                    order = inside[np.lexsort((s[inside], label[inside]))]
                    edge = np.flatnonzero(np.concatenate([[True], (np.diff(s[order]) != 0) | (np.diff(label[order]) != 0)]))
                    w = np.add.reduceat(mine[at[order]], edge, axis=0, dtype=np.uint32)
                    split = int(np.searchsorted(label[order[edge]], 1))
                    for fake, cut in ((False, slice(0, split)), (True, slice(split, len(edge)))):
                        if cut.start < cut.stop:
                            out.append((k, c, fake, s[order[edge[cut]]].tobytes(), _zipped(w[cut])))
        return pa.table([pa.array([r[i] for r in out], WEIGHED.field(i).type) for i in range(5)], schema=WEIGHED)

    k = ["_part", "_salt"]
    parts = files.groupBy(*k).cogroup(draws.groupBy(*k)).applyInArrow(run, WEIGHED_KINDS)
    return parts.groupBy("kid", "_c").cogroup(crossings.groupBy("kid", "_c")).applyInArrow(_settle, "kid int, eer double")


def cell_of(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds at or above the score; bounds fall from edge to edge, and NaN (never passed) stands at the end."""
    up = np.sort(bounds[~np.isnan(bounds)])
    return len(up) - np.searchsorted(up, score, side="left")


def replicate_crossings(counts: DataFrame, n_resamples: int) -> DataFrame:
    """(kid, _c, reps, starts): replicates of a key that cross in a coarse bucket, with tp0, fp0, n_pos, n_neg of each."""
    def run(batches):
        for batch in batches:
            kids, cells, reps, starts = [], [], [], []
            for kid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pos, neg = _unzipped(raw, np.int64).reshape(CELLS, 2, n_resamples).transpose(1, 0, 2)
                tp, fp = pos.cumsum(axis=0), neg.cumsum(axis=0)
                n_pos, n_neg = tp[-1], fp[-1]
                both = np.flatnonzero((n_pos > 0) & (n_neg > 0))
                reached = fp[:, both] / n_neg[both] + tp[:, both] / n_pos[both] >= 1.0
                at = np.where(reached.any(axis=0), reached.argmax(axis=0), CELLS - 1)
                for c in np.unique(at):
                    r = both[at == c]
                    zero = np.zeros(len(r), np.int64)
                    start = np.stack([tp[c - 1, r] if c else zero, fp[c - 1, r] if c else zero, n_pos[r], n_neg[r]])
                    kids.append(kid), cells.append(int(c)), reps.append(r.astype(np.int32).tobytes()), starts.append(start.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kids, pa.int32()), pa.array(cells, pa.int32()), pa.array(reps, pa.binary()), pa.array(starts, pa.binary())], names=["kid", "_c", "reps", "starts"])

    return counts.mapInArrow(run, "kid int, _c int, reps binary, starts binary")


WEIGHED_KINDS = "kid int, _c int, fake boolean, scores binary, weights binary"
WEIGHED = pa.schema([("kid", pa.int32()), ("_c", pa.int32()), ("fake", pa.bool_()), ("scores", pa.binary()), ("weights", pa.binary())])


def _settle(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """EERs of the replicates that cross in a bucket, from its distinct scores and their weights."""
    kid = key[0].as_py()
    reps = np.frombuffer(right.column("reps")[0].as_py(), np.int32)
    tp0, fp0, n_pos, n_neg = np.frombuffer(right.column("starts")[0].as_py(), np.int64).reshape(4, -1)
    scores = [np.frombuffer(b, np.float64) for b in left.column("scores").to_pylist()]
    fakes = np.repeat(np.array(left.column("fake").to_pylist(), bool), [len(s) for s in scores])
    weights = [_unzipped(b, np.uint32).reshape(-1, len(reps)) for b in left.column("weights").to_pylist()]
    flat = np.concatenate([np.zeros(0), *scores])
    order = np.argsort(-flat, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0])) if len(flat) else np.zeros(0, np.int64)
    start = np.stack([np.abs(fp0 / n_neg - (1.0 - tp0 / n_pos)), (fp0 / n_neg + (1.0 - tp0 / n_pos)) / 2.0])
    best = start[1].copy()
    width = max(1, (8 << 20) // max(1, len(flat)))
    for a in range(0, len(reps) if len(flat) else 0, width):
        w = np.concatenate([x[:, a : a + width] for x in weights]).astype(np.int64)[order]
        fake = fakes[order][:, None]
        tp = np.cumsum(np.add.reduceat(np.where(fake, w, 0), edge, axis=0), axis=0) + tp0[a : a + width]
        fp = np.cumsum(np.add.reduceat(np.where(fake, 0, w), edge, axis=0), axis=0) + fp0[a : a + width]
        fpr, fnr = fp / n_neg[a : a + width], 1.0 - tp / n_pos[a : a + width]
        gap = np.abs(fpr - fnr)
        first = gap.argmin(axis=0)
        cols = np.arange(gap.shape[1])
        better = gap[first, cols] < start[0, a : a + width]
        best[a : a + width] = np.where(better, ((fpr + fnr) / 2.0)[first, cols], best[a : a + width])
    return pa.table({"kid": pa.array([kid] * len(reps), pa.int32()), "eer": best})


def exact_eers(cells: DataFrame, draws: DataFrame, crossings: DataFrame, chosen: dict) -> DataFrame:
    """(kid, eer) a replicate, from distinct scores of crossing buckets (block, salt, kid, _c, idx, score, pos, neg)."""
    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            t = _matrix(right)
            row = _rows_of(left.column("idx"), right)
            kid, cell = left.column("kid").to_numpy().astype(np.int64), left.column("_c").to_numpy().astype(np.int64)
            score = left.column("score").to_numpy()
            number = kid * CELLS + cell
            order = np.argsort(number, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                at = at[row[at] >= 0]
                if not len(at):
                    continue
                k, c = int(kid[at[0]]), int(cell[at[0]])
                reps = np.frombuffer(chosen[k, c], np.int32)
                for fake, name in ((True, "pos"), (False, "neg")):
                    n = left.column(name).to_numpy()[at]
                    some = at[n > 0]
                    if len(some):
                        w = t[row[some]][:, reps].astype(np.uint32) * n[n > 0].astype(np.uint32)[:, None]
                        out.append((k, c, fake, score[some].tobytes(), _zipped(w)))
        return pa.table([pa.array([r[i] for r in out], WEIGHED.field(i).type) for i in range(5)], schema=WEIGHED)

    parts = cells.groupBy("block", "salt").cogroup(draws.groupBy("block", "salt")).applyInArrow(weigh, WEIGHED_KINDS)
    return parts.groupBy("kid", "_c").cogroup(crossings.groupBy("kid", "_c")).applyInArrow(_settle, "kid int, eer double")


def bootstrap(df: DataFrame, keys: Sequence[str], n_resamples: int, seed: int, group: str, label: str, score: str, buckets: int) -> DataFrame:
    """(keys, eer) of every replicate with both classes.

    Keys are slices or a grid of parameters: one small row a key and one number a (key, replicate) pass the driver.
    """
    keys = list(keys)
    spark = df.sparkSession
    numbers = materialize(numbered_groups(df, group, seed), "groups")
    n_groups = numbers.agg(F.max("n_groups")).first()[0] or 0
    rows = df.select(*keys, F.col(group).alias("grp"), F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score"))
    rows = join_back(rows, numbers.drop("n_groups"), ["grp"]).withColumn("_b", probability_bucket(F.col("score"), buckets))
    rows = materialize(rows.groupBy(*keys, "idx", "_b", "score").agg(*class_counts()), "group-scores")
    counts = rows.groupBy(*keys, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bounds = coarse_bounds(counts, keys).toPandas()
    schema = "kid int, bounds array<int>" + "".join(f", `{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    named = spark.createDataFrame([(i, [None if b is None or b != b else int(b) for b in r["bounds"]], *[r[k] for k in keys]) for i, r in enumerate(bounds.to_dict("records"))], schema)
    if keys:
        placed = join_back(rows, named, keys)
    else:
        only = named.first()
        placed = rows.withColumn("kid", F.lit(0)).withColumn("bounds", F.array(*[F.lit(b).cast("int") for b in (only["bounds"] if only else [None] * (CELLS - 1))]))
    placed = placed.withColumn("_c", coarse_bucket()).select("kid", "idx", "_c", "score", "pos", "neg")

    draws = materialize(draw_matrix(n_groups, n_resamples, seed, spark), "draws")
    cells = placed.groupBy("kid", "idx", "_c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("block", block_of())
    crossings = materialize(replicate_crossings(replicate_counts(cells, draws, n_resamples), n_resamples), "crossings")
    found = settled(placed.join(F.broadcast(crossings.select("kid", "_c")), ["kid", "_c"]), draws, crossings)
    return join_back(found, named.drop("bounds"), ["kid"]).select(*keys, "eer")


def settled(inside: DataFrame, draws: DataFrame, crossings: DataFrame) -> DataFrame:
    """(kid, eer) a replicate, from the rows of crossing buckets (kid, _c, idx, score, pos, neg)."""
    chosen = {(r["kid"], r["_c"]): bytes(r["reps"]) for r in crossings.select("kid", "_c", "reps").collect()}
    exact = materialize(inside.groupBy("kid", "_c", "idx", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "crossing-scores")
    salts = exact.groupBy("idx").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    one = F.coalesce("salts", F.lit(1))
    cut = join_back(exact, salts, ["idx"], "left").withColumn("salt", F.pmod(F.xxhash64("kid", "score"), one).cast("int"))
    needed = draws.join(exact.select("idx").distinct(), "idx", "left_semi")
    copies = join_back(needed, salts, ["idx"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1)))
    return exact_eers(cut.withColumn("block", block_of()).drop("salts"), copies.drop("salts"), crossings, chosen)


def numbered_files(files: DataFrame, group: str, seed: int) -> DataFrame:
    """Files with the number idx of their group and a number _cut of their own, written once."""
    numbers = materialize(numbered_groups(files, group, seed), "groups").select(F.col("grp").alias(group), "idx")
    return materialize(join_back(files, numbers, [group]).withColumn("_cut", F.monotonically_increasing_id()), "numbered-files")


def bootstrap_columns(files: DataFrame, columns, n_columns: int, bounds: DataFrame, n_resamples: int, seed: int, group: str, places: int | None = None) -> DataFrame:
    """(col, eer) of every replicate with both classes, for the score columns (``wide``) of files.

    bounds (col, edge, bound): the scores at which a column's error rates have passed EDGES_ALL, which cut it into coarse
    buckets. They and the replicates' crossing buckets pass the driver, a few numbers a column. Files may come from
    ``numbered_files``.
    """
    spark = files.sparkSession
    with shuffles_removed(spark):
        placed = files if {"idx", "_cut"} <= set(files.columns) else numbered_files(files, group, seed)
        n_groups = (placed.agg(F.max("idx")).first()[0] if n_columns else None)
        n_groups = 0 if n_groups is None else n_groups + 1
        at = np.full((n_columns, CELLS - 1), np.nan)
        for r in bounds.collect():
            at[r["col"], r["edge"]] = r["bound"]
        part = F.expr(f"idx div {BLOCK_GROUPS * PART_BLOCKS}").cast("long")
        # parts of very large groups, at most one in PART_FILES files, are dealt to several tasks
        large = placed.groupBy(part.alias("_part")).count().where(F.col("count") > PART_FILES).collect()
        salts = {r["_part"]: -(-r["count"] // PART_FILES) for r in large}
        n_salts = F.coalesce(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])[F.col("_part")], F.lit(1)) if salts else F.lit(1)
        blocks = materialize(draw_blocks(n_groups, n_resamples, seed, spark), "draws")
        draws = blocks.withColumn("_part", F.expr(f"block div {PART_BLOCKS}").cast("long")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (n_salts - 1).cast("long"))))
        path = scratch_path(spark, "replicate-eers")
        for a in range(0, n_columns, COLUMN_SHARE):
            numbers = range(a, min(n_columns, a + COLUMN_SHARE))
            table, mine = some(placed, columns, numbers, ["idx", "_cut"])
            dealt = table.withColumn("_part", part).withColumn("_salt", F.pmod("_cut", n_salts).cast("long")).drop("_cut")
            counts = column_counts(dealt, draws, mine, numbers, at, n_resamples, places)
            crossings = materialize(replicate_crossings(counts, n_resamples), "crossings")
            column_eers(dealt, draws, mine, at, crossings, n_resamples, places).write.mode("append").parquet(path)
        return spark.read.schema("kid int, eer double").parquet(path).withColumnRenamed("kid", "col")
