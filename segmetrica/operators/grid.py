"""Formula grids and weight curves: parameters are exploded next to each row, never cross-joined."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import algebra as A
from . import metrics as M
from . import wide as W
from .pooling import POOLINGS, column_name, pool
from .prefix import join_back

MAX_FORMULAS = 4096
# Fixed default axes of the sweep.
COMBINES = ("max", "prob_or", "sum_clipped")
EXPONENTS = (0.0, 1.0)
MIXTURE_WEIGHTS = (0.0, 0.25, 0.5)
MIXTURE_POOLINGS = ("max", "mean")
ANCHORS = (  # name, anchor, component pooling, mixture pooling, mixture weight
    ("sub01_file_max_components", "sub01", "max", "max", 0.0),
    ("sub03_file_raw_mixture_max", "sub03", "mean", "max", 1.0),
    ("sub04_file_mean_components", "sub04", "mean", "max", 0.0),
    ("sub06_file_mean_components", "sub06", "mean", "max", 0.0),
)
FIELDS = ("voice_pooling", "music_pooling", "mixture_pooling", "combine", "voice_exponent", "music_exponent", "mixture_weight")


def formula_key(f: dict) -> str:
    """Identity without the name: 16 hex digits of SHA-256 over sorted JSON."""
    text = json.dumps({k: f[k] for k in FIELDS}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def build_grid(poolings: Sequence[str] = tuple(POOLINGS), combines=COMBINES, exponents=EXPONENTS,
               weights=MIXTURE_WEIGHTS, mixture_poolings=MIXTURE_POOLINGS, anchors: bool = True,
               tie_poolings: bool = True) -> list[dict]:
    """Parameter list in fixed order, anchors first and always kept, repeats dropped by key."""
    if not (poolings and combines and exponents and weights and mixture_poolings):
        raise ValueError("grid axes must not be empty")
    out, seen = [], set()

    def put(f: dict, force: bool = False) -> None:
        f["formula_key"] = formula_key(f)
        if force or f["formula_key"] not in seen:
            seen.add(f["formula_key"])
            out.append(f)

    for name, anchor, comp, mix, w in ANCHORS if anchors else ():
        put(dict(name=name, anchor=anchor, voice_pooling=comp, music_pooling=comp, mixture_pooling=mix, combine="max",
                 voice_exponent=1.0, music_exponent=1.0, mixture_weight=w), force=True)
    pairs = [(v, v) for v in poolings] if tie_poolings else [(v, m) for v in poolings for m in poolings]
    points = [
        (v, m, c, ve, me, float(w), x)
        for v, m in pairs for c in combines for ve in exponents for me in exponents for w in weights
        for x in (mixture_poolings if w > 0 else mixture_poolings[:1])
    ]
    for v, m, c, ve, me, w, x in points:
        name = f"v{v}-m{m}-{c}-ve{ve:g}-me{me:g}-mix{w:g}" + (f"-{x}" if w > 0 else "")
        put(dict(name=name, anchor="", voice_pooling=v, music_pooling=m, mixture_pooling=x, combine=c,
                 voice_exponent=float(ve), music_exponent=float(me), mixture_weight=w))
    if len(out) > MAX_FORMULAS:
        raise ValueError("grid is too large")
    return out


def pooled_streams(segments: DataFrame, items: DataFrame, key: str = "file_id") -> DataFrame:
    """Each stream pooled once per pooling: columns voice_<p>, music_<p>, mixture_<p>; silent = 0.0."""
    wide = pool(segments, [key, "stream"])
    cols = [column_name(p) for p in POOLINGS]
    picked = wide.groupBy(key).agg(
        *[F.max(F.when(F.col("stream") == s, F.col(c))).alias(f"{s}_{c}") for s in ("voice", "music", "mixture") for c in cols]
    )
    d = items.join(picked, key, "left")
    return d.na.fill(0.0, [f"{s}_{c}" for s in ("voice", "music", "mixture") for c in cols])


GRID_TYPE = "array<struct<formula_id:int,v:int,m:int,x:int,combine:string,w:double>>"


def score_grid(pooled: DataFrame, grid: Sequence[dict], keep: Sequence[str]) -> DataFrame:
    """Long form (keep..., formula_id, score) of every formula.

    Pool, gate both components, combine, blend the ungated mixture last, clip. Gated
    components are computed once per (pooling, exponent); the parameter list is a bounded
    constant exploded next to each file, so the generated code does not grow with it.
    """
    def axis(pairs):
        return sorted({p for p in pairs})

    vs = axis((f["voice_pooling"], f["voice_exponent"]) for f in grid)
    ms = axis((f["music_pooling"], f["music_exponent"]) for f in grid)
    xs = axis(f["mixture_pooling"] for f in grid)
    gated = lambda s, ax: F.array(*[
        A.gate(F.col(f"{s}_{column_name(p)}"), F.col(f"{s}_present"), e) for p, e in ax])
    rows = json.dumps([
        dict(formula_id=i, v=vs.index((f["voice_pooling"], f["voice_exponent"])), m=ms.index((f["music_pooling"], f["music_exponent"])),
             x=xs.index(f["mixture_pooling"]), combine=f["combine"], w=f["mixture_weight"])
        for i, f in enumerate(grid)
    ])
    long = pooled.select(
        *keep, gated("voice", vs).alias("_v"), gated("music", ms).alias("_m"),
        F.array(*[F.col("mixture_" + column_name(p)) for p in xs]).alias("_x"),
        F.explode(F.from_json(F.lit(rows), GRID_TYPE)).alias("f"),
    ).select(*keep, "f.formula_id", "f.combine", "f.w", F.expr("_v[f.v]").alias("v"), F.expr("_m[f.m]").alias("m"), F.expr("_x[f.x]").alias("x"))
    mixed = A.combine(F.col("v"), F.col("m"), F.col("combine"))
    score = F.when(F.col("w") > 0, A.linear_blend(mixed, F.col("x"), F.col("w"))).otherwise(mixed)
    return long.select(*keep, "formula_id", A.clip(score, 0.0, 1.0).alias("score"))


def grid_columns(grid: Sequence[dict], numbers: Sequence[int] | None = None):
    """The scores of ``score_grid``, or of the formulas with some numbers, as columns of a batch (``wide``): gated components
    once per (pooling, exponent)."""
    chosen = range(len(grid)) if numbers is None else sorted(numbers)
    reads = ["label"]
    for i in chosen:
        f = grid[i]
        reads += [f"{s}_{column_name(f[s + '_pooling'])}" for s in ("voice", "music")]
        reads += [f"{s}_present" for s in ("voice", "music") if f[s + "_exponent"] != 0]
        reads += ["mixture_" + column_name(f["mixture_pooling"])] if f["mixture_weight"] > 0 else []

    def gate(rows, stream, pooling, exponent):
        x = W.floats(rows, f"{stream}_{column_name(pooling)}")
        if exponent == 0:
            return x
        p = np.clip(W.floats(rows, f"{stream}_present"), 0.0, 1.0)
        return p * x if exponent == 1 else p**exponent * x

    forms = {"max": np.maximum, "prob_or": lambda v, m: 1.0 - (1.0 - v) * (1.0 - m), "sum_clipped": lambda v, m: np.minimum(1.0, v + m),
             "mean": lambda v, m: (v + m) * 0.5}

    def columns(rows):
        label = rows.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        made: dict = {}

        def once(key, make):
            if key not in made:
                made[key] = make()
            return made[key]

        for i in chosen:
            f = grid[i]
            at = (f["combine"], f["voice_pooling"], f["voice_exponent"], f["music_pooling"], f["music_exponent"])
            if ("mixed", at) not in made:  # formulas that differ in their mixture only stand together
                made = {k: v for k, v in made.items() if k[0] != "mixed"}
            v = once(("voice", *at[1:3]), lambda: gate(rows, "voice", *at[1:3]))
            m = once(("music", *at[3:]), lambda: gate(rows, "music", *at[3:]))
            score, w = once(("mixed", at), lambda: forms[f["combine"]](v, m)), f["mixture_weight"]
            if w > 0:
                score = (1.0 - w) * score + w * once(("mixture", f["mixture_pooling"]), lambda: W.floats(rows, "mixture_" + column_name(f["mixture_pooling"])))
            yield i, np.clip(score, 0.0, 1.0), label, None

    columns.reads, columns.some = sorted(set(reads)), lambda some: grid_columns(grid, some)
    return columns


def grid_means(pooled: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """(formula_id, n, mean_score, max_score) of every formula; each task leaves a row a formula. Missing scores count in n only."""
    columns = grid_columns(grid)

    def run(batches):
        n, some, total, top = (np.zeros(len(grid)) for _ in range(4))
        top -= np.inf
        for rows in batches:
            for i, score, _, _ in columns(rows):
                there = score[~np.isnan(score)]
                n[i] += len(score)
                some[i] += len(there)
                total[i] += there.sum()
                top[i] = there.max(initial=top[i])
        if n.any():
            ids = np.arange(len(grid), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x.astype(np.int64)) for x in (n, some)), pa.array(total), pa.array(top)], names=["formula_id", "n", "some", "total", "top"])

    parts = pooled.mapInArrow(run, "formula_id int, n long, some long, total double, top double")
    any_ = F.sum("some") > 0
    return parts.groupBy("formula_id").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("some")).alias("mean_score"), F.when(any_, F.max("top")).alias("max_score"))


def sweep(pooled: DataFrame, grid: Sequence[dict], n_resamples: int = 1000, seed: int = 42, blend_weight: float = 0.5,
          metric: str = "worst_family", places: int | None = None) -> DataFrame:
    """Rank formulas by a robust error: (metric, overall EER, interval upper bound, key). ``places`` rounds the scores first."""
    from ..session import materialize, shuffles_removed
    from .resampling import EDGES_ALL, bootstrap_columns, numbered_files

    k = ["formula_id"]
    columns = grid_columns(grid)
    with shuffles_removed(pooled.sparkSession):
        # what formulas read of the pooled streams is read by every pass, so it is made once, with the groups' numbers;
        # formula scores are not stored
        files = pooled.select("family", *columns.reads, *(["grp"] if n_resamples else []))
        files = numbered_files(files, "grp", seed) if n_resamples else materialize(files, "pooled")
        overall, families, bounds = W.ranked(files, "family", columns, len(grid), places=places, edges=EDGES_ALL if n_resamples else ())
        overall, families = (d.withColumnRenamed("col", "formula_id") for d in (overall, families))
        out = join_back(overall, M.worst_family(families, overall, k, blend_weight), k)
        if n_resamples:
            per = bootstrap_columns(files, columns, len(grid), bounds, n_resamples, seed, "grp", places).withColumnRenamed("col", "formula_id")
            # every formula has a row, also one without a replicate of both classes
            ci = per.groupBy(*k).agg(F.expr("percentile(eer, array(0.025D, 0.975D))").alias("_q"))
            ci = ci.select(*k, F.get("_q", F.lit(0)).alias("lower"), F.get("_q", F.lit(1)).alias("upper"))
            out = join_back(out, ci, k, "left")
        else:
            out = out.withColumn("lower", F.lit(None).cast("double")).withColumn("upper", F.lit(None).cast("double"))
        return rank_formulas(describe(materialize(out, "formulas"), grid), metric)


def describe(df: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """Formula names and parameters by position (the grid is a bounded constant)."""
    pick = lambda field: F.element_at(F.array(*[F.lit(f[field]) for f in grid]), F.col("formula_id") + 1)
    return df.select("*", *[pick(c).alias(c) for c in ("name", "anchor", "formula_key", *FIELDS)])


def rank_formulas(df: DataFrame, metric: str = "worst_family") -> DataFrame:
    """Total order; undefined metrics go last. The table has one row per formula."""
    column = {"worst_family": "worst_family_eer", "blend": "blend_eer", "overall": "eer"}[metric]
    last = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    order = Window.orderBy(last(column), last("eer"), last("upper"), F.col("formula_key"), F.col("formula_id"))
    return df.withColumn("rank", F.row_number().over(order)).withColumn("selection_value", last(column))


WEIGHTS = tuple(round(0.05 * i, 2) for i in range(21))


def weight_curve(df: DataFrame, heads: dict, keys: Sequence[str] = (), weights=WEIGHTS, places: int | None = None) -> DataFrame:
    """EER of every head at every blend weight, in two passes over the rows: (keys, head, w, eer).

    heads: name -> (label column, function of a batch and a weight giving the scores, presence column or None). keys: at
    most one string column, a row's part.
    """
    if len(keys) > 1:
        raise ValueError("at most one key column")
    cells = [(h, float(w)) for h in heads for w in weights]

    def columns(rows):
        for i, (h, w) in enumerate(cells):
            y, score, p = heads[h]
            if i % len(weights) == 0:
                label = W.floats(rows, y)
                keep = ~np.isnan(label) if p is None else ~np.isnan(label) & (W.floats(rows, p) == 1)
                pick = np.flatnonzero(keep)
                label = label[pick].astype(np.int64)
                part = rows.take(pa.array(pick))
            yield i, score(part, w), label, pick

    code = keys[0] if keys else "_code"
    d = df if keys else df.withColumn(code, F.lit(None).cast("string"))
    found = W.eer_by_code(d, code, columns, len(cells), places=places)
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cells]), F.col("col") + 1)
    return found.select(*([F.col("code").alias(code)] if keys else []), pick(0).alias("head"), pick(1).alias("w"), "eer")


def smooth_argmin(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight with the lowest three-point mean (NULLs skipped), the smallest one on ties."""
    near = Window.partitionBy(*keys).orderBy("w").rowsBetween(-1, 1)
    s = curve.withColumn("smooth", F.avg("eer").over(near))
    return s.filter("smooth IS NOT NULL").groupBy(*keys).agg(
        F.min(F.struct("smooth", "w")).getField("w").alias("chosen_w"), F.min("smooth").alias("smooth_eer")
    )


def transfer_weights(curves: DataFrame, for_panels: str) -> DataFrame:
    """Weights fitted on one part and read on others: (head, scope, fitted_on, read_on, chosen_w, eer, base_eer).

    curves(scope, part, head, w, eer): scope ``split`` has the parts among which weights move, each part's smoothed minimum
    being read on all other parts; on the parts of scope ``panel`` the weights of split ``for_panels`` are read. base_eer
    is the error at weight 0. The curves are a small table, so both directions and the panels are one plan.
    """
    from ..session import materialize

    c = materialize(curves, "curves")
    chosen = smooth_argmin(c.where("scope = 'split'"), ["head", "part"]).select("head", F.col("part").alias("fitted_on"), "chosen_w")
    read = c.select("head", "scope", F.col("part").alias("read_on"), F.col("w").alias("chosen_w"), "eer")
    base = c.where("w = 0").select("head", "scope", F.col("part").alias("read_on"), F.col("eer").alias("base_eer"))
    allowed = F.when(F.col("scope") == "split", F.col("read_on") != F.col("fitted_on")).otherwise(F.col("fitted_on") == for_panels)
    moved = chosen.join(read, ["head", "chosen_w"]).where(allowed).join(base, ["head", "scope", "read_on"])
    return moved.select("head", "scope", "fitted_on", "read_on", "chosen_w", "eer", "base_eer")


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Row with the lexicographically smallest order per key, as an aggregate."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")


@contextmanager
def _by_key(df: DataFrame, keys: Sequence[str], x: str, y: str):
    """Rows (_h, _x, _y) with a hash of their keys, written once and removed in the end, and the keys in order of their hashes
    (keys, _h, _both: whether both classes are there). A small row a key passes the driver, as the keys are a grid of parameters."""
    from ..session import remove, scratch_path, shuffles_removed

    spark, keys = df.sparkSession, list(keys)
    path = scratch_path(spark, "affine")
    h = F.xxhash64(F.lit(0), *[c for k in keys for c in (F.col(k).isNull(), F.col(k))])
    with shuffles_removed(spark):
        rows = df.select(*keys, h.alias("_h"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        rows.write.parquet(path)
        data = spark.read.schema(rows.schema).parquet(path)
        found = data.groupBy(*keys, "_h").agg(F.coalesce(F.min("_y") < F.max("_y"), F.lit(False)).alias("_both"))
        named = sorted(found.collect(), key=lambda r: r["_h"])
        if len({r["_h"] for r in named}) < len(named):
            raise ValueError("two keys have the same hash")
        yield data.select("_h", "_x", "_y"), named, found.schema
        remove(spark, path)


def _key_sums(data: DataFrame, named: Sequence, parts, names: Sequence[str]) -> np.ndarray:
    """Sums over the rows of each key, (names, keys): a task adds up its own rows, a small row a key and task moves.

    parts(kid, x, y) gives an array for each name. A missing x or y counts for nothing, as in a sum over rows.
    """
    hashes = np.array([r["_h"] for r in named], np.int64)

    def run(batches):
        total = np.zeros((len(names), len(hashes)))
        for batch in batches:
            kid = np.searchsorted(hashes, batch.column(0).to_numpy())
            x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            for i, v in enumerate(parts(kid, x, y)):
                total[i] += np.bincount(kid, np.where(np.isnan(v), 0.0, v), len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes), dtype=np.int32)), *(pa.array(v) for v in total)], names=["kid", *names])

    kinds = "kid int, " + ", ".join(f"{c} double" for c in names)
    out = np.zeros((len(names), len(hashes)))
    for r in data.mapInArrow(run, kinds).groupBy("kid").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[:, r["kid"]] = r[1:]
    return out


def affine_fits(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "label", c: float = 100.0,
                tolerance: float = 1e-9, max_steps: int = 500) -> DataFrame:
    """Regularised one-feature logistic fit for every key at once: (keys, a, b), by damped Newton steps.

    Minimises c * sum(loss) + a^2 / 2. Each step is one pass over the data that leaves one small row per key and task; the
    parameters go along with the step, so no row moves. The number of keys is the size of a parameter grid. A step that raises
    the loss is halved; a key is done when its step is at most ``tolerance`` of its parameters. A key with one class
    only has no minimum and gets NULL parameters. If some key isn't done after ``max_steps``, an error names how many.
    """
    with _by_key(df, keys, x, y) as (data, named, schema):
        return _with_keys(df, keys, named, schema, dict(zip("ab", _affine_fits(data, named, c, tolerance, max_steps))))


def _with_keys(df: DataFrame, keys: Sequence[str], named: Sequence, schema, numbers: dict) -> DataFrame:
    """The keys and some numbers of each, NaN as NULL."""
    out = [(*[r[k] for k in keys], *[None if np.isnan(v[i]) else float(v[i]) for v in numbers.values()]) for i, r in enumerate(named)]
    return df.sparkSession.createDataFrame(out, T.StructType([*[schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in numbers]]))


def _affine_fits(data: DataFrame, named: Sequence, c: float = 100.0, tolerance: float = 1e-9, max_steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """a and b of each key, NaN with one class."""
    both = np.array([r["_both"] for r in named], bool)
    n = len(both)
    # a, b: the best so far with its loss; da, db: the step to try from there
    a, b, da, db = (np.zeros(n) for _ in range(4))
    best, done = np.full(n, np.inf), ~both
    for _ in range(max_steps):
        if done.all():
            break
        ta, tb, open_ = a + da, b + db, ~done

        def parts(kid, x, y):
            at = np.flatnonzero(open_[kid])
            k, x, y = kid[at], x[at], y[at]
            z = ta[k] * x + tb[k]
            p, e = _logistic(z), np.exp(-np.abs(z))
            r, w = p - y, p * (1.0 - p)
            # log(1 + exp(z)) - y z without overflow
            for v in (np.maximum(z, 0.0) - z * y + np.log1p(e), r * x, r, w * x * x, w * x, w):
                out = np.zeros(len(kid))
                out[at] = v
                yield out

        s = _key_sums(data, named, parts, ["loss", "ga", "gb", "haa", "hab", "hbb"])
        loss, ga, gb = s[0] * c + ta * ta / 2, s[1] * c + ta, s[2] * c
        haa, hab, hbb = s[3] * c + 1.0, s[4] * c, s[5] * c
        det = haa * hbb - hab * hab
        with np.errstate(divide="ignore", invalid="ignore"):
            na, nb = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        better = loss <= best + np.abs(loss) * 1e-14
        go, back = open_ & better, open_ & ~better
        a, b, best = np.where(go, ta, a), np.where(go, tb, b), np.where(go, loss, best)
        da, db = np.where(go, na, np.where(back, da / 2, da)), np.where(go, nb, np.where(back, db / 2, db))
        # a flat second derivative (det 0) leaves nothing to gain
        flat = go & (det == 0)
        done |= flat | (open_ & (np.abs(da) + np.abs(db) <= tolerance * (np.abs(a) + np.abs(b) + 1.0)))
    if not done.all():
        raise ValueError(f"{int((~done).sum())} fits did not converge in {max_steps} steps")
    return np.where(both, a, np.nan), np.where(both, b, np.nan)


TAUS = (0.25, 0.5, 1.0, 2.0, 4.0, 1000.0)
GAMMAS = (0.0, 1.0, 2.0)


def fit_pooling(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Affine fit, EER of sigmoid(x / 8) and cross-entropy of every cell: (keys, a, b, eer, bce).

    features(keys..., x, label): pooled logits of eligible files. They are written once and read by the fit, the error
    rates and the cross-entropy; only scores of the buckets in which error rates cross move.
    """
    with _by_key(features, keys, "x", "label") as (data, named, schema):
        a, b = _affine_fits(data, named)

        def scores(rows):
            x, y = W.floats(rows, "_x"), W.floats(rows, "_y")
            pick = np.flatnonzero(~np.isnan(y))
            yield 0, _logistic(x[pick] / 8.0), y[pick].astype(np.int64), pick

        found = {int(r["code"]): r["eer"] for r in W.eer_by_code(data, "_h", scores, 1).collect()}
        eer = np.array([found.get(r["_h"]) for r in named], float)

        def losses(kid, x, y):
            p = _logistic(a[kid] * x + b[kid])
            loss = y * np.log(np.maximum(np.minimum(p, 1.0), 1e-6)) + (1 - y) * np.log(np.maximum(np.minimum(1.0 - p, 1.0), 1e-6))
            return -loss, (~np.isnan(loss)).astype(float)

        loss, n = _key_sums(data, named, losses, ["loss", "n"])
        bce = np.divide(loss, n, out=np.full(len(n), np.nan), where=n > 0)
        return _with_keys(features, keys, named, schema, dict(a=a, b=b, eer=eer, bce=bce))


def _logistic(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0 / (1.0 + e), e / (1.0 + e))
