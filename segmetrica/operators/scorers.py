"""Frozen linear and tree scorers as column expressions, and model-table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import algebra as A
from ..functions.features import complete, feature_names, feature_set
from .prefix import attach

MAX_TREES = 512
LEAF = -1
LEAF_MARK = -2


def linear_score(df: DataFrame, features: Sequence[str], model: Mapping, out: str) -> DataFrame:
    """sigmoid(((x - mean) / scale) . coef + intercept) over named columns."""
    sizes = {len(model[k]) for k in ("mean", "scale", "coef")} | {len(features)}
    if len(sizes) != 1 or min(model["scale"]) <= 0:
        raise ValueError("linear model does not fit the features")
    z = F.lit(float(model["intercept"]))
    for name, m, s, c in zip(features, model["mean"], model["scale"], model["coef"]):
        z = z + (F.col(name) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(c))
    return df.withColumn(out, A.sigmoid(z))


def linear_sum_array(vector, mean: Column, scale: Column, coef: Column) -> Column:
    """((x - mean) / scale) . coef of an array. Sums of parts add up, so a part that many rows share needs to be computed once."""
    x = F.zip_with(vector, mean, lambda a, b: a.cast("double") - b)
    x = F.zip_with(x, scale, lambda a, b: a / b)
    return A.dot(x, coef)


def linear_score_array(df: DataFrame, vector: str, mean: Column, scale: Column, coef: Column, intercept, out: str) -> DataFrame:
    """The same for hundreds of values: arrays, not columns."""
    return df.withColumn(out, A.sigmoid(linear_sum_array(vector, mean, scale, coef) + F.lit(float(intercept))))


def flatten_tree(tree: Mapping) -> dict:
    """A tree of depth <= 2 as two levels of splits and four leaf values.

    A leaf above the last level becomes a split both sides of which give its value.
    """
    left, right = tree["children_left"], tree["children_right"]

    def split(node: int) -> tuple[int, float]:
        return (tree["feature"][node], float(tree["threshold"][node])) if left[node] != LEAF else (0, 0.0)

    def leaf(node: int) -> float:
        if left[node] != LEAF:
            raise ValueError("tree is deeper than two levels")
        return float(tree["value"][node])

    def pair(node: int) -> tuple[float, float]:
        return (leaf(left[node]), leaf(right[node])) if left[node] != LEAF else (leaf(node), leaf(node))

    a, b = (left[0], right[0]) if left[0] != LEAF else (0, 0)
    (f0, t0), (f1, t1), (f2, t2) = split(0), split(a), split(b)
    (v0, v1), (v2, v3) = pair(a), pair(b)
    return dict(f0=f0, t0=t0, f1=f1, t1=t1, f2=f2, t2=t2, v0=v0, v1=v1, v2=v2, v3=v3)


SUM_TREES = 16  # trees added up before the partial sums are


def tree_logit(model: Mapping):
    """A vectorised function of the feature columns: the model's log odds, block by block.

    Trees have two levels: three comparisons of whole columns name a row's leaf. NULL and NaN go right, as in ``x <= t``.
    """
    rate, first = float(model["learning_rate"]), float(model["initial_log_odds"])
    trees = [flatten_tree(t) for t in model["trees"]]
    # by three bits: right at the root, at its left child, at its right child
    leaves = [np.array([rate * f[f"v{2 * (i >> 2) + (i & 1 if i >> 2 else i >> 1 & 1)}"] for i in range(8)]) for f in trees]

    @F.arrow_udf(DoubleType())
    def run(*columns: pa.Array) -> pa.Array:
        x = [c.to_numpy(zero_copy_only=False) for c in columns]
        total = np.full(len(x[0]), first)
        for at in range(0, len(trees), SUM_TREES):
            part = np.zeros(len(total))
            for f, values in zip(trees[at : at + SUM_TREES], leaves[at : at + SUM_TREES]):
                root, left, right = ((~(x[f[f"f{i}"]] <= f[f"t{i}"])).view(np.uint8) for i in range(3))
                part += values[root << 2 | left << 1 | right]
            total += part
        return pa.array(total)

    return run


def tree_scores(df: DataFrame, set_name: str, models: Mapping[str, tuple[str, Mapping]]) -> DataFrame:
    """Score one feature set with boosted-tree exports: models is out -> (its own set, model).

    Sets nest by prefix, so models of smaller sets share the columns of the larger one. A
    score is NULL where the inputs of its own set are incomplete.

    A model is a bounded constant (at most MAX_TREES small trees) that travels with a vectorised
    function: no join, no shuffle, and no generated code that grows with the trees (several models
    spelled out in one projection pass the limit of a method, and then run uncompiled). Inputs are
    rounded to float32 and compared as doubles; equal goes left.

    Do not filter on the result in the same plan: the optimizer would push the filter down
    and compute the model again. Filter on the inputs, or after a write.
    """
    keep = df.columns
    sets = sorted({own for own, _ in models.values()})
    wide = df.select(
        "*", *[complete(own).alias(f"_ok_{own}") for own in sets],
        *[c.cast("float").cast("double").alias(f"_x{i}") for i, (_, c) in enumerate(feature_set(set_name))],
    )
    raws, scores = [], []
    for k, (out, (own, model)) in enumerate(models.items()):
        names = feature_names(own)
        if not 1 <= len(model["trees"]) <= MAX_TREES or feature_names(set_name)[: len(names)] != names:
            raise ValueError("model does not fit the feature set")
        raws.append(tree_logit(model)(*[f"_x{i}" for i in range(len(names))]).alias(f"_raw{k}"))
        scores.append(F.when(F.col(f"_ok_{own}"), A.sigmoid(F.col(f"_raw{k}"))).alias(out))
    wide = wide.select(*keep, *[f"_ok_{own}" for own in sets], *raws)
    return wide.select(*keep, *scores)


def tree_score(df: DataFrame, set_name: str, model: Mapping, out: str) -> DataFrame:
    """One model on its own feature set."""
    return tree_scores(df, set_name, {out: (set_name, model)})


def tree_nodes(spark, model: Mapping, model_id: str = "model") -> DataFrame:
    """One row per node of a (small, bounded) model export."""
    rows = [
        (model_id, t, n, int(tr["children_left"][n]), int(tr["children_right"][n]), int(tr["feature"][n]),
         float(tr["threshold"][n]), float(tr["value"][n]))
        for t, tr in enumerate(model["trees"]) for n in range(len(tr["children_left"]))
    ]
    return spark.createDataFrame(
        rows, "model string, tree int, node int, child_left int, child_right int, feature int, threshold double, value double"
    )


def tree_violations(nodes: DataFrame, keys: Sequence[str], n_features: int, max_depth: int = 2) -> DataFrame:
    """Broken nodes of tree tables: (keys, node, rule).

    A child must exist, come after its parent, have exactly one parent; leaves carry the
    sentinel feature and threshold; every node is reachable within max_depth.
    """
    keys = list(keys)
    leaf = F.col("child_left") == LEAF
    edges = nodes.filter(~leaf).select(*keys, F.col("node").alias("parent"),
                                       F.explode(F.array("child_left", "child_right")).alias("node"))
    parents = edges.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n_parents"), F.max("parent").alias("parent"))
    n = nodes.alias("n")
    p = parents.alias("p")
    on = (F.col("n.node") == F.col("p.node"))
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"p.{k}"))
    j = n.join(p, on, "full").select(
        *[F.coalesce(f"n.{k}", f"p.{k}").alias(k) for k in keys],
        F.coalesce("n.node", "p.node").alias("node"),
        F.col("n.node").isNull().alias("missing"),
        "n.child_left", "n.child_right", "n.feature", "n.threshold", "n.value", "n_parents", "parent",
    )
    depth = F.col("depth")
    # Depth by walking up max_depth + 1 parents.
    walk = parents.filter(F.col("n_parents") == 1)
    d = nodes.select(*keys, "node", F.col("node").alias("_at"), F.lit(0).alias("depth"))
    for _ in range(max_depth + 1):
        up = walk.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("node").alias("_n"), F.col("parent").alias("_p"))
        cond = F.col("_at") == F.col("_n")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
        d = d.join(up, cond, "left").select(
            *keys, "node", F.coalesce("_p", F.when(F.col("_at") == 0, F.lit(0))).alias("_at"),
            (depth + F.when(F.col("_p").isNotNull(), 1).otherwise(0)).alias("depth"),
        )
    deep = d.filter((depth > max_depth) | F.col("_at").isNull() | (F.col("_at") != 0)).select(
        *keys, "node", F.lit("unreachable or too deep").alias("rule"))
    is_leaf = F.col("child_left") == LEAF
    rules = F.array(
        F.when(F.col("missing"), "missing child"),
        F.when(~F.col("missing") & (F.col("node") > 0) & (F.coalesce("n_parents", F.lit(0)) != 1), "not exactly one parent"),
        F.when((F.col("node") == 0) & (F.coalesce("n_parents", F.lit(0)) > 0), "root has a parent"),
        F.when(is_leaf & ((F.col("child_right") != LEAF) | (F.col("feature") != LEAF_MARK) | (F.col("threshold") != LEAF_MARK)), "leaf sentinels"),
        F.when(~is_leaf & ((F.col("child_left") <= F.col("node")) | (F.col("child_right") <= F.col("node"))), "child before parent"),
        F.when(~is_leaf & ~F.col("feature").between(0, n_features - 1), "feature out of range"),
        F.when(~F.col("missing") & ~(A.is_number(F.col("threshold")) & A.is_number(F.col("value"))), "not finite"),
    )
    flat = j.select(*keys, "node", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return flat.unionByName(deep).distinct()


def fit_receipt(df: DataFrame, group: str, label: str, role: str | None = None) -> DataFrame:
    """Counts a fit must report, recomputed from its training table.

    The list of groups is reported as one digest (``list_digest``), so it is never collected.
    """
    g = df.groupBy(F.col(group).cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"),
        *([F.sum(F.when(F.col(role) == v, 1).otherwise(0)).alias(f"n_{v}") for v in ("old", "extra")] if role else []),
    )
    counts = g.agg(
        F.sum("n").alias("training_rows"),
        F.count(F.lit(1)).alias("training_groups"),
        (F.sum("n") - F.sum("pos")).alias("class_0"),
        F.sum("pos").alias("class_1"),
        *([F.sum(f"n_{v}").alias(f"{v}_rows") for v in ("old", "extra")] if role else []),
    )
    return attach(counts, list_digest(g, "g").withColumnRenamed("digest", "groups_digest"), [])


def list_digest(df: DataFrame, column: str, digits: Sequence[int] = (6, 3, 0)) -> DataFrame:
    """One row: a SHA-256 that two lists share only if they hold the same distinct values, in whatever order.

    Hashes of the values are sorted within ranges (equal leading hex digits) and hashed; the range hashes are again, by
    fewer digits, up to one. Nothing is added up, so no exchange of values can cancel out. Nulls are left out; an empty
    list has the hash of nothing.
    """
    rows = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    level = rows.select(F.sha2("v", 256).alias("at"), F.sha2("v", 256).alias("h"))
    for n in digits:
        keyed = level.withColumn("_p", F.substring("at", 1, n) if n else F.lit(""))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        level = keyed.groupBy("_p").agg(F.sha2(joined, 256).alias("h")).select(F.col("_p").alias("at"), "h")
    return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def pin_violations(files: DataFrame, pins: DataFrame, key: str = "path") -> DataFrame:
    """(key, rule) of pinned files that are missing or whose sha256 differs from their pin; case doesn't matter."""
    f = files.select(F.col(key), F.lower("sha256").alias("_found"))
    both = pins.select(F.col(key), F.lower(F.trim("sha256")).alias("_pin")).join(f, key, "left")
    rule = F.when(F.col("_found").isNull(), "pinned file is missing").when(F.col("_found") != F.col("_pin"), "sha256 differs from its pin")
    return both.select(key, rule.alias("rule")).where("rule IS NOT NULL")


def receipt_violations(actual: DataFrame, receipt: DataFrame) -> DataFrame:
    """Fields of a one-row receipt that differ from the recomputed counts."""
    cols = [c for c in actual.columns if c in receipt.columns]
    both = attach(actual.select(*[F.col(c).alias("a_" + c) for c in cols]),
                  receipt.select(*[F.col(c).alias("r_" + c) for c in cols]), [])
    diffs = F.array(*[
        F.when(~F.col("a_" + c).eqNullSafe(F.col("r_" + c)),
               F.struct(F.lit(c).alias("field"), F.col("a_" + c).cast("string").alias("actual"), F.col("r_" + c).cast("string").alias("receipt")))
        for c in cols
    ])
    return both.select(F.explode(F.filter(diffs, lambda d: d.isNotNull())).alias("d")).select("d.*")


def cascade(df: DataFrame, models: Mapping[str, Mapping]) -> DataFrame:
    """Staged FILE score. A stage replaces the score only if the stage before it did.

    Needs the 13 scores, eliya_fake, spectra_scores, voice38. models: file17, file24,
    music17, file25, duration25, native25, support29.
    """
    c = F.col
    early = tree_scores(df, "evidence24", {
        "_c17": ("file17", models["file17"]), "_c24": ("evidence24", models["file24"]), "_m17": ("file17", models["music17"])})
    # MUSIC has its own completeness check and becomes evidence of the later stages.
    before = F.when(
        A.is_probability(c("lofcz")), A.linear_blend(c("current_music"), c("lofcz"), A.MUSIC_LOFCZ_FINAL_WEIGHT)
    ).otherwise(c("current_music"))
    d = early.select("*", before.alias("music_13"), A.is_probability(c("_c17")).alias("ok_17"))
    d = d.select(
        "*", (c("ok_17") & A.is_probability(c("_c24"))).alias("ok_24"),
        (A.is_probability(c("_m17")) & A.is_probability(c("music_13"))).alias("music_ok"))
    d = d.select(
        "*", A.retain(c("_c17"), c("current_file")).alias("file_17"),
        F.when(c("music_ok"), c("_m17")).otherwise(c("music_13")).alias("music17"))
    d = d.select("*", F.when(c("ok_24"), c("_c24")).otherwise(c("file_17")).alias("file_24"))
    d = tree_scores(d, "support29", {
        "_c25": ("stacked25", models["file25"]), "_c25d": ("stacked25", models["duration25"]),
        "_c25n": ("stacked25", models["native25"]), "_c29": ("support29", models["support29"])})
    ok, score = c("ok_24") & c("music_ok"), "file_24"
    for step in ("25", "25d", "25n", "29"):
        d = d.select("*", (ok & A.is_probability(c(f"_c{step}"))).alias(f"ok_{step}"))
        d = d.select("*", F.when(c(f"ok_{step}"), c(f"_c{step}")).otherwise(c(score)).alias(f"file_{step}"))
        ok, score = c(f"ok_{step}"), f"file_{step}"
    return d.withColumn("file_score", F.col("file_29")).drop(*[c for c in d.columns if c.startswith("_")])


def publish(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Publish order of the five outputs; the order of operations is the semantics.

    Inputs: file/voice/music/vp/mp (source values), tuned_file/voice/music (all three or
    none), out_voice/out_music (candidates, may be NULL).
    1. round; 2. blend tuned FILE; 3. floor FILE with the source VOICE/MUSIC;
    4. publish MUSIC and VOICE candidates; 5. blend tuned VOICE and MUSIC.
    """
    w = dict(A.TUNED_WEIGHTS if weights is None else weights)
    r = lambda c: F.round(c, A.ROUND_PLACES)
    d = df
    for c in ("file", "voice", "music", "vp", "mp"):
        d = d.withColumn(c, r(F.col(c)))
    tuned = A.all_probabilities(*[F.col(f"tuned_{h}") for h in ("file", "voice", "music")])
    d = d.withColumn("file", F.when(tuned, r(A.logit_blend(F.col("file"), F.col("tuned_file"), w["file"]))).otherwise(F.col("file")))
    d = d.withColumn("file", A.component_floor(*[F.col(c) for c in ("file", "voice", "music", "vp", "mp")]))
    for h in ("music", "voice"):
        d = d.withColumn(h, r(A.retain(F.col(f"out_{h}"), F.col(h))))
    for h in ("voice", "music"):
        d = d.withColumn(h, F.when(tuned, r(A.logit_blend(F.col(h), F.col(f"tuned_{h}"), w[h]))).otherwise(F.col(h)))
    return d


def neutral_fallback(df: DataFrame, failed: str, outputs: Sequence[str]) -> DataFrame:
    """A failed file gets 0.5 in every output."""
    return df.select(
        *[c for c in df.columns if c not in outputs],
        *[F.when(F.coalesce(F.col(failed), F.lit(False)), F.lit(A.NEUTRAL)).otherwise(F.col(o)).alias(o) for o in outputs],
    )
