"""EER in two passes: counts a bucket find where the two error rates cross, then only that bucket's scores are ordered.

Going down the scores, the false-positive rate rises and the false-negative rate falls, so their difference rises from
-1 to 1. The operating point is next to its change of sign: either the last point before the bucket in which the sign
changes, or a point of that bucket. The first pass moves counts only (combined before the shuffle), the second one
bucket a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import join_back, probability_bucket

BUCKETS = 1024


def class_counts(label: str = "label") -> tuple[Column, Column]:
    y = F.col(label).cast("long")
    return F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")


def running(counts: DataFrame, keys: Sequence[str], bucket: str = "_b") -> DataFrame:
    """Adds tp0, fp0 (counts above the bucket) and n_pos, n_neg. A key has one row a bucket."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = part.orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return counts.select(
        "*", F.coalesce(F.sum("pos").over(above), zero).alias("tp0"), F.coalesce(F.sum("neg").over(above), zero).alias("fp0"),
        F.sum("pos").over(part).alias("n_pos"), F.sum("neg").over(part).alias("n_neg"),
    )


def crossing_bucket(cum: DataFrame, keys: Sequence[str], bucket: str = "_b") -> DataFrame:
    """The bucket of each key at whose end the false-positive rate has reached the false-negative rate; none with one class."""
    # a class without rows gives NULL, which reaches nothing
    fpr, tpr = F.try_divide(F.col("fp0") + F.col("neg"), F.col("n_neg")), F.try_divide(F.col("tp0") + F.col("pos"), F.col("n_pos"))
    found = cum.where(fpr + tpr >= 1.0)
    best = F.max(F.struct(bucket, "tp0", "fp0", "n_pos", "n_neg")).alias("_x")
    return found.groupBy(*keys).agg(best).where("_x IS NOT NULL").select(*keys, f"_x.{bucket}", "_x.tp0", "_x.fp0", "_x.n_pos", "_x.n_neg")


def candidate(tp: Column, fp: Column, n_pos: Column, n_neg: Column, at: Column) -> Column:
    fpr, fnr = fp / n_neg, F.lit(1.0) - tp / n_pos
    return F.struct(F.abs(fpr - fnr).alias("gap"), at.alias("at"), ((fpr + fnr) / 2.0).alias("eer"))


def best_point(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EER from distinct scores (keys, score, pos, neg) of crossing buckets with their tp0, fp0, n_pos, n_neg."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    down = part.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    pts = hist.select(*keys, "score", "tp0", "fp0", "n_pos", "n_neg", F.sum("pos").over(down).alias("_p"), F.sum("neg").over(down).alias("_n"))
    n_pos, n_neg, tp0, fp0 = (F.col(c) for c in ("n_pos", "n_neg", "tp0", "fp0"))
    own = F.min(candidate(tp0 + F.col("_p"), fp0 + F.col("_n"), n_pos, n_neg, -F.col("score")))
    # the point before the bucket wins ties, as it has a higher score; above all scores it is the point (0, 1)
    start = F.first(candidate(tp0, fp0, n_pos, n_neg, F.lit(-1e300)))
    return pts.groupBy(*keys).agg(F.least(own, start)["eer"].alias("eer"))


def eer(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """(keys, eer); NULL for a key with one class. The same number as from all ordered scores, ties included."""
    keys = list(keys)
    rows = df.select(*keys, F.col(label).alias("label"), F.col(score).alias("score")).withColumn("_b", probability_bucket(F.col("score"), buckets))
    counts = rows.groupBy(*keys, "_b").agg(*class_counts())
    cross = crossing_bucket(running(counts, keys), keys)
    hist = join_back(rows, cross, [*keys, "_b"]).groupBy(*keys, "score", "tp0", "fp0", "n_pos", "n_neg").agg(*class_counts())
    found = best_point(hist, keys)
    if not keys:
        return found.agg(F.max("eer").alias("eer"))  # a row also without two classes
    return join_back(counts.select(*keys).distinct(), found, keys, "left")


def family_eer(df: DataFrame, keys: Sequence[str] = (), family: str = "family", label: str = "label", score: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """(keys, family, eer): all reals of a key against each family's fakes. Reals are counted once and copied nowhere but
    into the crossing bucket of a family."""
    keys = list(keys)
    rows = bucketed(df, keys, family, label, score, buckets)
    return family_crossings(rows, bucket_counts(rows, keys), keys, family)


def family_crossings(rows: DataFrame, counts: DataFrame, keys: Sequence[str], family: str = "family") -> DataFrame:
    """EER a family from rows (keys, _fam, label, score, _b) and counts (keys, _fam, label, _b, n), _fam NULL for reals."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    # small tables: a row a bucket. Both classes of a family on one axis: fakes' buckets, and all reals' buckets
    fakes = counts.where("label = 1")
    families = fakes.select(*keys, "_fam").distinct()
    reals = counts.where("label = 0").groupBy(*keys, "_b").agg(F.sum("n").alias("neg"))
    one = ["_one", *keys]
    real_side = join_back(families.withColumn("_one", F.lit(0)), reals.withColumn("_one", F.lit(0)), one)
    axis = real_side.select(*keys, "_fam", "_b", zero.alias("pos"), "neg").unionByName(fakes.select(*keys, "_fam", "_b", F.col("n").alias("pos"), zero.alias("neg")))
    fk = [*keys, "_fam"]
    both = axis.groupBy(*fk, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cross = crossing_bucket(running(both, fk), fk)
    own = join_back(rows.where("label = 1"), cross, [*fk, "_b"]).select(*fk, "score", "tp0", "fp0", "n_pos", "n_neg", F.lit(1).cast("long").alias("pos"), zero.alias("neg"))
    shared = join_back(rows.where("label = 0").drop("_fam"), cross, [*keys, "_b"]).select(*fk, "score", "tp0", "fp0", "n_pos", "n_neg", zero.alias("pos"), F.lit(1).cast("long").alias("neg"))
    hist = own.unionByName(shared).groupBy(*fk, "score", "tp0", "fp0", "n_pos", "n_neg").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = best_point(hist, fk)
    return join_back(families, found, fk, "left").withColumnRenamed("_fam", family)


def bucketed(df: DataFrame, keys: Sequence[str], family: str | None = None, label: str = "label", score: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """(keys, _fam, label, score, _b): _fam is a fake's family, NULL for reals."""
    fam = F.when(F.col(label) == 1, F.col(family)) if family else F.lit(None).cast("string")
    rows = df.select(*keys, fam.alias("_fam"), F.col(label).cast("int").alias("label"), F.col(score).alias("score"))
    return rows.withColumn("_b", probability_bucket(F.col("score"), buckets))


def bucket_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "_fam", "label", "_b").agg(F.count(F.lit(1)).alias("n"))


def summaries(rows: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_files, n_real, n_fake, eer, roc_auc, tie_rate and distinct_score_ratio of every key from bucketed rows.

    The rows move once, by (key, bucket): pairs of a fake and a real of one bucket are counted inside it, those of
    different buckets from the counts.
    """
    keys = list(keys)
    kb = [*keys, "_b"]
    fakes, reals = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    cum = running(counts.groupBy(*kb).agg(fakes.alias("pos"), reals.alias("neg")), keys)
    cross = crossing_bucket(cum, keys)
    near = join_back(rows.drop("_fam"), cross, kb).groupBy(*keys, "score", "tp0", "fp0", "n_pos", "n_neg").agg(*class_counts())
    found = best_point(near, keys)
    hist = rows.select(*kb, "label", "score").repartition(*kb).groupBy(*kb, "score").agg(*class_counts())
    below = Window.partitionBy(*kb).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("pos") + F.col("neg")
    inner = hist.withColumn("_under", F.coalesce(F.sum("neg").over(below), F.lit(0))).groupBy(*kb).agg(
        F.sum(F.col("pos") * (F.col("_under") + F.col("neg") * 0.5)).alias("_pairs"),
        F.sum(F.when(size > 1, size).otherwise(0)).alias("_tied"), F.count(F.lit(1)).alias("_distinct"))
    every = join_back(cum, inner, kb).groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_files"), F.sum("neg").alias("n_real"), F.sum("pos").alias("n_fake"),
        F.sum(F.col("_pairs") + F.col("pos") * (F.col("n_neg") - F.col("fp0") - F.col("neg"))).alias("_wins"),
        F.sum("_tied").alias("_tied"), F.sum("_distinct").alias("_distinct"))
    both = (F.col("n_real") > 0) & (F.col("n_fake") > 0)
    return join_back(every, found, keys, "left").select(
        *keys, "n_files", "n_real", "n_fake", "eer",
        F.when(both, F.try_divide(F.col("_wins"), F.col("n_fake").cast("double") * F.col("n_real"))).alias("roc_auc"),
        (F.col("_tied") / F.col("n_files")).alias("tie_rate"), (F.col("_distinct") / F.col("n_files")).alias("distinct_score_ratio"))
