"""Ranking metrics: EER, AUC, ties, leave-one-family-out, cluster bootstrap.

Everything starts from a histogram (keys, score) -> (pos, neg), so shuffles carry
distinct scores rather than rows, and map-side combine does most of the work.
Labels are 0/1, scores lie in [0, 1]; rows with a NULL label must be removed or
masked by the caller (P9), never counted as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_long, hash_text
from .prefix import accumulate, attach, hash_rank, join_back, probability_bucket, with_quantile_bucket

INF = float("inf")


def histogram(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )


def weighted_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Re-aggregate rows that already carry pos/neg counts."""
    return df.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def roc_points(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One point per distinct score: tp, fp at scores >= score, and class totals."""
    return (
        accumulate(
            hist, keys, [F.col("score").desc()], probability_bucket(F.col("score")), ["pos", "neg"]
        )
        .withColumnRenamed("pos_cum", "tp")
        .withColumnRenamed("neg_cum", "fp")
        .withColumnRenamed("pos_all", "n_pos")
        .withColumnRenamed("neg_all", "n_neg")
    )


def _crossing(fp: Column, n_neg: Column, tp: Column, n_pos: Column, order: Column) -> Column:
    """Sortable candidate for the operating point: distance, position, value."""
    fpr = fp / n_neg
    fnr = F.lit(1.0) - tp / n_pos
    return F.struct(
        F.abs(fpr - fnr).alias("gap"), order.alias("at"), ((fpr + fnr) / 2.0).alias("eer")
    )


def _anchor() -> Column:
    return F.struct(F.lit(1.0).alias("gap"), F.lit(-INF).alias("at"), F.lit(0.5).alias("eer"))


def summarize_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, class counts, EER, AUC, tie statistics and a note, one row per key.

    With one class only, EER and AUC are NULL and the note says so.
    """
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    both = (n_pos > 0) & (n_neg > 0)
    size = pos + neg
    best = F.min(F.when(both, _crossing(fp, n_neg, tp, n_pos, -F.col("score"))))
    out = points.groupBy(*keys).agg(
        F.sum(size).alias("n_files"),
        F.sum(neg).alias("n_real"),
        F.sum(pos).alias("n_fake"),
        F.when(F.max(both), F.least(best, _anchor()).getField("eer")).alias("eer"),
        F.when(
            F.max(both),
            F.sum(pos * (n_neg - fp + neg * 0.5)) / (F.max(n_pos).cast("double") * F.max(n_neg)),
        ).alias("roc_auc"),
        (F.sum(F.when(size > 1, size).otherwise(0)) / F.sum(size)).alias("tie_rate"),
        (F.count(F.lit(1)) / F.sum(size)).alias("distinct_score_ratio"),
    )
    return out.withColumn("note", F.when(F.col("eer").isNull(), "single-class subset").otherwise(""))


def summarize(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    keys = list(keys)
    return summarize_points(roc_points(histogram(df, keys, label, score), keys), keys)


def eer(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    keys = list(keys)
    return eer_from_points(roc_points(histogram(df, keys, label, score), keys), keys)


def eer_from_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    cand = _crossing(F.col("fp"), F.col("n_neg"), F.col("tp"), F.col("n_pos"), -F.col("score"))
    return points.groupBy(*keys).agg(
        F.when(F.max(both), F.least(F.min(F.when(both, cand)), _anchor()).getField("eer")).alias("eer")
    )


def leave_one_family_out(
    df: DataFrame,
    keys: Sequence[str] = (),
    family: str = "family",
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Per family: all real rows against that family's fakes, without copying the reals.

    Reals and fakes are put on one score axis once. Each fake score of a family then
    knows how many reals lie at or above it, which gives every ROC point next to a
    family score. Only the stretch of real-only points where the two error rates
    cross needs a closer look, and that is one bucket of reals per family.
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    cells = (
        df.withColumn("_fam", F.when(F.col(label) == 1, F.col(family)))
        .groupBy(*keys, "_fam", F.col(score).alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    )
    # Reals per score, attached to every cell at that score.
    axis = cells.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("_fam").isNull(), F.col("neg")).otherwise(0)).alias("neg")
    )
    bucket = probability_bucket(F.col("score"))
    real = accumulate(axis, keys, [F.col("score").desc()], bucket, ["neg"]).select(
        *keys,
        "score",
        F.col("neg").alias("n_eq"),
        F.col("neg_cum").alias("n_ge"),
        F.col("neg_all").alias("n_neg"),
    )
    fakes = cells.filter(F.col("_fam").isNotNull()).select(*keys, F.col("_fam").alias("family"), "score", "pos")
    run = accumulate(
        fakes.withColumn("one", F.lit(1).cast("long")),
        [*keys, "family"],
        [F.col("score").desc()],
        bucket,
        ["pos", "one"],
    ).withColumnRenamed("pos_cum", "tp").withColumnRenamed("pos_all", "n_pos").drop("one_all")
    pts = join_back(run, real, [*keys, "score"]).withColumnRenamed("one_cum", "step")

    n_neg, n_pos = F.col("n_neg"), F.col("n_pos")
    both = (n_pos > 0) & (n_neg > 0)
    n_gt = F.col("n_ge") - F.col("n_eq")
    tp0 = F.col("tp") - F.col("pos")
    def cand(fp, tp):
        fpr, fnr = fp / n_neg, F.lit(1.0) - tp / n_pos
        return F.struct(
            F.abs(fpr - fnr).alias("gap"), fpr.alias("fpr"), (-fnr).alias("fnr"), ((fpr + fnr) / 2.0).alias("eer")
        )

    fk = [*keys, "family"]
    # The last point strictly above a family score has fp = n_gt, tp = tp0. If the curve
    # already crossed there but not at the family's previous score, the crossing sits on
    # real-only points with this constant miss rate.
    before = n_gt / n_neg - (F.lit(1.0) - tp0 / n_pos)
    agg = pts.groupBy(*fk).agg(
        F.min(F.when(both, F.least(cand(F.col("n_ge"), F.col("tp")), cand(n_gt, tp0)))).alias("best"),
        F.min(F.when(both & (before > 0), tp0)).alias("cross_tp"),
        F.max(F.when(both & (before <= 0), F.col("n_ge"))).alias("from_fp"),
        F.min(F.when(both & (before > 0), n_gt)).alias("to_fp"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(F.col("pos") * (n_neg - F.col("n_ge") + F.col("n_eq") * 0.5)).alias("wins"),
        F.sum(
            F.when(F.col("n_eq") >= 2, F.col("pos"))
            .when(F.col("n_eq") == 1, F.col("pos") + 1)
            .when(F.col("pos") > 1, F.col("pos"))
            .otherwise(0)
        ).alias("tied"),
        F.sum(F.when(F.col("n_eq") == 0, 1).otherwise(0)).alias("own"),
    )
    # After the last family score the miss rate is 0; reals below it end the curve.
    target = agg.withColumn("cross_tp", F.coalesce("cross_tp", "n_pos")).withColumn(
        "miss", F.lit(1.0) - F.col("cross_tp") / F.col("n_pos")
    )
    # Which bucket of reals holds the first rate above the miss rate?
    reals = real.filter(F.col("n_eq") > 0).withColumn("_b", bucket)
    spans = reals.groupBy(*keys, "_b").agg(
        F.min(F.col("n_ge") - F.col("n_eq")).alias("lo"),
        F.max("n_ge").alias("hi"),
        F.sum(F.when(F.col("n_eq") > 1, F.col("n_eq")).otherwise(0)).alias("real_tied"),
        F.count(F.lit(1)).alias("real_distinct"),
    )
    per_key = spans.groupBy(*keys).agg(
        F.sum("real_tied").alias("real_tied"),
        F.sum("real_distinct").alias("real_distinct"),
        F.collect_list(F.struct("_b", "lo", "hi")).alias("spans"),  # at most one per bucket
    )
    placed = attach(target, per_key, keys, "left")
    hit = F.filter(
        "spans",
        lambda b: (b["lo"] / F.col("n_neg") <= F.col("miss")) & (b["hi"] / F.col("n_neg") > F.col("miss")),
    )
    placed = placed.withColumn("hit", F.get(hit, F.lit(0))).drop("spans")
    placed = placed.select("*", F.col("hit._b").alias("_b"), F.col("hit.lo").alias("lo")).drop("hit")
    inner = join_back(placed, reals.select(*keys, "_b", F.col("n_ge").alias("fp")), [*keys, "_b"], "left")
    rate = F.col("fp") / n_neg
    carried = [c for c in placed.columns if c not in (*fk, "_b")]
    near = inner.groupBy(*fk).agg(
        *[F.first(c).alias(c) for c in carried],
        F.min(F.when(rate > F.col("miss"), F.col("fp"))).alias("up"),
        F.max(F.when(rate <= F.col("miss"), F.col("fp"))).alias("down"),
    )

    def at(fp):
        fpr, fnr = fp / n_neg, F.col("miss")
        return F.struct(
            F.abs(fpr - fnr).alias("gap"), fpr.alias("fpr"), (-fnr).alias("fnr"), ((fpr + fnr) / 2.0).alias("eer")
        )

    # Points outside this stretch have another miss rate and are already in `best`.
    from_fp = F.coalesce("from_fp", F.lit(0))
    to_fp = F.coalesce("to_fp", n_neg)
    down = F.coalesce("down", "lo")
    out = near.select(
        "*",
        F.when((F.col("up") >= from_fp) & (F.col("up") <= to_fp), at(F.col("up"))).alias("c_up"),
        F.when((down >= from_fp) & (down <= to_fp), at(down)).alias("c_down"),
    )
    start = F.struct(
        F.lit(1.0).alias("gap"), F.lit(0.0).alias("fpr"), F.lit(-1.0).alias("fnr"), F.lit(0.5).alias("eer")
    )
    stop = F.struct(
        F.lit(1.0).alias("gap"), F.lit(1.0).alias("fpr"), F.lit(-0.0).alias("fnr"), F.lit(0.5).alias("eer")
    )
    n_files = F.col("n_pos") + F.col("n_neg")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    result = out.select(
        *fk,
        n_files.alias("n_files"),
        F.col("n_neg").alias("n_real"),
        F.col("n_pos").alias("n_fake"),
        F.when(ok, F.least(F.col("best"), F.col("c_up"), F.col("c_down"), start, stop).getField("eer")).alias("eer"),
        F.when(ok, F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        ((F.coalesce("real_tied", F.lit(0)) + F.col("tied")) / n_files).alias("tie_rate"),
        ((F.coalesce("real_distinct", F.lit(0)) + F.col("own")) / n_files).alias("distinct_score_ratio"),
    )
    return result.withColumn("note", F.when(F.col("eer").isNull(), "single-class subset").otherwise(""))


def worst_family(
    lofo: DataFrame, overall: DataFrame, keys: Sequence[str] = (), blend_weight: float = 0.5
) -> DataFrame:
    """Highest family EER (first family in order on ties) and its blend with the overall EER."""
    keys = list(keys)
    w = float(blend_weight)
    scored = lofo.filter(F.col("eer").isNotNull())
    worst = scored.groupBy(*keys).agg(
        F.max("eer").alias("worst_family_eer"),
        F.min(F.struct((-F.col("eer")).alias("e"), F.col("family"))).getField("family").alias("worst_family"),
    )
    o = overall.select(*keys, F.col("eer").alias("overall_eer"))
    both = attach(o, worst, keys, "left")
    return both.withColumn("blend_eer", (1.0 - w) * F.col("worst_family_eer") + w * F.col("overall_eer"))


def resample_counts(df: DataFrame, group: str, n_resamples: int, seed: int) -> DataFrame:
    """(replicate, group, times): how often each group is drawn, with replacement.

    Each group contributes one draw per replicate, so there are as many draws as
    groups and the table is built by an explode, not by a cross join.
    """
    from .resampling import numbered_groups

    indexed = numbered_groups(df, group, seed)
    draws = (
        indexed.select("idx", "n_groups", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("replicate"))
        .select(
            "replicate",
            F.pmod(hash_long(seed, F.col("replicate"), F.col("idx")), F.col("n_groups")).alias("idx"),
        )
        .groupBy("replicate", "idx")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return draws.join(indexed, "idx").select("replicate", "grp", "times", "n_groups")


def bootstrap_eer(
    df: DataFrame,
    keys: Sequence[str] = (),
    group: str = "grp",
    label: str = "label",
    score: str = "score",
    n_resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Percentile interval of the EER when whole groups are resampled.

    Resampled rows are never built: counts are multiplied by how often a group was drawn, first a coarse bucket, then
    score by score in the bucket where a replicate's error rates cross (``resampling``). Replicates with one class are
    counted, not scored.
    """
    from .resampling import bootstrap

    if n_resamples < 1 or not 0.0 < confidence < 1.0:
        raise ValueError("n_resamples must be positive and confidence inside (0, 1)")
    keys = list(keys)
    per = bootstrap(df, keys, n_resamples, seed, group, label, score, 4096 if keys else 1 << 16)
    n_groups = df.agg(F.count_distinct(group).alias("n_groups"))
    per = join_back(df.select(*keys).distinct(), per, keys, "left") if keys else per
    per = attach(per, n_groups, [])
    q = [(1.0 - confidence) / 2.0, 0.5, (1.0 + confidence) / 2.0]
    return (
        per.groupBy(*keys)
        .agg(
            F.max("n_groups").alias("n_groups"),
            F.lit(n_resamples).cast("long").alias("n_resamples"),
            F.count("eer").alias("n_effective"),
            F.expr(f"percentile(eer, array({q[0]}D, {q[1]}D, {q[2]}D))").alias("q"),
        )
        .select(
            *keys,
            "n_groups",
            "n_resamples",
            "n_effective",
            (F.col("n_resamples") - F.col("n_effective")).alias("n_degenerate"),
            F.get("q", F.lit(0)).alias("lower"),
            F.get("q", F.lit(1)).alias("median"),
            F.get("q", F.lit(2)).alias("upper"),
        )
    )


def composite_score(pairs: DataFrame) -> DataFrame:
    """The published composite from one row per file with labels and predictions.

    Heads VOICE and MUSIC count only rows where that component is present.
    """
    # One pass: the five heads are exploded from each row.
    heads = F.array(
        *[
            F.struct(
                F.lit(name).alias("head"),
                F.col(y).cast("int").alias("label"),
                F.col(s).alias("score"),
                (F.col(keep) == 1 if keep else F.lit(True)).alias("keep"),
            )
            for name, y, s, keep in (
                ("file", "file_fake", "file_fake_prob", None),
                ("voice", "voice_fake", "voice_fake_prob", "voice_present"),
                ("music", "music_fake", "music_fake_prob", "music_present"),
                ("vp", "voice_present", "voice_present_prob", None),
                ("mp", "music_present", "music_present_prob", None),
            )
        ]
    )
    long = pairs.select(F.explode(heads).alias("h")).select("h.*").filter("keep AND label IS NOT NULL")
    s = summarize(long, ["head"])
    pick = lambda h, c: F.max(F.when(F.col("head") == h, F.col(c)))
    row = s.agg(
        pick("file", "eer").alias("file_eer"),
        pick("voice", "eer").alias("voice_eer"),
        pick("music", "eer").alias("music_eer"),
        pick("vp", "roc_auc").alias("voice_presence_auc"),
        pick("mp", "roc_auc").alias("music_presence_auc"),
    )
    return row.withColumn(
        "ads",
        0.5 * (1 - F.col("file_eer")) + 0.2 * (1 - F.col("voice_eer")) + 0.3 * (1 - F.col("music_eer")),
    ).withColumn(
        "cps", 0.5 * F.col("voice_presence_auc") + 0.5 * F.col("music_presence_auc")
    ).withColumn("score", 0.9 * F.col("ads") + 0.1 * F.col("cps"))


def cross_entropy(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score",
                  eps: float = 1e-6) -> DataFrame:
    p = F.col(score)
    y = F.col(label)
    loss = y * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(eps))) + (1 - y) * F.log(
        F.greatest(F.least(F.lit(1.0) - p, F.lit(1.0)), F.lit(eps))
    )
    return df.groupBy(*keys).agg((-F.avg(loss)).alias("bce"))


def masked_logit_loss(df: DataFrame, heads: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Weighted sum over heads of the mean logit loss where the mask is set.

    heads: (logit column, target column, mask column, weight).
    """
    parts = []
    for z, y, m, _ in heads:
        loss = F.greatest(F.col(z), F.lit(0.0)) - F.col(z) * F.col(y) + F.log1p(F.exp(-F.abs(F.col(z))))
        on = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
        parts.append(
            (F.sum(F.when(on > 0, loss * on).otherwise(0.0)) / F.greatest(F.sum(on), F.lit(1.0))).alias("loss_" + z)
        )
    out = df.agg(*parts)
    total = None
    for z, _, _, w in heads:
        term = F.col("loss_" + z) * F.lit(float(w))
        total = term if total is None else total + term
    return out.withColumn("loss", total)


def errors_at_threshold(df: DataFrame, keys: Sequence[str], threshold: float,
                        label: str = "label", score: str = "score") -> DataFrame:
    """False alarms and misses at a threshold frozen elsewhere."""
    hit = F.col(score) >= F.lit(float(threshold))
    return df.groupBy(*keys).agg(
        F.sum(F.when((F.col(label) == 0) & hit, 1).otherwise(0)).alias("false_alarms"),
        F.sum(F.when((F.col(label) == 1) & ~hit, 1).otherwise(0)).alias("misses"),
    )


def exact_percentiles(df: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles of a whole column in one row.

    Positions come from two-level cumulative counts, so the values never meet in one task.
    """
    hist = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    hist = with_quantile_bucket(hist, "v")
    run = accumulate(hist, [], [F.col("v").asc()], F.col("_q"), ["c"], descending=False)
    end, begin, n = F.col("c_cum"), F.col("c_cum") - F.col("c"), F.col("c_all")

    def at(index):
        return F.max(F.when((begin <= index) & (end > index), F.col("v")))

    picks = []
    for name, q in points.items():
        h = (n - 1) * F.lit(float(q))
        low, high = at(F.floor(h)), at(F.ceil(h))
        picks.append((low + F.max(h - F.floor(h)) * (high - low)).alias(name))
    return run.agg(*picks)


def runtime_summary(df: DataFrame, seconds: str, total_files: int | None = None) -> DataFrame:
    s = F.col(seconds)
    out = attach(
        df.agg(
            F.count(s).alias("n_measured"), F.avg(s).alias("mean_seconds"), F.max(s).alias("max_seconds"),
            F.coalesce(F.sum(s), F.lit(0.0)).alias("measured_total_seconds"),
        ),
        exact_percentiles(df, seconds, {"median_seconds": 0.5, "p90_seconds": 0.9}),
        [],
    )
    if total_files:
        out = out.withColumn("extrapolated_total_seconds", F.col("mean_seconds") * F.lit(int(total_files)))
    return out
