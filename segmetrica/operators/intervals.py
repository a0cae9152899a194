"""Interval joins within a file, window gating and window targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import SAMPLE_RATE, SEGMENT_SAMPLES

PRESENCE_MIN = 0.20
PRESENCE_KEEP = 0.80


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_width: int = SEGMENT_SAMPLES) -> DataFrame:
    """All overlapping pairs of one file with their overlap length.

    Both sides carry ``start`` and ``end`` (half-open). Intervals are spread over
    fixed bins so that the join key is (file, bin), not the file alone: one very long
    file is then shared by many tasks. A pair meeting in several bins is kept only in
    the bin where the later of the two starts.
    """
    def binned(df: DataFrame) -> DataFrame:
        first = F.floor(F.col("start") / bin_width)
        last = F.floor((F.col("end") - 1) / bin_width)
        return df.filter(F.col("end") > F.col("start")).withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = binned(left).alias("a"), binned(right).alias("b")
    begin = F.greatest(F.col("a.start"), F.col("b.start"))
    finish = F.least(F.col("a.end"), F.col("b.end"))
    pairs = a.join(
        b,
        (F.col(f"a.{key}") == F.col(f"b.{key}"))
        & (F.col("a._bin") == F.col("b._bin"))
        & (finish > begin)
        & (F.col("a._bin") == F.floor(begin / bin_width)),
    )
    keep_right = [c for c in right.columns if c not in (key, "start", "end")]
    clash = set(keep_right) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return pairs.select(
        *[F.col(f"a.{c}") for c in left.columns],
        *[F.col(f"b.{c}") for c in keep_right],
        (finish - begin).alias("overlap"),
    )


def overlap_presence(windows: DataFrame, presence: DataFrame, key: str = "file_id") -> DataFrame:
    """Overlap-weighted presence of each window; NULL where no segment covers the window.

    windows(file, win_idx, start, end, ...), presence(file, start, end, score).
    """
    hits = overlap_join(
        windows.select(key, "win_idx", "start", "end"),
        presence.select(key, "start", "end", F.col("score").alias("_p")),
        key,
    )
    agg = hits.groupBy(key, "win_idx").agg(
        (F.sum(F.col("overlap") * F.col("_p")) / F.sum("overlap")).alias("presence")
    )
    return windows.join(agg, [key, "win_idx"], "left")


def gate_windows(df: DataFrame, key: str = "file_id", weight: str = "presence") -> DataFrame:
    """Drop files whose best presence is low; keep windows close to the file's best one.

    A file with an uncovered window (NULL weight) is dropped whole.
    """
    top = df.groupBy(key).agg(
        F.max(weight).alias("_top"), F.max(F.col(weight).isNull().cast("int")).alias("_hole")
    )
    return (
        df.join(top.filter((F.col("_top") >= PRESENCE_MIN) & (F.col("_hole") == 0)).drop("_hole"), key)
        .filter(F.col(weight) >= PRESENCE_KEEP * F.col("_top"))
        .drop("_top")
    )


def window_targets(windows: DataFrame, components: DataFrame, items: DataFrame, key: str = "file_id") -> DataFrame:
    """Targets of each window; NULL means masked.

    windows(file, win_idx, start, end); components(file, start, end, kind, fake);
    items(file, is_view, mask_music, kind_name, file_fake).
    """
    hits = overlap_join(
        windows.select(key, "win_idx", "start", "end"),
        components.select(key, "start", "end", "kind", "fake"),
        key,
    )
    o = F.col("overlap")

    def total(kind: str, fake: bool) -> Column:
        cond = F.col("kind") == kind
        if fake:
            cond = cond & (F.col("fake") == 1)
        return F.sum(F.when(cond, o).otherwise(0))

    agg = hits.groupBy(key, "win_idx").agg(
        total("speech", False).alias("ov_s"),
        total("speech", True).alias("fk_s"),
        total("music", False).alias("ov_m"),
        total("music", True).alias("fk_m"),
    )
    w = windows.join(agg, [key, "win_idx"], "left").na.fill(0, ["ov_s", "fk_s", "ov_m", "fk_m"]).join(items, key)
    second, half = SAMPLE_RATE, SAMPLE_RATE // 2

    def present(ov: str) -> Column:
        return F.when(F.col(ov) >= second, 1).when(F.col(ov) == 0, 0)

    def fake(ov: str, fk: str) -> Column:
        return (
            F.when(F.col(ov) == 0, None)
            .when(F.col(fk) >= half, 1)
            .when((F.col(fk) == 0) & (F.col(ov) >= second), 0)
        )

    w = w.withColumn("_vf", fake("ov_s", "fk_s")).withColumn("_mf", fake("ov_m", "fk_m"))
    any_fake = F.coalesce(F.col("_vf") == 1, F.lit(False)) | F.coalesce(F.col("_mf") == 1, F.lit(False))
    masked_music = F.col("is_view") & F.col("mask_music")
    return w.select(
        key,
        "win_idx",
        F.when(any_fake, 1)
        .when(F.col("is_view") & F.col("file_fake").isNull(), None)
        .when(F.col("fk_s") + F.col("fk_m") == 0, 0)
        .alias("t_file"),
        F.col("_vf").alias("t_voice"),
        F.when(~masked_music, F.col("_mf")).alias("t_music"),
        F.when(F.col("kind_name") != "music_real", present("ov_s")).alias("t_vp"),
        F.when(~masked_music, present("ov_m")).alias("t_mp"),
    )


def component_layout(renders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, violations) of renders.

    renders(id, kind, order, overlap_order, n, voice_fake, music_fake,
    splice_start_s, splice_seconds): spoken and musical intervals follow from the kind.
    """
    def part(a, b, kind, fake) -> Column:
        as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
        return F.struct(
            as_long(a).alias("start"), as_long(b).alias("end"), F.lit(kind).alias("kind"),
            (fake if isinstance(fake, Column) else F.lit(fake)).cast("int").alias("fake"),
        )

    n, vf, mf, kind = F.col("n"), F.col("voice_fake"), F.col("music_fake"), F.col("kind")
    a = F.rint(F.col("splice_start_s") * SAMPLE_RATE)
    b = a + F.rint(F.col("splice_seconds") * SAMPLE_RATE)
    half, third = F.floor(n / 2), F.floor(n / 3)
    spoken = [part(0, a, "speech", 0), part(a, b, "speech", 1), part(b, n, "speech", 0)]
    layout = (
        F.when(kind.isin("speech_real", "speech_fake"), F.array(part(0, n, "speech", vf)))
        .when(kind == "music_vocal_fake", F.array(part(0, n, "speech", 1), part(0, n, "music", mf)))
        .when(kind.startswith("music_"), F.array(part(0, n, "music", mf)))
        .when(kind == "partial", F.array(*spoken))
        .when(kind == "partial_real_music", F.array(*spoken, part(0, n, "music", 0)))
        .when(kind.startswith("sim_"), F.array(part(0, n, "speech", vf), part(0, n, "music", mf)))
        .when(
            kind.startswith("seq_") & (F.col("order") == "speech_then_music"),
            F.array(part(0, half, "speech", vf), part(half, n, "music", mf)),
        )
        .when(kind.startswith("seq_"), F.array(part(half, n, "speech", vf), part(0, half, "music", mf)))
        .when(
            kind.startswith("overlap_") & (F.col("overlap_order") == "speech_first"),
            F.array(part(0, third * 2, "speech", vf), part(third, n, "music", mf)),
        )
        .when(kind.startswith("overlap_"), F.array(part(third, n, "speech", vf), part(0, third * 2, "music", mf)))
    )
    laid = renders.withColumn("comps", F.filter(layout, lambda c: c["end"] > c["start"]))
    fake_of = lambda k: F.exists("comps", lambda c: (c["kind"] == k) & (c["fake"] == 1)).cast("int")
    violations = laid.select(
        "id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("comps").isNull(), "unknown kind"),
                    F.when((fake_of("speech") != vf) & (kind != "music_vocal_fake"), "voice label differs from layout"),
                    F.when(fake_of("music") != mf, "music label differs from layout"),
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("rule"),
    )
    components = laid.select("id", F.explode("comps").alias("c")).select("id", "c.*")
    return components, violations
