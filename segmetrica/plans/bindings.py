"""How the engine's inputs are derived from the test tables, in Spark and in SQL.

Each binding exists twice: as a DataFrame function and as a CTE for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algebra as A


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- segments: one row per scored segment -----------------------------------------

def segments(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_returnflag") == "A", "voice")
        .when(F.col("l_returnflag") == "N", "music")
        .otherwise("mixture")
        .alias("stream"),
        (F.row_number().over(order) - 1).alias("seg_idx"),
        (F.col("l_quantity") / 50).alias("score"),
    )


def segment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Segments without their order, for queries that do not need it: no window, no shuffle."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_returnflag") == "A", "voice")
        .when(F.col("l_returnflag") == "N", "music")
        .otherwise("mixture")
        .alias("stream"),
        (F.col("l_quantity") / 50).alias("score"),
    )


SEGMENTS = """segments AS (
  SELECT l_orderkey AS file_id,
         CASE l_returnflag WHEN 'A' THEN 'voice' WHEN 'N' THEN 'music' ELSE 'mixture' END AS stream,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag
                            ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seg_idx,
         l_quantity / 50 AS score
  FROM lineitem)"""


# --- items: one row per file -------------------------------------------------------

def items(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    status = F.col("o_orderstatus")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("file_id"),
        F.when(status == "F", 1).otherwise(0).alias("file_fake"),
        F.when(status == "P", None).when(status == "F", 1).otherwise(0).alias("voice_fake"),
        F.col("o_custkey").alias("grp"),
        F.col("o_orderpriority").alias("family"),
        F.col("c_mktsegment").alias("domain"),
        ((F.col("o_orderkey") % 97) / F.lit(96.0)).alias("voice_present"),
        ((F.col("o_orderkey") % 89) / F.lit(88.0)).alias("music_present"),
    )


ITEMS = """items AS (
  SELECT o_orderkey AS file_id,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS file_fake,
         CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 1 ELSE 0 END AS voice_fake,
         o_custkey AS grp, o_orderpriority AS family, c_mktsegment AS domain,
         (o_orderkey % 97) / 96e0 AS voice_present,
         (o_orderkey % 89) / 88e0 AS music_present
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


# --- file_scores: mean-pooled score per file with its labels --------------------------

def file_scores(spark: SparkSession, sf: str) -> DataFrame:
    pooled = segment_scores(spark, sf).groupBy("file_id").agg(F.round(F.avg("score"), 10).alias("score"))
    return (
        items(spark, sf)
        .join(pooled, "file_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("label", F.col("file_fake"))
    )


FILE_SCORES = f"""{SEGMENTS}, {ITEMS}, file_scores AS (
  SELECT items.*, file_fake AS label, coalesce(p.score, 0e0) AS score
  FROM items LEFT JOIN (SELECT file_id, round(avg(score), 10) AS score FROM segments GROUP BY 1) p
    USING (file_id))"""


# --- score13: the thirteen component scores of each file ------------------------------

SCORE_FIELDS = (
    "df_voice_mean", "df_music_mean", "df_music_max", "spectra", "nii",
    "artifactnet", "lofcz", "current_voice", "current_music", "voice_present",
    "music_present", "current_file", "file_music",
)


def score13(spark: SparkSession, sf: str) -> DataFrame:
    """The 13 scores plus evidence arrays and the later-stage scores, one row per file."""
    li = table(spark, sf, "lineitem")
    # Whole-number sums keep the means exact whatever the order of addition; 51 and 10.3
    # keep them away from decimal ties when results are rounded.
    s = F.col("l_quantity")
    mean = lambda c: F.avg(F.when(c, s)) / 51
    top = lambda c: F.max(F.when(c, s)) / 51
    voice, music = F.col("l_returnflag") == "A", F.col("l_returnflag") == "N"
    pooled = li.groupBy(F.col("l_orderkey").alias("file_id")).agg(
        mean(voice).alias("vmean"),
        top(voice).alias("vmax"),
        mean(music).alias("mmean"),
        top(music).alias("mmax"),
        top(~voice & ~music).alias("xmax"),
        mean(~voice & ~music).alias("xmean"),
        (F.avg(F.rint(F.col("l_discount") * 100)) / 10.3).alias("disc"),
    )
    fid = F.col("file_id")
    zero = F.lit(0.0)
    d = (
        items(spark, sf)
        .join(pooled, "file_id", "left")
        .select(
            fid, "file_fake", "voice_fake", "grp", "family", "domain", "voice_present", "music_present",
            F.coalesce("vmean", zero).alias("df_voice_mean"),
            F.coalesce("vmax", zero).alias("df_voice_max"),
            F.coalesce("mmean", zero).alias("df_music_mean"),
            F.coalesce("mmax", zero).alias("df_music_max"),
            F.coalesce("xmax", zero).alias("raw_df_max"),
            F.coalesce("xmean", zero).alias("raw_df_mean"),
            F.coalesce("disc", zero).alias("artifactnet"),
            ((fid * 37) % 101 / F.lit(100.0)).alias("spectra"),
            ((fid * 53) % 103 / F.lit(102.0)).alias("nii"),
            ((fid * 59) % 113 / F.lit(112.0)).alias("lofcz"),
            ((fid * 61) % 127 / F.lit(126.0)).alias("eliya_fake"),
            ((fid * 67) % 131 / F.lit(130.0)).alias("mms_fake"),
            ((fid * 71) % 137 / F.lit(136.0)).alias("nes2_fake"),
        )
    )
    d = d.withColumn(
        "spectra_scores",
        F.slice(
            F.array(F.col("spectra"), (fid * 41) % 107 / F.lit(106.0), (fid * 43) % 109 / F.lit(108.0)),
            F.lit(1), (fid % 3 + 1).cast("int"),
        ),
    ).withColumn(
        "eliya_scores",
        F.slice(
            F.array(F.col("eliya_fake"), (fid * 73) % 139 / F.lit(138.0), (fid * 79) % 149 / F.lit(148.0)),
            F.lit(1), (fid % 3 + 1).cast("int"),
        ),
    )
    d = d.withColumn(
        "current_voice", A.linear_blend(F.col("df_voice_mean"), F.col("spectra"), A.VOICE_SPECTRA_WEIGHT)
    ).withColumn(
        "current_music", A.linear_blend(F.col("df_music_mean"), F.col("artifactnet"), A.MUSIC_ARTIFACT_WEIGHT)
    ).withColumn(
        "file_music", A.linear_blend(F.col("df_music_max"), F.col("artifactnet"), A.FILE_MUSIC_ARTIFACT_WEIGHT)
    )
    return d.withColumn(
        "current_file",
        A.component_max(F.col("df_voice_mean"), F.col("file_music"), F.col("voice_present"), F.col("music_present")),
    )


SCORE13 = f"""{ITEMS}, pooled13 AS (
  SELECT l_orderkey AS file_id,
    avg(CASE WHEN l_returnflag='A' THEN l_quantity END)/51e0 AS vmean,
    max(CASE WHEN l_returnflag='A' THEN l_quantity END)/51e0 AS vmax,
    avg(CASE WHEN l_returnflag='N' THEN l_quantity END)/51e0 AS mmean,
    max(CASE WHEN l_returnflag='N' THEN l_quantity END)/51e0 AS mmax,
    max(CASE WHEN l_returnflag NOT IN ('A','N') THEN l_quantity END)/51e0 AS xmax,
    avg(CASE WHEN l_returnflag NOT IN ('A','N') THEN l_quantity END)/51e0 AS xmean,
    avg(round_even(l_discount*100,0))/10.3e0 AS disc
  FROM lineitem GROUP BY 1),
score13a AS (
  SELECT items.*, coalesce(vmean,0e0) AS df_voice_mean, coalesce(vmax,0e0) AS df_voice_max,
    coalesce(mmean,0e0) AS df_music_mean, coalesce(mmax,0e0) AS df_music_max,
    coalesce(xmax,0e0) AS raw_df_max, coalesce(xmean,0e0) AS raw_df_mean,
    coalesce(disc,0e0) AS artifactnet,
    (file_id*37)%101/100e0 AS spectra, (file_id*53)%103/102e0 AS nii,
    (file_id*59)%113/112e0 AS lofcz, (file_id*61)%127/126e0 AS eliya_fake,
    (file_id*67)%131/130e0 AS mms_fake, (file_id*71)%137/136e0 AS nes2_fake,
    [(file_id*37)%101/100e0, (file_id*41)%107/106e0, (file_id*43)%109/108e0][1:(file_id%3+1)] AS spectra_scores,
    [(file_id*61)%127/126e0, (file_id*73)%139/138e0, (file_id*79)%149/148e0][1:(file_id%3+1)] AS eliya_scores
  FROM items LEFT JOIN pooled13 USING (file_id)),
score13b AS (
  SELECT *, 0.375e0*df_voice_mean + 0.625e0*spectra AS current_voice,
    0.75e0*df_music_mean + 0.25e0*artifactnet AS current_music,
    0.5e0*df_music_max + 0.5e0*artifactnet AS file_music
  FROM score13a),
score13 AS (
  SELECT *, greatest(voice_present*df_voice_mean, music_present*file_music) AS current_file FROM score13b)"""


# --- SQL spelling of the score algebra -------------------------------------------------

def sql_clip(x: str) -> str:
    return f"greatest(least({x}, 1e0-1e-6), 1e-6)"


def sql_logit(x: str) -> str:
    return f"(ln({sql_clip(x)}) - ln(1e0 - {sql_clip(x)}))"


def sql_sigmoid(z: str) -> str:
    return f"(1e0/(1e0+exp(-({z}))))"


def sql_logit_blend(a: str, b: str, w: float) -> str:
    return sql_sigmoid(f"{1 - w!r}*{sql_logit(a)} + {w!r}*{sql_logit(b)}")


def sql_eer(src: str, keys: list[str], out: str = "eer_out", label: str = "label", score: str = "score",
            weight: str = "1") -> str:
    """CTE chain computing EER, AUC and counts per key, written independently with plain windows."""
    k = "".join(x + ", " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    kk = ", ".join(keys)
    return f"""{out}_h AS (
  SELECT {k}{score} AS s, sum({label}*{weight})::DOUBLE AS pos, sum((1-{label})*{weight})::DOUBLE AS neg,
         sum({weight})::DOUBLE AS cnt FROM {src} GROUP BY {k}{score}),
{out}_c AS (
  SELECT {k}s, pos, neg, cnt, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp,
         sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn FROM {out}_h),
{out}_p AS (
  SELECT {k}s, abs(fp/nn - (1e0-tp/np)) AS gap, (fp/nn + (1e0-tp/np))/2 AS e FROM {out}_c WHERE np > 0 AND nn > 0
  UNION ALL SELECT {k}'infinity'::DOUBLE, 1e0, 0.5e0 FROM {out}_c WHERE np > 0 AND nn > 0 {('GROUP BY ' + kk) if keys else ''}),
{out}_b AS (
  SELECT * FROM (SELECT {k}e, row_number() OVER ({part} ORDER BY gap, s DESC) AS rn FROM {out}_p) WHERE rn = 1),
{out}_s AS (
  SELECT {k}sum(cnt)::BIGINT AS n_files, sum(neg)::BIGINT AS n_real, sum(pos)::BIGINT AS n_fake,
    CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos*(nn-fp+neg*0.5e0))/(max(np)*max(nn)) END AS roc_auc,
    sum(CASE WHEN cnt > 1 THEN cnt ELSE 0 END)/sum(cnt) AS tie_rate, count(*)/sum(cnt) AS distinct_score_ratio
  FROM {out}_c {grp}),
{out} AS (
  SELECT {', '.join(out + '_s.' + x for x in keys) + ', ' if keys else ''}n_files, n_real, n_fake, e AS eer, roc_auc, tie_rate, distinct_score_ratio,
    CASE WHEN e IS NULL THEN 'single-class subset' ELSE '' END AS note
  FROM {out}_s LEFT JOIN {out}_b ON {' AND '.join(f'{out}_s.{x} IS NOT DISTINCT FROM {out}_b.{x}' for x in keys) if keys else 'true'})"""


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Round double columns: sums of doubles depend on their order in the last bits."""
    return df.select(
        *[
            (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


SUMMARY_COLS = """n_files, n_real, n_fake, round(eer, 8) AS eer, round(roc_auc, 8) AS roc_auc,
  round(tie_rate, 8) AS tie_rate, round(distinct_score_ratio, 8) AS distinct_score_ratio, note"""
