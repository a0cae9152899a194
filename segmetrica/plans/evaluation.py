"""Evaluation queries: EER, AUC, ties, slices, leave-one-family-out, bootstrap."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..operators import metrics as M
from ..operators import wide
from ..session import materialize
from . import bindings as B
from .registry import query

# E1, E5, E12: the flagship.
_families = """lofo_src AS (
  SELECT f.family AS held, i.label, i.score FROM file_scores i
  JOIN (SELECT DISTINCT family FROM file_scores WHERE label = 1) f ON i.label = 0 OR i.family = f.family)"""


@query(
    "file_eer_by_family",
    f"""WITH {B.FILE_SCORES}, {_families}, {B.sql_eer('lofo_src', ['held'], 'fam')},
{B.sql_eer('file_scores', [], 'total')}
SELECT 'all' AS subset, {B.SUMMARY_COLS} FROM total
UNION ALL SELECT 'family=' || held, {B.SUMMARY_COLS} FROM fam""",
)
def file_eer_by_family(spark, sf):
    scored = B.file_scores(spark, sf)
    overall = M.summarize(scored).withColumn("family", F.lit(None).cast("string"))
    lofo = M.leave_one_family_out(scored)
    both = overall.unionByName(lofo)
    return B.rounded(
        both.select(
            F.coalesce(F.concat(F.lit("family="), "family"), F.lit("all")).alias("subset"),
            "n_files", "n_real", "n_fake", "eer", "roc_auc", "tie_rate", "distinct_score_ratio", "note",
        )
    )


def _labels(spark, sf):
    """Labels and predictions of five outputs per file (voice labels may be unknown)."""
    d = B.score13(spark, sf)
    k = F.col("file_id")
    return d.select(
        "file_id", "grp", "family", "domain", "file_fake", "voice_fake", (k % 5 == 0).cast("int").alias("music_fake"),
        (k % 4 != 0).cast("int").alias("voice_present"), (k % 7 != 0).cast("int").alias("music_present"),
        F.col("current_file").alias("file_fake_prob"), F.col("current_voice").alias("voice_fake_prob"), F.col("current_music").alias("music_fake_prob"),
        F.col("voice_present").alias("voice_present_prob"), F.col("music_present").alias("music_present_prob"),
    )


LABELS = f"""{B.SCORE13}, lab AS (SELECT file_id, grp, family, domain, file_fake, voice_fake, (file_id%5=0)::INT AS music_fake, (file_id%4<>0)::INT AS vp, (file_id%7<>0)::INT AS mp,
  current_file AS fp, current_voice AS v, current_music AS m, voice_present AS vpp, music_present AS mpp FROM score13),
heads AS (SELECT 'file' AS head, file_fake AS label, fp AS score FROM lab UNION ALL SELECT 'voice', voice_fake, v FROM lab WHERE vp=1 AND voice_fake IS NOT NULL
  UNION ALL SELECT 'music', music_fake, m FROM lab WHERE mp=1 UNION ALL SELECT 'vp', vp, vpp FROM lab UNION ALL SELECT 'mp', mp, mpp FROM lab)"""


@query("score_breakdown", f"""WITH {LABELS}, {B.sql_eer('heads', ['head'], 'hs')},
p AS (SELECT max(CASE WHEN head='file' THEN eer END) AS fe, max(CASE WHEN head='voice' THEN eer END) AS ve, max(CASE WHEN head='music' THEN eer END) AS me,
 max(CASE WHEN head='vp' THEN roc_auc END) AS va, max(CASE WHEN head='mp' THEN roc_auc END) AS ma FROM hs),
q AS (SELECT *, 0.5e0*(1-fe)+0.2e0*(1-ve)+0.3e0*(1-me) AS a, 0.5e0*va+0.5e0*ma AS c FROM p)
SELECT round(fe,8) AS file_eer, round(ve,8) AS voice_eer, round(me,8) AS music_eer, round(va,8) AS voice_presence_auc, round(ma,8) AS music_presence_auc,
 round(a,8) AS ads, round(c,8) AS cps, round(0.9e0*a+0.1e0*c,8) AS score FROM q""")
def score_breakdown(spark, sf):
    return B.rounded(M.composite_score(_labels(spark, sf)))


@query("group_summaries", f"WITH {B.FILE_SCORES}, {B.sql_eer('file_scores', ['grp'], 'g')} SELECT grp, {B.SUMMARY_COLS} FROM g")
def group_summaries(spark, sf):
    """Per content group; single-class groups get NULL and a note."""
    return B.rounded(M.summarize(B.file_scores(spark, sf), ["grp"]))


@query("tie_stats", """WITH s AS (SELECT event_type, value/500 AS v, count(*) AS c FROM events GROUP BY 1,2)
SELECT event_type, sum(c)::BIGINT AS n, round(sum(CASE WHEN c>1 THEN c ELSE 0 END)/sum(c),8) AS tie_rate, round(count(*)/sum(c),8) AS distinct_score_ratio FROM s GROUP BY 1""")
def tie_stats(spark, sf):
    e = B.table(spark, sf, "events").select("event_type", (F.col("value") / 500).alias("v"))
    h = e.groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("c"))
    return B.rounded(h.groupBy("event_type").agg(
        F.sum("c").alias("n"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("tie_rate"),
        (F.count(F.lit(1)) / F.sum("c")).alias("distinct_score_ratio")))


_SLICE_COLS = ("current_file", "w025", "w05", "w1", "or0", "or1", "current_music")


@query("slice_metrics", f"""WITH {B.SCORE13}, s AS (SELECT *, current_file*0.75e0+0.25e0*lofcz AS w025, current_file*0.5e0+0.5e0*lofcz AS w05, lofcz AS w1,
   1e0-(1e0-current_voice)*(1e0-current_music) AS or0, least(1e0,current_voice+current_music) AS or1 FROM score13),
u AS (SELECT file_fake, domain, family, unnest(['current_file','w025','w05','w1','or0','or1','current_music']) AS name, round(unnest([current_file,w025,w05,w1,or0,or1,current_music]),6) AS score FROM s),
x AS (SELECT 'overall' AS slice, '' AS value, name, file_fake AS label, score FROM u UNION ALL SELECT 'domain', domain, name, file_fake, score FROM u UNION ALL SELECT 'generator', family, name, file_fake, score FROM u),
{B.sql_eer('x', ['slice', 'value', 'name'], 'z')} SELECT slice, value, name, n_files, n_real, n_fake, round(eer,7) AS eer, round(roc_auc,6) AS roc_auc FROM z""")
def slice_metrics(spark, sf):
    """Overall, by domain and by generator for seven score columns. Counts a bucket say where each slice's error rates cross; then
    every score moves once (``wide.sliced``)."""
    c = F.col
    d = B.score13(spark, sf).select("file_fake", "domain", "family", "current_file", "lofcz", "current_voice", "current_music")
    d = materialize(d, "slice-scores").select(
        "file_fake", F.to_json(F.struct("domain", "family")).alias("cell"), "current_file", A.linear_blend(c("current_file"), c("lofcz"), 0.25).alias("w025"),
        A.linear_blend(c("current_file"), c("lofcz"), 0.5).alias("w05"), c("lofcz").alias("w1"),
        A.combine(c("current_voice"), c("current_music"), "prob_or").alias("or0"), A.combine(c("current_voice"), c("current_music"), "sum_clipped").alias("or1"), "current_music")

    def columns(rows):
        label = rows.column("file_fake").to_numpy().astype(np.int64)
        for k, name in enumerate(_SLICE_COLS):
            yield k, wide.floats(rows, name), label, None

    cell = F.from_json("code", "domain string, family string")
    slices = F.array(*[F.struct(F.lit(s).alias("slice"), v.alias("value")) for s, v in (("overall", F.lit("")), ("domain", cell["domain"]), ("generator", cell["family"]))])
    out = wide.sliced(d, "cell", slices, ["slice", "value"], columns, len(_SLICE_COLS), places=6)
    name = F.element_at(F.array(*[F.lit(n) for n in _SLICE_COLS]), c("col") + 1)
    return out.select("slice", "value", name.alias("name"), "n_files", "n_real", "n_fake", F.round("eer", 7).alias("eer"), F.round("roc_auc", 6).alias("roc_auc"))


@query("channel_slices", f"WITH {B.FILE_SCORES}, {B.sql_eer('file_scores', ['domain'], 'g')}, m AS (SELECT domain, avg(CASE WHEN label=1 THEN score END) AS mf FROM file_scores GROUP BY 1) SELECT domain, n_files, n_fake, round(eer,8) AS eer, round(roc_auc,8) AS roc_auc, round(mf,8) AS mean_fake_prob FROM g JOIN m USING (domain)")
def channel_slices(spark, sf):
    d = B.file_scores(spark, sf)
    m = d.groupBy("domain").agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_fake_prob"))
    return B.rounded(M.summarize(d, ["domain"]).join(m, "domain").select("domain", "n_files", "n_fake", "eer", "roc_auc", "mean_fake_prob"))


@query("system_slices", f"""WITH {B.FILE_SCORES}, sysd AS (SELECT CASE WHEN file_id%6=0 THEN 'studio' ELSE family END AS system, CASE WHEN file_id%6=0 THEN 0 ELSE label END AS label, score FROM file_scores),
src AS (SELECT f.system AS held, i.label, i.score FROM sysd i JOIN (SELECT DISTINCT system FROM sysd WHERE label=1) f ON i.label=0 OR i.system=f.system), {B.sql_eer('src', ['held'], 'g')}
SELECT held AS system, n_files AS n, round(eer,8) AS eer, round(mf,8) AS mean_fake_prob FROM g JOIN (SELECT system AS held, avg(score) AS mf FROM sysd WHERE label=1 GROUP BY 1) USING (held)
UNION ALL SELECT system, count(*), NULL, round(avg(score),8) FROM sysd GROUP BY 1 HAVING max(label)=0""")
def system_slices(spark, sf):
    """Each system's fakes against all reals; all-real systems report only their mean."""
    s = B.file_scores(spark, sf)
    real = F.col("file_id") % 6 == 0
    s = s.withColumn("family", F.when(real, "studio").otherwise(F.col("family"))).withColumn("label", F.when(real, 0).otherwise(F.col("label")))
    means = s.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.max("label").alias("any"), F.avg("score").alias("all_mean"),
                                    F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("fake_mean"))
    lofo = M.leave_one_family_out(s).select("family", "n_files", "eer")
    out = means.join(lofo, "family", "left").select(
        F.col("family").alias("system"), F.when(F.col("any") == 1, F.col("n_files")).otherwise(F.col("c")).alias("n"), "eer",
        F.when(F.col("any") == 1, F.col("fake_mean")).otherwise(F.col("all_mean")).alias("mean_fake_prob"))
    return B.rounded(out)


_DRAWS = """gi AS (SELECT grp, row_number() OVER (ORDER BY md5('{seed}:'||grp), grp)-1 AS idx, count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM file_scores)),
times AS (SELECT replicate, d.idx, count(*) AS times FROM (SELECT r AS replicate, ('0x'||substr(md5('{seed}:'||r||':'||idx),1,8))::BIGINT % g AS idx FROM gi, range({n}) t(r)) d GROUP BY 1,2),
drawn AS (SELECT replicate, label, score, times FROM file_scores JOIN gi USING (grp) JOIN times USING (idx))"""
RESAMPLES = 1000


@query("cluster_bootstrap_ci", f"""WITH {B.FILE_SCORES}, {_DRAWS.format(seed=42, n=RESAMPLES)}, {B.sql_eer('drawn', ['replicate'], 'b', weight='times')}
SELECT (SELECT count(*) FROM gi)::BIGINT AS n_groups, {RESAMPLES}::BIGINT AS n_resamples, count(eer)::BIGINT AS n_effective, ({RESAMPLES}-count(eer))::BIGINT AS n_degenerate,
 round(quantile_cont(eer,0.025),8) AS lower, round(quantile_cont(eer,0.5),8) AS median, round(quantile_cont(eer,0.975),8) AS upper FROM b""")
def cluster_bootstrap_ci(spark, sf):
    return B.rounded(M.bootstrap_eer(B.file_scores(spark, sf), n_resamples=RESAMPLES, seed=42))


@query("worst_family_blend", f"""WITH {B.FILE_SCORES}, {_families}, {B.sql_eer('lofo_src', ['held'], 'fam')}, {B.sql_eer('file_scores', [], 'total')}
SELECT round(t.eer,8) AS overall_eer, round(w.e,8) AS worst_family_eer, w.held AS worst_family, round(0.5e0*w.e+0.5e0*t.eer,8) AS blend_eer
FROM total t, (SELECT held, eer AS e FROM fam WHERE eer IS NOT NULL ORDER BY eer DESC, held LIMIT 1) w""")
def worst_family_blend(spark, sf):
    d = B.file_scores(spark, sf)
    return B.rounded(M.worst_family(M.leave_one_family_out(d), M.summarize(d)))


@query("runtime_summary", """SELECT count(value)::BIGINT AS n_measured, round(avg(value),8) AS mean_seconds, round(quantile_cont(value,0.5),8) AS median_seconds, round(quantile_cont(value,0.9),8) AS p90_seconds,
 max(value) AS max_seconds, round(sum(value),4) AS measured_total_seconds, round(avg(value)*1000,4) AS extrapolated_total_seconds FROM events""")
def runtime_summary(spark, sf):
    r = M.runtime_summary(B.table(spark, sf, "events"), "value", 1000)
    return B.rounded(r.withColumn("measured_total_seconds", F.round("measured_total_seconds", 4)).withColumn("extrapolated_total_seconds", F.round("extrapolated_total_seconds", 4)))


@query("cross_entropy", f"WITH {B.FILE_SCORES} SELECT domain, round(-avg(label*ln(greatest(score,1e-6))+(1-label)*ln(greatest(1e0-score,1e-6))),8) AS bce FROM file_scores GROUP BY 1")
def cross_entropy(spark, sf):
    return B.rounded(M.cross_entropy(B.file_scores(spark, sf), ["domain"]))


@query("threshold_errors", f"WITH {B.FILE_SCORES} SELECT domain, sum((label=0 AND score>=0.5e0)::INT)::BIGINT AS false_alarms, sum((label=1 AND score<0.5e0)::INT)::BIGINT AS misses FROM file_scores GROUP BY 1")
def threshold_errors(spark, sf):
    return M.errors_at_threshold(B.file_scores(spark, sf), ["domain"], 0.5)


@query("selection_objective", f"""WITH {LABELS}, ext AS (SELECT 'external' AS head, music_fake AS label, m AS score FROM lab WHERE mp=1 AND domain='BUILDING'),
hh AS (SELECT * FROM heads WHERE head IN ('file','voice','music') UNION ALL SELECT * FROM ext), {B.sql_eer('hh', ['head'], 'hs')},
p AS (SELECT max(CASE WHEN head='file' THEN eer END) AS f, max(CASE WHEN head='voice' THEN eer END) AS v, max(CASE WHEN head='music' THEN eer END) AS m, max(CASE WHEN head='external' THEN eer END) AS x FROM hs)
SELECT round((f+v+(0.6e0*x+0.4e0*m))/3,8) AS objective FROM p""")
def selection_objective(spark, sf):
    """Equal-head mean of pooled FILE, pooled VOICE, and 0.6 external + 0.4 pooled MUSIC."""
    c = F.col
    head = lambda h, y, keep: F.struct(
        F.lit(h).alias("head"), c(y).alias("label"), c(f"{y}_prob").alias("score"), keep.alias("keep"))
    rows = F.array(
        head("file", "file_fake", F.lit(True)),
        head("voice", "voice_fake", c("voice_present") == 1),
        head("music", "music_fake", c("music_present") == 1),
        head("external", "music_fake", (c("music_present") == 1) & (c("domain") == "BUILDING")),
    )
    long = _labels(spark, sf).select(F.explode(rows).alias("h")).select("h.*").filter("keep AND label IS NOT NULL")
    e = M.eer(long, ["head"])
    v = lambda h: F.max(F.when(c("head") == h, c("eer")))
    return B.rounded(e.agg(((v("file") + v("voice") + (0.6 * v("external") + 0.4 * v("music"))) / 3).alias("objective")))


@query("rank_fusion", """WITH e AS (SELECT event_id, value/500 AS a, event_id*37%101/100e0 AS b, event_id*53%103/102e0 AS c FROM events),
r AS (SELECT *, (rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2e0)/count(*) OVER () AS ra, (rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2e0)/count(*) OVER () AS rb FROM e)
SELECT event_id, round(0.25e0*a+0.75e0*b,8) AS mean, round(greatest(a,b),8) AS max, round(least(a,b),8) AS min, round(0.5e0*ra+0.5e0*rb,8) AS rank_mean FROM r""")
def rank_fusion(spark, sf):
    from ..operators.fusion import fuse

    e = B.table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("a"), (F.col("event_id") * 37 % 101 / 100.0).alias("b"))
    d = fuse(e, ["a", "b"], "mean", {"a": 1, "b": 3}, "mean").drop("per_file_safe")
    d = fuse(d, ["a", "b"], "max", out="max").drop("per_file_safe")
    d = fuse(d, ["a", "b"], "min", out="min").drop("per_file_safe")
    d = fuse(d, ["a", "b"], "rank_mean", out="rank_mean")
    return B.rounded(d.select("event_id", "mean", "max", "min", "rank_mean"))


# --- grids --------------------------------------------------------------------------

def _pooled(spark, sf):
    from ..operators.grid import pooled_streams

    d = B.items(spark, sf).withColumn("label", F.col("file_fake"))
    return pooled_streams(B.segment_scores(spark, sf), d)


def _pool_sql(s):
    here = f"CASE WHEN stream='{s}'"
    top = [f"coalesce(avg({here} AND k<={k} THEN score END),0e0) AS {s[:2]}_top{k}" for k in (2, 3)]
    return ", ".join([f"coalesce(max({here} THEN score END),0e0) AS {s[:2]}_max", f"coalesce(avg({here} THEN score END),0e0) AS {s[:2]}_mean", *top])


_POOLED = f"""{B.SEGMENTS}, {B.ITEMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY file_id, stream ORDER BY score DESC) AS k FROM segments),
pl AS (SELECT file_id, {', '.join(_pool_sql(s) for s in ('voice', 'music', 'mixture'))} FROM rk GROUP BY 1),
pooled AS (SELECT items.*, file_fake AS label, {', '.join(f"coalesce({s}_{p},0e0) AS {s}_{p}" for s in ('vo', 'mu', 'mi') for p in ('max', 'mean', 'top2', 'top3'))} FROM items LEFT JOIN pl USING (file_id))"""


def _sql_pool(stream, pooling):
    if pooling.startswith("mix"):
        a = float(pooling[3:])
        return f"({a!r}e0*{stream}_mean+{1.0 - a!r}e0*{stream}_max)"
    return f"{stream}_{pooling}"


def _sql_formula(f):
    g = lambda s, e, p: f"{'' if e == 0 else ('voice_present*' if s == 'vo' else 'music_present*')}{_sql_pool(s, p)}"
    v, m = g("vo", f["voice_exponent"], f["voice_pooling"]), g("mu", f["music_exponent"], f["music_pooling"])
    x = {"max": f"greatest({v},{m})", "prob_or": f"(1e0-(1e0-{v})*(1e0-{m}))", "sum_clipped": f"least(1e0,{v}+{m})"}[f["combine"]]
    w = f["mixture_weight"]
    if w:
        x = f"({1 - w!r}e0*{x}+{w!r}e0*{_sql_pool('mi', f['mixture_pooling'])})"
    return f"least(1e0,greatest(0e0,{x}))::DOUBLE"


def _register_sweep():
    from ..operators import grid as GR

    grid = GR.build_grid()
    arr = ", ".join(_sql_formula(f) for f in grid)
    keys = ", ".join(f"'{f['formula_key']}'" for f in grid)
    names = ", ".join(f"'{f['name']}'" for f in grid)
    scored = f"{_POOLED}, sg AS (SELECT file_id, family, grp, label, unnest(range({len(grid)})) AS formula_id, round(unnest([{arr}]),9) AS score FROM pooled)"

    @query("formula_scores", f"WITH {scored} SELECT formula_id::INT AS formula_id, count(*)::BIGINT AS n, round(avg(score),7) AS mean_score, round(max(score),7) AS max_score FROM sg GROUP BY 1")
    def formula_scores(spark, sf):
        return B.rounded(GR.grid_means(_pooled(spark, sf), grid), 7)

    @query("grid_sweep_rank", f"""WITH {scored}, lf AS (SELECT formula_id, f.family AS held, i.label, i.score FROM sg i JOIN (SELECT DISTINCT family FROM sg WHERE label=1) f ON i.label=0 OR i.family=f.family),
{B.sql_eer('lf', ['formula_id', 'held'], 'fam')}, {B.sql_eer('sg', ['formula_id'], 'tot')},
w AS (SELECT formula_id, max(eer) AS we, arg_min(held, (-eer, held)) AS wf FROM fam WHERE eer IS NOT NULL GROUP BY 1),
j AS (SELECT t.formula_id, [{keys}][t.formula_id+1] AS formula_key, [{names}][t.formula_id+1] AS name, t.eer, t.roc_auc, we, wf FROM tot t JOIN w USING (formula_id))
SELECT row_number() OVER (ORDER BY we, eer, formula_key, formula_id)::INT AS rank, name, formula_key, round(eer,8) AS eer, round(roc_auc,7) AS roc_auc, round(we,8) AS worst_family_eer, wf AS worst_family, round(0.5e0*we+0.5e0*eer,8) AS blend_eer FROM j""")
    def grid_sweep_rank(spark, sf):
        r = GR.sweep(_pooled(spark, sf), grid, n_resamples=0, places=9)
        r = r.select("rank", "name", "formula_key", "eer", F.round("roc_auc", 7).alias("roc_auc"), "worst_family_eer", "worst_family", "blend_eer")
        return B.rounded(r)

    @query("grid_sweep_intervals")
    def grid_sweep_intervals(spark, sf):
        """The whole sweep: every formula with the interval of its EER from 1,000 resamples of the groups, which ranks ties."""
        r = GR.sweep(_pooled(spark, sf), grid, n_resamples=RESAMPLES, places=9)
        return B.rounded(r.select("rank", "name", "formula_key", "eer", "lower", "upper", "worst_family_eer", "worst_family", "blend_eer"))


_register_sweep()


_WLIST = "[" + ",".join(f"{0.05 * i:.2f}e0" for i in range(21)) + "]"
_WEIGHTED = f"""{B.SCORE13}, wc AS (SELECT CASE WHEN file_id//7%2=0 THEN 'val' ELSE 'test' END AS split, domain, file_fake, voice_fake, CASE WHEN file_id%6=0 THEN NULL WHEN file_fake=1 AND file_id%2=0 THEN 1 ELSE 0 END AS music_fake, unnest({_WLIST}) AS w, (file_id%4<>0) AS vp, (file_id%5<>0) AS mp, current_file, current_voice, nii, spectra, lofcz, voice_present, music_present, current_music FROM score13),
wl AS (SELECT split, domain, 'file' AS head, w, file_fake AS label, round(greatest(CASE WHEN w=0 THEN current_file ELSE {B.sql_logit_blend('current_file', 'spectra', 0).replace('1*', '(1e0-w)*').replace('+ 0*', '+ w*')} END, voice_present*current_voice, music_present*current_music),7) AS score FROM wc
 UNION ALL SELECT split, domain, 'voice', w, voice_fake, round(CASE WHEN w=0 THEN current_voice ELSE {B.sql_logit_blend('current_voice', 'nii', 0).replace('1*', '(1e0-w)*').replace('+ 0*', '+ w*')} END,7) FROM wc WHERE vp AND voice_fake IS NOT NULL
 UNION ALL SELECT split, domain, 'music', w, music_fake, round(CASE WHEN w=0 THEN current_music ELSE {B.sql_logit_blend('current_music', 'lofcz', 0).replace('1*', '(1e0-w)*').replace('+ 0*', '+ w*')} END,7) FROM wc WHERE mp AND music_fake IS NOT NULL)"""


def _sigmoid(z):
    import numpy as np

    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def weight_curves(spark, sf, parts=False):
    """EER by (head, w), with ``parts`` also by (scope, part): the two splits and the panels, of which a file has one each.
    FILE is blended before the floor, VOICE and MUSIC after it. Rounded, so that both engines see the same ties."""
    import numpy as np

    from ..operators import grid as GR
    from ..operators.wide import floats

    c = F.col
    d = B.score13(spark, sf).select(
        "file_fake", "voice_fake",
        F.when(c("file_id") % 6 == 0, None).when((c("file_fake") == 1) & (c("file_id") % 2 == 0), 1).otherwise(0).alias("music_fake"),
        (c("file_id") % 4 != 0).cast("int").alias("vp"), (c("file_id") % 5 != 0).cast("int").alias("mp"),
        "current_file", "current_voice", "current_music",
        *[A.ratio_logit(c(x)).alias(f"l_{x}") for x in ("current_file", "spectra", "current_voice", "nii", "current_music", "lofcz")],
        F.greatest(c("voice_present") * c("current_voice"), c("music_present") * c("current_music")).alias("floor"),
        *([F.explode(F.array(F.concat(F.lit("split:"), F.when(F.expr("file_id div 7 % 2 = 0"), "val").otherwise("test")),
                             F.concat(F.lit("panel:"), c("domain")))).alias("at")] if parts else []))

    def mixed(rows, cur, new, w):
        return floats(rows, cur) if w == 0 else _sigmoid((1.0 - w) * floats(rows, f"l_{cur}") + w * floats(rows, f"l_{new}"))

    curves = GR.weight_curve(d, {
        "file": ("file_fake", lambda r, w: np.fmax(mixed(r, "current_file", "spectra", w), floats(r, "floor")), None),
        "voice": ("voice_fake", lambda r, w: mixed(r, "current_voice", "nii", w), "vp"),
        "music": ("music_fake", lambda r, w: mixed(r, "current_music", "lofcz", w), "mp"),
    }, ["at"] if parts else [], places=7)
    if not parts:
        return curves
    # a file without a domain has the part NULL of the panels, whose code is NULL
    return curves.select(F.coalesce(F.substring_index("at", ":", 1), F.lit("panel")).alias("scope"), F.expr("substring(at, instr(at, ':') + 1)").alias("part"), "head", "w", "eer")


@query("weight_curve", f"WITH {_WEIGHTED}, {B.sql_eer('wl', ['head', 'w'], 'cv')} SELECT head, w::DOUBLE AS w, round(eer,8) AS eer FROM cv")
def weight_curve(spark, sf):
    return B.rounded(weight_curves(spark, sf).select("head", "w", "eer"))


@query("weight_curve_argmin", f"""WITH {_WEIGHTED}, {B.sql_eer('wl', ['head', 'w'], 'cv')}, sm AS (SELECT head, w, avg(eer) OVER (PARTITION BY head ORDER BY w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM cv),
r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY s, w) AS k FROM sm) SELECT head, w::DOUBLE AS chosen_w, round(s,8) AS smooth_eer FROM r WHERE k=1""")
def weight_curve_argmin(spark, sf):
    from ..operators import grid as GR

    return B.rounded(GR.smooth_argmin(weight_curves(spark, sf), ["head"]))


@query("weight_transfer", f"""WITH {_WEIGHTED}, wt AS (SELECT 'split' AS scope, split AS part, head, w, label, score FROM wl UNION ALL SELECT 'panel', domain, head, w, label, score FROM wl),
{B.sql_eer('wt', ['scope', 'part', 'head', 'w'], 'cv')}, sm AS (SELECT head, part, w, avg(eer) OVER (PARTITION BY head, part ORDER BY w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM cv WHERE scope='split'),
ch AS (SELECT head, part, arg_min(w, (s, w)) AS cw FROM sm GROUP BY 1, 2)
SELECT ch.head, o.scope, ch.part AS fitted_on, o.part AS read_on, ch.cw::DOUBLE AS chosen_w, round(o.eer,8) AS eer, round(z.eer,8) AS base_eer FROM ch
JOIN cv o ON o.head=ch.head AND o.w=ch.cw AND ((o.scope='split' AND o.part<>ch.part) OR (o.scope='panel' AND ch.part='test'))
JOIN cv z ON z.head=o.head AND z.scope=o.scope AND z.part=o.part AND z.w=0""")
def weight_transfer(spark, sf):
    """Weights chosen on one split and read on the other, both ways; those chosen on test also read on every panel."""
    from ..operators import grid as GR

    return B.rounded(GR.transfer_weights(weight_curves(spark, sf, parts=True), "test"))


# Labels of the three heads, and who is eligible: a stream's head only where the stream is present and labelled.
_HEAD_LABELS = f"""hl AS (SELECT file_id, 'file' AS head, file_fake AS label FROM items
 UNION ALL SELECT file_id, 'voice', voice_fake FROM items WHERE file_id%4<>0 AND voice_fake IS NOT NULL
 UNION ALL SELECT file_id, 'music', CASE WHEN file_fake=1 AND file_id%2=0 THEN 1 ELSE 0 END FROM items WHERE file_id%5<>0 AND file_id%6<>0)"""


def head_labels(spark, sf):
    i, k = B.items(spark, sf), F.col("file_id")
    music = F.when((F.col("file_fake") == 1) & (k % 2 == 0), 1).otherwise(0)
    heads = F.array(
        F.struct(F.lit("file").alias("head"), F.col("file_fake").alias("label"), F.lit(True).alias("ok")),
        F.struct(F.lit("voice").alias("head"), F.col("voice_fake").alias("label"), (k % 4 != 0).alias("ok")),
        F.struct(F.lit("music").alias("head"), music.alias("label"), ((k % 5 != 0) & (k % 6 != 0)).alias("ok")))
    return i.select("file_id", F.explode(heads).alias("h")).select("file_id", "h.*").where("ok AND label IS NOT NULL").drop("ok")


def pool_features(spark, sf, cells=None):
    from .segments import pooled_heads

    i, k = B.items(spark, sf), F.col("file_id")
    labels = i.select(
        "file_id", F.col("file_fake").alias("file"), F.when(k % 4 != 0, F.col("voice_fake")).alias("voice"),
        F.when((k % 5 != 0) & (k % 6 != 0), F.when((F.col("file_fake") == 1) & (k % 2 == 0), 1).otherwise(0)).alias("music"))
    return pooled_heads(spark, sf, cells, labels).select("head", "tau", "gamma", F.col("pooled").alias("x"), "label")


@query("pooling_search")
def pooling_search(spark, sf):
    """Affine fit, EER and cross-entropy of every (tau, gamma) of every head, ranked within a head by (EER, cross-entropy)."""
    from ..operators import grid as GR
    from ..operators.prefix import attach
    from .segments import head_cells

    # a few pools at a time, whose features are removed: on large tables what lies on disk at once is a part of them
    pools = head_cells()
    width = max(1, len(wide.passes(len(pools) * len(GR.TAUS), B.items(spark, sf).count())[0]) // len(GR.TAUS))
    parts = [GR.fit_pooling(pool_features(spark, sf, pools[k : k + width]), ["head", "tau", "gamma"]) for k in range(0, len(pools), width)]
    cells = materialize(reduce(DataFrame.unionByName, parts), "pooling-cells")
    best = GR.best_by(cells, ["head"], [F.col("eer"), F.col("bce"), F.col("tau"), F.col("gamma")], ["tau", "gamma"])
    out = attach(cells, best.select("head", F.col("tau").alias("best_tau"), F.col("gamma").alias("best_gamma")), ["head"])
    chosen = (F.col("tau") == F.col("best_tau")) & (F.col("gamma") == F.col("best_gamma"))
    return B.rounded(out.select("head", "tau", "gamma", "a", "b", "eer", "bce", chosen.alias("chosen")), 6)


def _voice_sql():
    from . import segments as G

    return G._VOICE, G._HEADS_SQL


_POOLED_HEADS = ", ".join(f"avg(z_{h}) AS mean_{h}, max(z_{h}) AS mx_{h}, ln(avg(exp(z_{h}-zm_{h})))+max(zm_{h}) AS lse_{h}" for h in ("file", "voice", "music"))
_PEAKS = ", ".join(f"max(z_{h}) OVER (PARTITION BY file_id) AS zm_{h}" for h in ("file", "voice", "music"))
_HEAD_POOLS = " UNION ALL ".join(
    f"SELECT file_id, '{h}' AS head, unnest(['mean','max','lse1']) AS pool, round(1e0/(1e0+exp(-unnest([mean_{h},mx_{h},lse_{h}]))),7) AS score FROM pz" for h in ("file", "voice", "music"))


@query("file_pool_eval", f"""WITH {', '.join(_voice_sql())}, {B.ITEMS}, {_HEAD_LABELS}, pz AS (SELECT file_id, {_POOLED_HEADS} FROM (SELECT *, {_PEAKS} FROM hz) GROUP BY 1),
u AS ({_HEAD_POOLS}), hp AS (SELECT head, pool, label, score FROM u JOIN hl USING (file_id, head)), {B.sql_eer('hp', ['head', 'pool'], 'r')}
SELECT head, pool, round(eer,8) AS eer FROM r UNION ALL SELECT 'all', 'mean_lse1', round(avg(eer),8) FROM r WHERE pool='lse1'""")
def file_pool_eval(spark, sf):
    """EER of mean, max and smooth-max pooled window logits of three heads, and the mean of the smooth-max EERs."""
    from ..operators import crossing as C
    from ..operators.pooling import smooth_max_pools
    from .segments import head_windows

    heads = ("file", "voice", "music")
    w = head_windows(spark, sf)
    plain = w.groupBy("file_id").agg(*[f(f"z_{h}").alias(f"{n}_{h}") for h in heads for n, f in (("mean", F.avg), ("mx", F.max))])
    p = plain.join(smooth_max_pools(w, ["file_id"], [(F.col(f"z_{h}"), None) for h in heads]), "file_id")
    s = lambda z: F.round(A.sigmoid(F.col(z)), 7)
    cells = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(n).alias("pool"), s(z).alias("score"))
                      for i, h in enumerate(heads) for n, z in (("mean", f"mean_{h}"), ("max", f"mx_{h}"), ("lse1", f"x_{i}_0"))])
    long = p.select("file_id", F.explode(cells).alias("c")).select("file_id", "c.*").join(head_labels(spark, sf), ["file_id", "head"])
    e = C.eer(long, ["head", "pool"])
    mean3 = e.filter("pool = 'lse1'").agg(F.lit("all").alias("head"), F.lit("mean_lse1").alias("pool"), F.avg("eer").alias("eer"))
    return B.rounded(e.unionByName(mean3))
