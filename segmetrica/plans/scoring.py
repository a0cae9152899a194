"""Score algebra, feature sets, frozen scorers and the staged cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions.features import SCORE_FIELDS, feature_names, feature_set
from ..operators import intervals as I
from ..operators import scorers as S
from . import bindings as B
from . import models as MD
from . import segments as G
from .registry import query

L, SG, LB = B.sql_logit, B.sql_sigmoid, B.sql_logit_blend

# --- score algebra ------------------------------------------------------------------


@query("score_algebra", f"""WITH {B.SCORE13} SELECT file_id, round({L('df_voice_mean')},7)+0e0 AS logit_p, round({SG('(spectra-0.5)*20')},8) AS sig,
 round(0.375e0*df_voice_mean+0.625e0*spectra,8) AS lin, round({LB('current_voice', 'nii', 0.2)},8) AS log_blend,
 round(voice_present*df_voice_mean,8) AS gate1, round(pow(voice_present,0.5e0)*df_voice_mean,8) AS gate_half, round(df_voice_mean,8) AS gate0,
 round(greatest(spectra,nii),8) AS c_max, round(1e0-(1e0-spectra)*(1e0-nii),8) AS c_or, round(least(1e0,spectra+nii),8) AS c_sum, round((spectra+nii)*0.5e0,8) AS c_mean,
 round({SG('-(nii-0.5)*6')},8) AS reversed, round({SG('spectra*3-nii*2')},8) AS softmax0, round(0.5e0+atan((lofcz-0.5)*9)/pi(),8) AS squash FROM score13""")
def score_algebra(spark, sf):
    c = F.col
    sp, ni, dv, vp = c("spectra"), c("nii"), c("df_voice_mean"), c("voice_present")
    return B.rounded(B.score13(spark, sf).select(
        "file_id", F.round(A.logit(dv), 7).alias("logit_p"), A.sigmoid((sp - 0.5) * 20).alias("sig"),
        A.linear_blend(dv, sp, 0.625).alias("lin"), A.logit_blend(c("current_voice"), ni, 0.2).alias("log_blend"),
        A.gate(dv, vp, 1).alias("gate1"), A.gate(dv, vp, 0.5).alias("gate_half"), A.gate(dv, vp, 0).alias("gate0"),
        A.combine(sp, ni, "max").alias("c_max"), A.combine(sp, ni, "prob_or").alias("c_or"),
        A.combine(sp, ni, "sum_clipped").alias("c_sum"), A.combine(sp, ni, "mean").alias("c_mean"),
        A.reversed_logit_to_fake((ni - 0.5) * 6).alias("reversed"),
        A.two_class_softmax(F.array(sp * 3, ni * 2), 0).alias("softmax0"), A.margin_squash((c("lofcz") - 0.5) * 9).alias("squash"),
    ))


_BAD = "CASE WHEN file_id%19=0 THEN NULL WHEN file_id%23=0 THEN 'nan'::DOUBLE WHEN file_id%29=0 THEN 1.5e0 ELSE spectra END"


def _with_invalid(d):
    k = F.col("file_id")
    return d.withColumn("bad", F.when(k % 19 == 0, None).when(k % 23 == 0, float("nan")).when(k % 29 == 0, 1.5).otherwise(F.col("spectra")))


@query("logit_blend_floor", f"""WITH {B.SCORE13}, b AS (SELECT *, {_BAD} AS bad FROM score13), v AS (SELECT *, bad IS NOT NULL AND NOT isnan(bad) AND bad BETWEEN 0 AND 1 AS ok FROM b),
m AS (SELECT *, {LB('current_file', 'nii', 0.15)} AS cand FROM v)
SELECT file_id, ok AS valid, CASE WHEN ok THEN round(greatest(cand, voice_present*bad, music_present*current_music),10) ELSE round(cand,10) END AS floored,
 round(CASE WHEN ok THEN bad ELSE current_voice END,10) AS retained FROM m""")
def logit_blend_floor(spark, sf):
    d = _with_invalid(B.score13(spark, sf))
    c = F.col
    cand = A.logit_blend(c("current_file"), c("nii"), A.TUNED_WEIGHTS["file"])
    return B.rounded(d.select(
        "file_id", A.is_probability(c("bad")).alias("valid"),
        A.component_floor(cand, c("bad"), c("current_music"), c("voice_present"), c("music_present")).alias("floored"),
        A.retain(c("bad"), c("current_voice")).alias("retained"),
    ), 10)


@query("invalid_probabilities", f"""WITH {B.SCORE13}, b AS (SELECT *, {_BAD} AS bad FROM score13)
SELECT file_id, CASE WHEN bad IS NULL THEN 'missing' WHEN isnan(bad) THEN 'not a number' ELSE 'out of range' END AS rule FROM b
WHERE NOT (bad IS NOT NULL AND NOT isnan(bad) AND bad BETWEEN 0 AND 1)""")
def invalid_probabilities(spark, sf):
    b = F.col("bad")
    d = _with_invalid(B.score13(spark, sf)).filter(~A.is_probability(b))
    return d.select("file_id", F.when(b.isNull(), "missing").when(F.isnan(b), "not a number").otherwise("out of range").alias("rule"))


@query("margin_scores", """SELECT vec_id, round(0.5e0+atan(list_sum(list_transform(embedding::DOUBLE[], lambda v, i: v*(((i-1)*13%17-8)/20e0)))-0.125e0)/pi(),8) AS score FROM embeddings""")
def margin_scores(spark, sf):
    w = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i * 13) % 17 - 8) / 20.0)
    return B.rounded(B.table(spark, sf, "embeddings").select(
        "vec_id", A.margin_squash(A.dot(F.col("embedding"), w) - 0.125).alias("score")))


@query("nullable_labels", """SELECT event_id, CASE WHEN t IN ('','nan','None') THEN NULL ELSE trunc(t::DOUBLE)::INT END AS label
FROM (SELECT event_id, CASE event_id%6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'None' WHEN 3 THEN '1.0' WHEN 4 THEN '0' ELSE value::VARCHAR END AS t FROM events)""")
def nullable_labels(spark, sf):
    m = F.col("event_id") % 6
    raw = F.when(m == 0, " ").when(m == 1, "nan").when(m == 2, "None").when(m == 3, "1.0").when(m == 4, "0").otherwise(F.col("value").cast("string"))
    return B.table(spark, sf, "events").select("event_id", A.nullable_label(raw).alias("label"))


# --- feature sets -------------------------------------------------------------------

def evidence(spark, sf):
    """score13 with the later-stage scores filled in by fixed rules."""
    d = B.score13(spark, sf)
    k = F.col("file_id")
    d = d.withColumn("voice44", A.incumbent_voice(F.col("df_voice_mean"), F.col("nii"), F.col("eliya_fake"), F.col("spectra_scores")))
    return (
        d.withColumn("voice38", F.col("voice44"))
        .withColumn("music17", (k * 83) % 151 / F.lit(150.0))
        .withColumn("file29", (k * 89) % 157 / F.lit(156.0))
        .withColumn("margin", ((k * 97) % 163 - 81) / F.lit(20.0))
    )


_SPM = "list_avg(spectra_scores)"
VOICE44 = f"0.75e0*{LB('(0.375e0*df_voice_mean+0.625e0*' + _SPM + ')', 'nii', 0.2)}+0.25e0*eliya_fake"
EVIDENCE = f"""{B.SCORE13}, evidence AS (SELECT *, {VOICE44} AS voice44, {VOICE44} AS voice38, (file_id*83)%151/150e0 AS music17,
  (file_id*89)%157/156e0 AS file29, ((file_id*97)%163-81)/20e0 AS margin FROM score13)"""


def sql_features(name: str) -> list[str]:
    base = [L(f) for f in SCORE_FIELDS] + [L(f"({a}*{b})") for a, b in (
        ("voice_present", "df_voice_mean"), ("voice_present", "current_voice"), ("music_present", "file_music"), ("music_present", "current_music"))]
    gated = lambda x: [L(x), L(f"(voice_present*{x})")]
    stats = lambda a: gated(f"list_avg({a})") + gated(f"list_max({a})") + [f"(list_max({a})-list_min({a}))"]
    ev = base + gated("eliya_fake") + stats("spectra_scores")
    st = ev + [L("music17")]
    sv = "round(round(voice_present,10)*round(voice38,10),10)"
    sm = "round(round(music_present,10)*round(music17,10),10)"
    su = st + [L("round(voice38,10)"), L(sv), L(sm), L(f"greatest({sv},{sm})")]
    v, m = "round(voice38,10)", "round(music17,10)"
    return {
        "file17": base, "music17": base, "peak19": base + gated("df_voice_max"), "aux19": base + gated("nes2_fake"),
        "evidence24": ev, "music24": ev, "temporal29": ev + stats("eliya_scores"), "stacked25": st, "support29": su,
        "mms31": su + gated("mms_fake"), "nes31": su + gated("nes2_fake"), "raw31": su + [L("raw_df_mean"), L("raw_df_max")],
        "consistency33": su + [L("round(file29,10)"), L(f"round(abs({v}-{m}),10)"), L(f"round({v}*(1e0-round(voice_present,10)),10)"),
                               L(f"round({m}*(1e0-round(music_present,10)),10)")],
        "margin18": base + ["margin"],
        "voice8": [L("df_voice_mean"), L("nii"), L("eliya_fake"), L(_SPM), L("list_max(spectra_scores)"), L("voice_present"), L("voice44"),
                   "(list_max(spectra_scores)-list_min(spectra_scores))"],
    }[name]


def _register_features(name: str):
    parts = sql_features(name)
    names = feature_names(name)
    cols = ", ".join(f"round({e},5)+0e0 AS {n}" for n, e in zip(names, parts))

    @query(f"features_{name}", f"WITH {EVIDENCE} SELECT file_id, {cols} FROM evidence")
    def run(spark, sf):
        return B.rounded(evidence(spark, sf).select("file_id", *[c.alias(n) for n, c in feature_set(name)]), 5)


def _register_trees(name: str, seed: int):
    n = len(sql_features(name))
    sql_seed = MD.sql_tree("f", n, seed)
    rule = "raw_df_mean <= raw_df_max + 1e-12" if name == "raw31" else "true"

    @query(f"tree_score_{name}", f"""WITH {EVIDENCE}, f AS (SELECT file_id, {rule} AS ok, [{', '.join(sql_features(name))}]::FLOAT[] AS f FROM evidence)
SELECT file_id, CASE WHEN ok THEN round({sql_seed},7) END AS score FROM f""")
    def run(spark, sf):
        d = S.tree_score(evidence(spark, sf), name, MD.tree_model(n, seed), "score")
        # No filter on the score: it would be pushed down through every projection.
        return B.rounded(d.select("file_id", "score"), 7)


TREE_SETS = {"file17": 1, "peak19": 2, "aux19": 3, "evidence24": 4, "temporal29": 5, "stacked25": 6, "support29": 7, "mms31": 8,
             "nes31": 9, "raw31": 10, "consistency33": 11, "margin18": 12, "voice8": 13}
for _name, _seed in TREE_SETS.items():
    _register_features(_name)
    _register_trees(_name, _seed)


@query("linear_score_file17", f"""WITH {EVIDENCE}, f AS (SELECT file_id, [{', '.join(sql_features('file17'))}] AS f FROM evidence)
SELECT file_id, round({SG('-0.125e0+list_sum(list_transform(f, lambda v, i: (v-(((i-1)*7%11-5)/10e0))/(((i-1)%5+2)/2e0)*(((i-1)*13%17-8)/20e0)))')},7) AS score FROM f""")
def linear_score_file17(spark, sf):
    pairs = feature_set("file17")
    d = evidence(spark, sf).select("file_id", *[c.alias(n) for n, c in pairs])
    return B.rounded(S.linear_score(d, [n for n, _ in pairs], MD.linear_model(17), "score").select("file_id", "score"), 7)


@query("linear_score_embedding", f"""WITH {EVIDENCE}, f AS (SELECT file_id, list_concat([{', '.join(sql_features('file17'))}], embedding::DOUBLE[]) AS f FROM evidence JOIN embeddings ON vec_id=file_id % (SELECT count(*) FROM embeddings))
SELECT file_id, round({SG('-0.125e0+list_sum(list_transform(f, lambda v, i: (v-(((i-1)*7%11-5)/10e0))/(((i-1)%5+2)/2e0)*(((i-1)*13%17-8)/20e0)))')},7) AS score FROM f""")
def linear_score_embedding(spark, sf):
    """The 17 logits of every file followed by an embedding. Vectors are given to files by their number in turn.

    A vector's share of the sum is the same for all its files: it is computed once, and the join carries a number.
    """
    pairs = feature_set("music17")
    e = B.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    of_file = F.pmod(F.col("file_id"), e.select(F.count(F.lit(1))).scalar())
    i = F.sequence(F.lit(len(pairs)), F.size("x") + (len(pairs) - 1))
    e = e.select("vec_id", S.linear_sum_array("x", F.transform(i, lambda k: ((k * 7) % 11 - 5) / 10.0), F.transform(i, lambda k: (k % 5 + 2) / 2.0),
                                              F.transform(i, lambda k: ((k * 13) % 17 - 8) / 20.0)).alias("_shared"))
    model = MD.linear_model(len(pairs))
    own = F.lit(model["intercept"])
    for (_, x), m, s, c in zip(pairs, model["mean"], model["scale"], model["coef"]):
        own = own + (x - F.lit(m)) / F.lit(s) * F.lit(c)
    d = evidence(spark, sf).withColumn("_vec", of_file).join(e, F.col("_vec") == F.col("vec_id")).select("file_id", (own + F.col("_shared")).alias("_z"))
    return B.rounded(d.select("file_id", A.sigmoid(F.col("_z")).alias("score")), 7)


@query("incumbent_voice_binding", f"""WITH {EVIDENCE}, s AS (SELECT *, CASE WHEN file_id%9=0 THEN voice44+1e-6 ELSE voice44 END AS stored FROM evidence)
SELECT file_id, round(voice44,8) AS recomputed, file_id%9=0 AS differs FROM s""")
def incumbent_voice_binding(spark, sf):
    """The stored VOICE must equal its recomputation bit for bit."""
    d = evidence(spark, sf)
    stored = F.when(F.col("file_id") % 9 == 0, F.col("voice44") + 1e-6).otherwise(F.col("voice44"))
    again = A.incumbent_voice(F.col("df_voice_mean"), F.col("nii"), F.col("eliya_fake"), F.col("spectra_scores"))
    return B.rounded(d.select("file_id", again.alias("recomputed"), (stored != again).alias("differs")))


# --- cascade and publishing ---------------------------------------------------------

CASCADE = {"file17": (17, 21), "file24": (24, 22), "music17": (17, 23), "file25": (25, 24), "duration25": (25, 25), "native25": (25, 26), "support29": (29, 27)}


def _faulty(d):
    """Some files miss evidence, so that later stages have to keep earlier scores."""
    k = F.col("file_id")
    return (
        d.withColumn("eliya_fake", F.when(k % 11 != 0, F.col("eliya_fake")))
        .withColumn("lofcz", F.when(k % 13 != 0, F.col("lofcz")))
        .withColumn("voice38", F.when(k % 17 != 0, F.col("voice38")))
    )


def _stage(name, seed, extra=""):
    return MD.sql_tree(f"([{', '.join(sql_features(name))}]::FLOAT[])", len(sql_features(name)), seed)


_FAULTY = f"""{B.SCORE13}, faulty AS (SELECT * REPLACE (CASE WHEN file_id%11<>0 THEN eliya_fake END AS eliya_fake, CASE WHEN file_id%13<>0 THEN lofcz END AS lofcz),
   CASE WHEN file_id%17<>0 THEN v44 END AS voice38 FROM (SELECT *, {VOICE44} AS v44 FROM score13)),
c0 AS (SELECT *, CASE WHEN lofcz IS NULL THEN current_music ELSE 0.03125e0*current_music+0.96875e0*lofcz END AS music_13 FROM faulty),
c1 AS (SELECT *, lofcz IS NOT NULL AS ok17, lofcz IS NOT NULL AND eliya_fake IS NOT NULL AS ok24 FROM c0),
c2 AS (SELECT *, CASE WHEN ok17 THEN {_stage('file17', 21)} ELSE current_file END AS file_17,
   CASE WHEN ok17 THEN {_stage('music17', 23)} ELSE music_13 END AS music17 FROM c1),
c3 AS (SELECT *, CASE WHEN ok24 THEN {_stage('evidence24', 22)} ELSE file_17 END AS file_24 FROM c2),
c4 AS (SELECT *, CASE WHEN ok24 THEN {_stage('stacked25', 26)} ELSE file_24 END AS file_25n FROM c3),
cascade AS (SELECT *, CASE WHEN ok24 AND voice38 IS NOT NULL THEN {_stage('support29', 27)} ELSE file_25n END AS file_score,
   ok24 AND voice38 IS NOT NULL AS ok29 FROM c4)"""


@query("file_cascade", f"WITH {_FAULTY} SELECT file_id, ok17 AS ok_17, ok24 AS ok_24, ok29 AS ok_29, round(file_17,7) AS file_17, round(file_24,7) AS file_24, round(file_25n,7) AS file_25n, round(file_score,7) AS file_score, round(music17,7) AS music17 FROM cascade")
def file_cascade(spark, sf):
    d = _cascade(spark, sf)
    return B.rounded(d.select("file_id", "ok_17", "ok_24", "ok_29", "file_17", "file_24", "file_25n", "file_score", "music17"), 7)


def _cascade(spark, sf):
    d = _faulty(evidence(spark, sf).drop("music17", "file29"))
    return S.cascade(d, {k: MD.tree_model(n, seed) for k, (n, seed) in CASCADE.items()})


@query("publish_outputs", f"""WITH {EVIDENCE}, s AS (SELECT file_id, round(current_file,10) AS f0, round(voice38,10) AS v0, round(current_music,10) AS m0, round((file_id*59)%113/113e0,10) AS vp, round((file_id*67)%131/131e0,10) AS mp,
  CASE WHEN file_id%5<>0 THEN file29 END AS tf, nii AS tv, music17 AS tm, CASE WHEN file_id%3<>0 THEN spectra END AS ov, CASE WHEN file_id%4<>0 THEN lofcz END AS om FROM evidence),
a AS (SELECT *, CASE WHEN tf IS NOT NULL THEN round({LB('f0', 'tf', 0.15)},10) ELSE f0 END AS f1 FROM s),
b AS (SELECT *, round(greatest(f1, vp*v0, mp*m0),10) AS f2, coalesce(round(ov,10),v0) AS v1, coalesce(round(om,10),m0) AS m1 FROM a)
SELECT file_id, round(f2,10) AS file, round(CASE WHEN tf IS NOT NULL THEN {LB('v1', 'tv', 0.1)} ELSE v1 END,10) AS voice,
 round(CASE WHEN tf IS NOT NULL THEN {LB('m1', 'tm', 0.35)} ELSE m1 END,10) AS music, round(vp,10) AS vp, round(mp,10) AS mp FROM b""")
def publish_outputs(spark, sf):
    c, k = F.col, F.col("file_id")
    d = evidence(spark, sf).select(
        "file_id", c("current_file").alias("file"), c("voice38").alias("voice"), c("current_music").alias("music"),
        (k * 59 % 113 / 113.0).alias("vp"), (k * 67 % 131 / 131.0).alias("mp"),
        F.when(k % 5 != 0, c("file29")).alias("tuned_file"), c("nii").alias("tuned_voice"), c("music17").alias("tuned_music"),
        F.when(k % 3 != 0, c("spectra")).alias("out_voice"), F.when(k % 4 != 0, c("lofcz")).alias("out_music"),
    )
    return B.rounded(S.publish(d).select("file_id", "file", "voice", "music", "vp", "mp"), 10)


@query("neutral_fallback", f"""WITH {B.SCORE13} SELECT file_id, CASE WHEN file_id%37=0 THEN 0.5e0 ELSE round(current_file,8) END AS file, CASE WHEN file_id%37=0 THEN 0.5e0 ELSE round(voice_present,8) END AS vp FROM score13""")
def neutral_fallback(spark, sf):
    d = B.score13(spark, sf).select("file_id", F.col("current_file").alias("file"), F.col("voice_present").alias("vp"), (F.col("file_id") % 37 == 0).alias("failed"))
    return B.rounded(S.neutral_fallback(d, "failed", ["file", "vp"]).select("file_id", "file", "vp"))


# --- window heads --------------------------------------------------------------------

def window_scores(spark, sf):
    """Kept voice windows with four detector scores each and the presence weight."""
    w = I.gate_windows(I.overlap_presence(G.voice_windows(spark, sf), G.voice_presence(spark, sf)))
    k, i = F.col("file_id"), F.col("win_idx")
    part = lambda a, b, m: ((k * a + i * b) % m) / F.lit(float(m - 1))
    return w.select("file_id", "win_idx", "presence", part(3, 11, 101).alias("w_df"), part(5, 13, 103).alias("w_spectra"),
                    part(7, 17, 107).alias("w_nii"), part(9, 19, 109).alias("w_eliya"))


_WSCORES = f"""{G._VOICE}, wg AS (SELECT file_id, max(presence) AS top FROM wpres GROUP BY 1 HAVING max(presence) >= 0.2 AND bool_and(presence IS NOT NULL)),
wscores AS (SELECT w.file_id, win_idx, presence, (file_id*3+win_idx*11)%101/100e0 AS w_df, (file_id*5+win_idx*13)%103/102e0 AS w_spectra,
  (file_id*7+win_idx*17)%107/106e0 AS w_nii, (file_id*9+win_idx*19)%109/108e0 AS w_eliya FROM wpres w JOIN wg USING (file_id) WHERE presence >= 0.8e0*top)"""
_RL = lambda x: f"ln({B.sql_clip(x)}/(1e0-{B.sql_clip(x)}))"
_HEAD = "(-0.2735022303019513e0" + "".join(f"+{c!r}*{_RL(x)}" for c, x in zip(A.WINDOW_HEAD_COEF, ("w_df", "w_spectra", "w_nii", "w_eliya"))) + ")"


@query("incumbent_rebuild", f"""WITH {_WSCORES}, wz2 AS (SELECT file_id, sum(presence*{_HEAD})/sum(presence) AS z FROM wscores GROUP BY 1),
{EVIDENCE},
r AS (SELECT e.*, z FROM evidence e LEFT JOIN wz2 USING (file_id))
SELECT file_id, round(greatest(current_file, voice_present*voice38, music_present*music17),10) AS file,
 CASE WHEN z IS NULL THEN round(voice38,10) ELSE round({LB('voice38', '(' + SG('z') + ')', 0.5)},7) END AS voice,
 CASE WHEN file_id%4=0 THEN round(music17,10) ELSE round({LB('music17', 'lofcz', 0.5)},10) END AS music FROM r""")
def incumbent_rebuild(spark, sf):
    """Published outputs rebuilt from stored windows: head, weighted mean, half blend, floor."""
    w = window_scores(spark, sf)
    head = A.window_head_logit(*[F.col(c) for c in ("w_df", "w_spectra", "w_nii", "w_eliya")])
    z = w.groupBy("file_id").agg((F.sum(F.col("presence") * head) / F.sum("presence")).alias("z"))
    d = evidence(spark, sf).join(z, "file_id", "left")
    c = F.col
    r10 = lambda x: F.round(x, A.ROUND_PLACES)
    voice = F.when(c("z").isNull(), c("voice38")).otherwise(F.round(A.logit_blend(c("voice38"), A.sigmoid(c("z")), A.SEGMENT_BLEND_WEIGHT), 7))
    music = F.when(c("file_id") % 4 == 0, c("music17")).otherwise(r10(A.logit_blend(c("music17"), c("lofcz"), A.SEGMENT_BLEND_WEIGHT)))
    file = r10(F.greatest(c("current_file"), c("voice_present") * c("voice38"), c("music_present") * c("music17")))
    return B.rounded(d.select("file_id", file.alias("file"), voice.alias("voice"), music.alias("music")), 10)


_WIN_FILE = f"""{_WSCORES}, {EVIDENCE}, wf AS (SELECT e.* REPLACE (w_df AS df_voice_mean, w_spectra AS spectra, w_nii AS nii, w_eliya AS eliya_fake, [w_spectra] AS spectra_scores,
   {LB('(0.375e0*w_df+0.625e0*w_spectra)', 'w_nii', 0.2)} AS current_voice, greatest(voice_present*w_df, music_present*file_music) AS current_file,
   0.75e0*{LB('(0.375e0*w_df+0.625e0*w_spectra)', 'w_nii', 0.2)}+0.25e0*w_eliya AS voice38), presence
  FROM evidence e JOIN wscores w USING (file_id))"""


@query("window_file_scores", f"""WITH {_WIN_FILE}, s AS (SELECT file_id, presence, {_stage('support29', 31)} AS sc FROM wf)
SELECT file_id, round({SG(f"sum(presence*{L('sc')})/sum(presence)")},6) AS score FROM s GROUP BY 1""")
def window_file_scores(spark, sf):
    """FILE per window with five fields replaced, then the presence-weighted logit mean."""
    d = evidence(spark, sf).join(window_scores(spark, sf), "file_id")
    c = F.col
    prior = A.logit_blend(A.linear_blend(c("w_df"), c("w_spectra"), A.VOICE_SPECTRA_WEIGHT), c("w_nii"), A.VOICE_NII_WEIGHT)
    d = (
        d.withColumn("current_voice", prior)
        .withColumn("voice38", A.linear_blend(c("current_voice"), c("w_eliya"), A.VOICE_ELIYA_WEIGHT))
        .withColumn("df_voice_mean", c("w_df")).withColumn("spectra", c("w_spectra")).withColumn("nii", c("w_nii"))
        .withColumn("eliya_fake", c("w_eliya")).withColumn("spectra_scores", F.array("w_spectra"))
        .withColumn("current_file", A.component_max(c("w_df"), c("file_music"), c("voice_present"), c("music_present")))
    )
    d = S.tree_score(d, "support29", MD.tree_model(29, 31), "sc")
    out = d.groupBy("file_id").agg(A.sigmoid(F.sum(c("presence") * A.logit(c("sc"))) / F.sum("presence")).alias("score"))
    return B.rounded(out, 6)


@query("tuned_window_heads", f"""WITH {G._VOICE}, h AS (SELECT file_id, z, ((file_id*13+win_idx*7)%61-30)/10e0 AS zp FROM wz),
p AS (SELECT file_id, 4e0*ln(avg(exp((z-zm)/4e0)))+max(zm) AS pf, 1000e0*ln(sum(w*exp((z-zm)/1000e0))/sum(w))+max(zm) AS pm
  FROM (SELECT *, max(z) OVER (PARTITION BY file_id) AS zm, pow(1e0/(1e0+exp(-zp)),2)+1e-6 AS w FROM h) GROUP BY 1)
SELECT file_id, round({SG('0.42680907029203735e0*pf-0.6304034896286665e0')},7) AS file, round({SG('0.5648970026469469e0*pf-1.2910782155102363e0')},7) AS voice,
 round({SG('0.3936595595390725e0*pm-0.13954637928984984e0')},6) AS music FROM p""")
def tuned_window_heads(spark, sf):
    """Window logits to the three tuned probabilities with the published pooling."""
    from ..operators.pooling import presence_weight, smooth_max_pools

    w = G.voice_windows(spark, sf).withColumn("zp", ((F.col("file_id") * 13 + F.col("win_idx") * 7) % 61 - 30) / 10.0)
    heads = list(A.TUNED_POOLING.items())
    taus = sorted({t for _, (t, *_) in heads})
    wide = smooth_max_pools(w, ["file_id"], [(F.col("z"), presence_weight(F.col("zp"), g) if g else None) for _, (_, g, *_) in heads], taus)
    return wide.select("file_id", *[
        F.round(A.sigmoid(F.lit(a) * F.col(f"x_{i}_{taus.index(t)}") + F.lit(b)), 6 if h == "music" else 7).alias(h) for i, (h, (t, g, a, b)) in enumerate(heads)])


# --- model tables ------------------------------------------------------------------------

def _part_trees(spark, sf):
    """Node tables of many trees derived from part, some of them broken."""
    k = F.col("p_partkey")
    n = k % 7
    t = F.floor(k / 7)
    heap = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (n + 1).cast("int"))
    leaf = n.isin(2, 3, 5, 6)
    left = F.when((t % 11 == 0) & (n == 1), 9).when((t % 13 == 0) & (n == 4), 3).otherwise(heap((1, 2, -1, -1, 5, -1, -1)))
    return B.table(spark, sf, "part").select(
        t.alias("tree"), n.cast("int").alias("node"), left.cast("int").alias("child_left"), heap((4, 3, -1, -1, 6, -1, -1)).alias("child_right"),
        F.when(leaf, -2).when((t % 17 == 0) & (n == 0), 40).otherwise((k % 29).cast("int")).cast("int").alias("feature"),
        F.when(leaf & ~((t % 19 == 0) & (n == 6)), -2.0).otherwise(F.col("p_retailprice")).alias("threshold"), (F.col("p_size") / 50.0).alias("value"),
    )


@query("tree_table_integrity", """WITH n AS (SELECT p_partkey//7 AS tree, p_partkey%7 AS node,
  CASE WHEN (p_partkey//7)%11=0 AND p_partkey%7=1 THEN 9 WHEN (p_partkey//7)%13=0 AND p_partkey%7=4 THEN 3 ELSE [1,2,-1,-1,5,-1,-1][p_partkey%7+1] END AS cl,
  [4,3,-1,-1,6,-1,-1][p_partkey%7+1] AS cr, p_partkey%7 IN (2,3,5,6) AS leaf FROM part),
e AS (SELECT tree, node AS parent, unnest([cl,cr]) AS node FROM n WHERE NOT leaf),
p AS (SELECT tree, node, count(*) AS c, max(parent) AS parent FROM e GROUP BY 1,2),
d AS (SELECT n.tree, n.node, CASE WHEN n.node=0 THEN 0 WHEN p1.c=1 AND p1.parent=0 THEN 0 WHEN p1.c=1 AND p2.c=1 AND p2.parent=0 THEN 0 ELSE 1 END AS lost
  FROM n LEFT JOIN p p1 ON p1.tree=n.tree AND p1.node=n.node LEFT JOIN p p2 ON p2.tree=n.tree AND p2.node=p1.parent)
SELECT tree, node::INT AS node, 'missing child' AS rule FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree=p.tree AND n.node=p.node)
UNION ALL SELECT n.tree, n.node, 'not exactly one parent' FROM n LEFT JOIN p USING (tree,node) WHERE n.node>0 AND coalesce(p.c,0)<>1
UNION ALL SELECT tree, node, 'child before parent' FROM n WHERE NOT leaf AND (cl<=node OR cr<=node)
UNION ALL SELECT tree, node, 'feature out of range' FROM n WHERE tree%17=0 AND node=0
UNION ALL SELECT tree, node, 'leaf sentinels' FROM n WHERE tree%19=0 AND node=6
UNION ALL SELECT tree, node, 'unreachable or too deep' FROM d WHERE lost=1""")
def tree_table_integrity(spark, sf):
    return S.tree_violations(_part_trees(spark, sf), ["tree"], 29)


@query("fit_receipt", """WITH g AS (SELECT o_custkey::VARCHAR AS g, count(*) AS n, sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN o_orderpriority='5-LOW' THEN 1 ELSE 0 END) AS old FROM orders GROUP BY 1)
SELECT sum(n)::BIGINT AS training_rows, count(*)::BIGINT AS training_groups, (sum(n)-sum(pos))::BIGINT AS class_0, sum(pos)::BIGINT AS class_1,
 sum(old)::BIGINT AS old_rows, (sum(n)-sum(old))::BIGINT AS extra_rows,
 (SELECT sha256(string_agg(h, '' ORDER BY p)) FROM (SELECT left(p,3) AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM (
   SELECT left(sha256(g),6) AS p, sha256(string_agg(sha256(g), '' ORDER BY sha256(g))) AS h FROM g GROUP BY 1) GROUP BY 1)) AS groups_digest FROM g""")
def fit_receipt(spark, sf):
    d = B.items(spark, sf).withColumn("role", F.when(F.col("family") == "5-LOW", "old").otherwise("extra"))
    return S.fit_receipt(d, "grp", "file_fake", "role")


@query("fit_receipt_violations", """WITH a AS (SELECT count(*) AS r, count(DISTINCT o_custkey) AS g FROM orders)
SELECT 'training_rows' AS field, r::VARCHAR AS actual, (r+1)::VARCHAR AS receipt FROM a""")
def fit_receipt_violations(spark, sf):
    actual = S.fit_receipt(B.items(spark, sf), "grp", "file_fake")
    return S.receipt_violations(actual, actual.select((F.col("training_rows") + 1).alias("training_rows"), "training_groups", "groups_digest"))
