"""Windows, interval joins, window targets and pooling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import waveforms as V
from ..functions import windows as N
from ..operators import intervals as I
from ..operators import pooling as P
from . import bindings as B
from .registry import query

# --- bindings used only here ---------------------------------------------------------


def lengths(spark, sf):
    """Sample count per file, from very short to beyond the window cap."""
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), (F.floor(F.col("o_totalprice") * 14) + 1).cast("long").alias("n")
    )


LENGTHS = "lengths AS (SELECT o_orderkey AS file_id, floor(o_totalprice*14)::BIGINT + 1 AS n FROM orders)"


def voice_presence(spark, sf):
    s = B.segments(spark, sf).filter(F.col("stream") == "voice")
    start = (F.col("seg_idx") * N.SEGMENT_SAMPLES).cast("long")
    return s.select("file_id", start.alias("start"), (start + N.SEGMENT_SAMPLES).alias("end"), "score")


def voice_windows(spark, sf):
    """Sliding windows over each file's voice stream, with a logit per window."""
    n = (
        B.table(spark, sf, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .groupBy(F.col("l_orderkey").alias("file_id"))
        .agg((F.count(F.lit(1)) * N.SEGMENT_SAMPLES).alias("n"))
    )
    w = n.select("file_id", F.posexplode(N.sliding_starts(F.col("n"))).alias("win_idx", "start"))
    return w.select(
        "file_id", "win_idx", "start", (F.col("start") + N.WINDOW_SAMPLES).alias("end"),
        (((F.col("file_id") * 31 + F.col("win_idx") * 17) % 101 - 50) / 10.0).alias("z"),
    )


_VOICE = f"""{B.SEGMENTS}, presence AS (
  SELECT file_id, seg_idx*64600 AS a, seg_idx*64600+64600 AS b, score FROM segments WHERE stream='voice'),
vlen AS (SELECT file_id, count(*)*64600 AS n FROM segments WHERE stream='voice' GROUP BY 1),
wstarts AS (SELECT file_id, n, unnest(CASE WHEN n <= 64000 THEN [0::BIGINT]
   WHEN (n-64000)%32000=0 THEN range(0, n-64000+1, 32000) ELSE list_append(range(0, n-64000+1, 32000), n-64000) END) AS start FROM vlen),
win AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start)-1 AS win_idx, start, start+64000 AS stop FROM wstarts),
wz AS (SELECT *, ((file_id*31+win_idx*17)%101-50)/10e0 AS z FROM win),
wpres AS (SELECT w.file_id, w.win_idx, w.start, w.z,
   sum((least(w.stop,p.b)-greatest(w.start,p.a))*p.score)/sum(least(w.stop,p.b)-greatest(w.start,p.a)) AS presence
  FROM wz w LEFT JOIN presence p ON p.file_id=w.file_id AND p.a < w.stop AND w.start < p.b GROUP BY ALL)"""


# --- interval generators -------------------------------------------------------------------

_STARTS_SQL = """CASE WHEN n <= {w} THEN [0::BIGINT] WHEN (n-{w})%{h}=0 THEN range(0, n-{w}+1, {h})
   ELSE list_append(range(0, n-{w}+1, {h}), n-{w}) END"""


@query("tumbling_starts", f"""WITH {LENGTHS}, s AS (SELECT file_id, unnest({_STARTS_SQL.format(w=64600, h=64600)}) AS start FROM lengths)
SELECT file_id, count(*)::BIGINT AS windows, sum(start)::BIGINT AS start_sum, max(start)::BIGINT AS last_start FROM s GROUP BY 1""")
def tumbling_starts(spark, sf):
    s = lengths(spark, sf).select("file_id", F.explode(N.tumbling_starts(F.col("n"))).alias("start"))
    return _per_file(s)


def _per_file(starts):
    return starts.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("start").alias("start_sum"), F.max("start").alias("last_start")
    )


@query("sliding_starts_capped", f"""WITH {LENGTHS}, s AS (SELECT file_id, unnest({_STARTS_SQL.format(w=64000, h=32000)}) AS start FROM lengths),
r AS (SELECT file_id, start, row_number() OVER (PARTITION BY file_id ORDER BY start)-1 AS i, count(*) OVER (PARTITION BY file_id) AS c FROM s),
k AS (SELECT DISTINCT file_id, round_even(g*((c-1)/149e0), 0)::BIGINT AS i FROM (SELECT DISTINCT file_id, c FROM r WHERE c > 150), range(150) t(g))
SELECT r.file_id, count(*)::BIGINT AS windows, sum(start)::BIGINT AS start_sum, max(start)::BIGINT AS last_start
FROM r LEFT JOIN k ON k.file_id=r.file_id AND k.i=r.i WHERE c <= 150 OR k.i IS NOT NULL GROUP BY 1""")
def sliding_starts_capped(spark, sf):
    return _per_file(lengths(spark, sf).select(
        "file_id", F.explode(N.capped_sliding_starts(F.col("n"))).alias("start")
    ))


@query("sparse_starts", f"""WITH {LENGTHS}, s AS (
 SELECT file_id, 'three' AS rule, unnest([0, greatest(n-64600,0)//2, greatest(n-64600,0)]) AS start FROM lengths
 UNION ALL SELECT file_id, 'five', unnest(list_transform([0,1,2,3,4], lambda i: i*greatest(n-34398,0)//4)) FROM lengths)
SELECT DISTINCT file_id, rule, start FROM s""")
def sparse_starts(spark, sf):
    n = F.col("n")
    d = lengths(spark, sf)
    rules = F.create_map(F.lit("three"), N.first_middle_last(n), F.lit("five"), N.five_point_starts(n))
    return d.select("file_id", F.explode(rules).alias("rule", "starts")).select(
        "file_id", "rule", F.explode("starts").alias("start")
    )


# --- waveform arrays (embeddings stand in for samples) ----------------------------------------

def _waves(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))


def _long(df, **arrays):
    arr = F.map_from_arrays(F.array(*[F.lit(k) for k in arrays]), F.array(*arrays.values()))
    return B.rounded(
        df.select("vec_id", F.explode(arr).alias("form", "a")).select(
            "vec_id", "form", F.posexplode("a").alias("pos", "value")
        ).withColumn("value", F.col("value").cast("double")), 7)


def _sql_long(forms: dict[str, str], pre: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT vec_id, '{k}' AS form, ({v})::DOUBLE[] AS a FROM w" for k, v in forms.items())
    return f"""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS mu{pre} FROM embeddings), f AS ({parts})
SELECT vec_id, form, (generate_subscripts(a,1)-1)::INT AS pos, round(unnest(a),7)+0e0 AS value FROM f"""


@query("waveform_crops", _sql_long({
    "pad100": "list_concat(x, list_transform(range(36), lambda i: 0e0))",
    "three_quarters20": "x[floor((64-20)/4.0*3.0)::INT+1 : floor((64-20)/4.0*3.0)::INT+20]",
    "middle20": "x[(64//20)//2*20+1 : (64//20)//2*20+20]",
    "head24": "x[1:24]", "center24": "x[(64-24)//2+1:(64-24)//2+24]", "tail24": "x[64-23:64]",
    "tile150": "list_concat(list_concat(x,x),x)[1:150]",
}))
def waveform_crops(spark, sf):
    x = F.col("x")
    d = lambda c: c.cast("array<double>")
    return _long(
        _waves(spark, sf),
        pad100=d(V.pad_or_crop(x, 100)), three_quarters20=d(V.pad_or_crop(x, 20)),
        middle20=d(V.pad_or_crop(x, 20, "demo_middle")), head24=d(V.crop(x, 24)),
        center24=d(V.crop(x, 24, "center")), tail24=d(V.crop(x, 24, "tail")), tile150=d(V.tile_to(x, 150)),
    )


_var = "list_avg(list_transform(x, lambda v: (v-mu)*(v-mu)))"


@query("waveform_normalise", f"""WITH w0 AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS mu FROM embeddings),
w AS (SELECT *, {_var} AS va, list_min(x) AS lo, list_max(x) AS hi FROM w0),
f AS (SELECT vec_id, 'unit' AS form, list_transform(x, lambda v: (v-mu)/sqrt(va+1e-5)) AS a FROM w
 UNION ALL SELECT vec_id, 'std', list_transform(x, lambda v: v/greatest(sqrt(va),1e-6)) FROM w
 UNION ALL SELECT vec_id, 'minmax', list_transform(x, lambda v: (v-lo)/greatest(hi-lo,1e-6)) FROM w
 UNION ALL SELECT vec_id, 'peak', list_transform(x, lambda v: v/greatest(abs(lo),abs(hi))) FROM w)
SELECT vec_id, form, (generate_subscripts(a,1)-1)::INT AS pos, round(unnest(a),7)+0e0 AS value FROM f""")
def waveform_normalise(spark, sf):
    x = F.col("x")
    w = _waves(spark, sf).withColumn("mu", V.mean(x)).withColumn("va", V.variance(x, F.col("mu")))
    return _long(
        w, unit=V.unit_variance(x, F.col("mu"), F.col("va")), std=V.std_scaled(x, F.col("va")),
        minmax=V.minmax_scaled(x), peak=V.peak_scaled(x),
    )


@query("waveform_mixing", """WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_reverse(embedding::DOUBLE[]) AS y,
  list_avg(list_transform(embedding::DOUBLE[], lambda v: v*v)) AS ms FROM embeddings),
m AS (SELECT *, list_transform(list_zip(x,y), lambda p: p[1] + p[2]*(sqrt(ms+1e-12)/(sqrt(ms+1e-12)*pow(10e0,0.5e0)))) AS mix,
  list_transform(list_zip(x,y), lambda p: (p[1]+p[2])/2e0) AS mono FROM w),
f AS (SELECT vec_id, 'mix10db' AS form, mix AS a FROM m
 UNION ALL SELECT vec_id, 'gain12db', list_transform(x, lambda v: greatest(least(v*pow(10e0,12/20e0),1e0),-1e0)) FROM m
 UNION ALL SELECT vec_id, 'level', list_transform(x, lambda v: v*(0.07e0/sqrt(ms+1e-9))) FROM m
 UNION ALL SELECT vec_id, 'limited', list_transform(x, lambda v: CASE WHEN greatest(abs(list_min(x)),abs(list_max(x)))*6 > 0.98
     THEN v*6*(0.98e0/(greatest(abs(list_min(x)),abs(list_max(x)))*6)) ELSE v*6 END) FROM m
 UNION ALL SELECT vec_id, 'mono', mono FROM m
 UNION ALL SELECT vec_id, 'preemphasis', list_transform(x, lambda v, i: CASE WHEN i=1 THEN v ELSE v-0.97e0*x[i-1] END) FROM m)
SELECT vec_id, form, (generate_subscripts(a,1)-1)::INT AS pos, round(unnest(a),7)+0e0 AS value FROM f""")
def waveform_mixing(spark, sf):
    w = _waves(spark, sf).withColumn("x", F.col("x").cast("array<double>")).withColumn("y", F.reverse("x"))
    w = w.withColumn("loud", F.transform("x", lambda v: v * 6))
    x = F.col("x")
    return _long(
        w, mix10db=V.mix_at_snr(x, F.col("y"), 10.0), gain12db=V.apply_gain(x, 12.0), level=V.level_to(x),
        limited=V.limit_peak(F.col("loud")), mono=V.channel_mean(F.array("x", "y")), preemphasis=V.preemphasis(x),
    )


# --- pooling --------------------------------------------------------------------------------

@query("pooling_variants", f"""WITH {B.SEGMENTS}, r AS (
 SELECT *, row_number() OVER (PARTITION BY file_id, stream ORDER BY score DESC) AS k FROM segments)
SELECT file_id, stream, round(max(score),8) AS p_max, round(avg(score),8) AS p_mean,
 round(avg(CASE WHEN k<=2 THEN score END),8) AS p_top2, round(avg(CASE WHEN k<=3 THEN score END),8) AS p_top3,
 round(0.25*avg(score)+0.75*max(score),8) AS p_mix0_25, round(0.5*avg(score)+0.5*max(score),8) AS p_mix0_5,
 round(0.75*avg(score)+0.25*max(score),8) AS p_mix0_75 FROM r GROUP BY 1,2""")
def pooling_variants(spark, sf):
    d = B.segment_scores(spark, sf)
    return B.rounded(P.pool(d, ["file_id", "stream"], rows=d.count()))


@query("pooling_empty_streams", f"""WITH {B.SEGMENTS}, {B.ITEMS}, p AS (
 SELECT file_id, max(CASE WHEN stream='voice' THEN score END) AS v, max(CASE WHEN stream='music' THEN score END) AS m FROM segments GROUP BY 1)
SELECT file_id, coalesce(v,0e0) AS voice, coalesce(m,0e0) AS music,
 round(greatest(voice_present*coalesce(v,0e0), music_present*coalesce(m,0e0)),8) AS file_score FROM items LEFT JOIN p USING (file_id)""")
def pooling_empty_streams(spark, sf):
    """Silent streams pool to 0.0; the file score is the larger gated component."""
    s = B.segment_scores(spark, sf)
    p = s.groupBy("file_id").agg(
        F.max(F.when(F.col("stream") == "voice", F.col("score"))).alias("v"),
        F.max(F.when(F.col("stream") == "music", F.col("score"))).alias("m"),
    )
    d = B.items(spark, sf).join(p, "file_id", "left").select(
        "file_id", "voice_present", "music_present",
        F.coalesce("v", F.lit(0.0)).alias("voice"), F.coalesce("m", F.lit(0.0)).alias("music"),
    )
    return B.rounded(d.select("file_id", "voice", "music", A.component_max(
        F.col("voice"), F.col("music"), F.col("voice_present"), F.col("music_present")).alias("file_score")))


# Three heads over the same windows: a logit each, and the logit of the stream's presence (FILE has none).
_HEAD_LOGITS = {"file": ("(file_id*31+win_idx*17)%101-50", None), "voice": ("(file_id*29+win_idx*23)%97-48", "(file_id*13+win_idx*7)%61-30"),
                "music": ("(file_id*37+win_idx*19)%89-44", "(file_id*11+win_idx*5)%53-26")}
_HEADS_SQL = "hz AS (SELECT file_id, win_idx, " + ", ".join(
    f"({z})/10e0 AS z_{h}" + (f", ({p})/10e0 AS p_{h}" if p else "") for h, (z, p) in _HEAD_LOGITS.items()) + " FROM win)"


def head_windows(spark, sf):
    cols = [F.expr(f"({e})/10D").alias(f"{n}_{h}") for h, pair in _HEAD_LOGITS.items() for n, e in zip("zp", pair) if e]
    return voice_windows(spark, sf).select("file_id", "win_idx", *cols)


def head_gammas(head):
    from ..operators import grid as GR

    return GR.GAMMAS if _HEAD_LOGITS[head][1] else (0.0,)


def head_cells():
    return [(h, g) for h in _HEAD_LOGITS for g in head_gammas(h)]


def pooled_heads(spark, sf, cells=None, labels=None):
    """(file_id, head, tau, gamma, pooled) of every head, temperature and presence weight, or of some cells (head, presence
    weight), in one pass over the windows. labels (file_id, a column a head) adds the head's label, of the heads that have one."""
    from ..operators import grid as GR

    cells = head_cells() if cells is None else cells
    pools = [(F.col(f"z_{h}"), P.presence_weight(F.col(f"p_{h}"), g) if g else None) for h, g in cells]
    wide = P.smooth_max_pools(head_windows(spark, sf), ["file_id"], pools, GR.TAUS)
    # labels join before a file's cells become rows
    wide = wide if labels is None else wide.join(labels, "file_id")
    long = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(t).alias("tau"), F.lit(g).alias("gamma"), F.col(f"x_{i}_{k}").alias("pooled"),
                              *([] if labels is None else [F.col(h).alias("label")])) for i, (h, g) in enumerate(cells) for k, t in enumerate(GR.TAUS)])
    long = wide.select("file_id", F.explode(long).alias("c")).select("file_id", "c.*")
    return long if labels is None else long.where("label IS NOT NULL")


def _lse_sql(head, tau, gamma):
    w = f"(pow(1e0/(1e0+exp(-p_{head})), {gamma}e0)+1e-6)" if gamma else "1e0"
    return f"""SELECT file_id, '{head}' AS head, {tau}::DOUBLE AS tau, {gamma}::DOUBLE AS gamma,
  round({tau}::DOUBLE*ln(sum(w*exp((z-zm)/{tau}::DOUBLE))/greatest(sum(w),1e-12))+max(zm),7) AS pooled
  FROM (SELECT file_id, z_{head} AS z, max(z_{head}) OVER (PARTITION BY file_id) AS zm, {w} AS w FROM hz) GROUP BY 1"""


_LSE = [(h, t, g) for h, gs in (("file", (0,)), ("voice", (0, 1, 2)), ("music", (0, 1, 2))) for g in gs for t in (0.25, 0.5, 1.0, 2.0, 4.0, 1000.0)]


@query("smooth_max_pooling", f"WITH {_VOICE}, {_HEADS_SQL} " + " UNION ALL ".join(_lse_sql(*c) for c in _LSE))
def smooth_max_pooling(spark, sf):
    return B.rounded(pooled_heads(spark, sf), 7)


@query("presence_interval_join", f"""WITH {_VOICE}, g AS (SELECT file_id, max(presence) AS top FROM wpres GROUP BY 1 HAVING max(presence) >= 0.2 AND bool_and(presence IS NOT NULL)),
k AS (SELECT w.* FROM wpres w JOIN g USING (file_id) WHERE presence >= 0.8e0*top)
SELECT file_id, count(*)::BIGINT AS kept, round(sum(presence*z)/sum(presence),7)+0e0 AS z,
 round(1e0/(1e0+exp(-(sum(presence*z)/sum(presence)))),7) AS score FROM k GROUP BY 1""")
def presence_interval_join(spark, sf):
    w = I.gate_windows(I.overlap_presence(voice_windows(spark, sf), voice_presence(spark, sf)))
    p = w.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("kept"), (F.sum(F.col("presence") * F.col("z")) / F.sum("presence")).alias("z")
    )
    return B.rounded(p.withColumn("score", A.sigmoid(F.col("z"))), 7)


@query("window_presence", f"WITH {_VOICE} SELECT file_id, win_idx, round(presence, 8) AS presence FROM wpres")
def window_presence(spark, sf):
    w = I.overlap_presence(voice_windows(spark, sf), voice_presence(spark, sf))
    return B.rounded(w.select("file_id", F.col("win_idx").cast("long").alias("win_idx"), "presence"))


def components(spark, sf):
    start = ((F.col("l_linenumber") - 1) * 40000).cast("long")
    return B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        start.alias("start"),
        (start + (1 + F.col("l_quantity").cast("long") % 6) * 7000).alias("end"),
        F.when(F.col("l_linestatus") == "O", "speech").otherwise("music").alias("kind"),
        (F.col("l_tax") > 0.04).cast("int").alias("fake"),
    )


def view_items(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(
        k.alias("file_id"), (k % 5 == 0).alias("is_view"), (k % 2 == 0).alias("mask_music"),
        F.when(k % 7 == 0, "music_real").otherwise("mix").alias("kind_name"),
        F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("file_fake"),
    )


_TARGET = f"""comp AS (SELECT l_orderkey AS file_id, (l_linenumber-1)*40000 AS a, (l_linenumber-1)*40000+(1+l_quantity::BIGINT%6)*7000 AS b,
   CASE WHEN l_linestatus='O' THEN 'speech' ELSE 'music' END AS kind, (l_tax > 0.04)::INT AS fake FROM lineitem),
clen AS (SELECT file_id, max(b) AS n FROM comp GROUP BY 1),
cs AS (SELECT file_id, unnest({_STARTS_SQL.format(w=64000, h=32000)}) AS a FROM clen),
cw AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY a)-1 AS win_idx, a, a+64000 AS b FROM cs),
ov AS (SELECT w.file_id, w.win_idx,
   coalesce(sum(CASE WHEN kind='speech' THEN o END),0) AS ov_s, coalesce(sum(CASE WHEN kind='speech' AND fake=1 THEN o END),0) AS fk_s,
   coalesce(sum(CASE WHEN kind='music' THEN o END),0) AS ov_m, coalesce(sum(CASE WHEN kind='music' AND fake=1 THEN o END),0) AS fk_m
  FROM cw w LEFT JOIN (SELECT w2.file_id, w2.win_idx, c.kind, c.fake, least(w2.b,c.b)-greatest(w2.a,c.a) AS o FROM cw w2 JOIN comp c
     ON c.file_id=w2.file_id AND c.a<w2.b AND w2.a<c.b) c USING (file_id, win_idx) GROUP BY 1,2),
lab AS (SELECT ov.*, o_orderkey%5=0 AS is_view, o_orderkey%2=0 AS mm, o_orderkey%7=0 AS mr, o_orderstatus='P' AS unk,
   CASE WHEN ov_s=0 THEN NULL WHEN fk_s>=8000 THEN 1 WHEN fk_s=0 AND ov_s>=16000 THEN 0 END AS vf,
   CASE WHEN ov_m=0 THEN NULL WHEN fk_m>=8000 THEN 1 WHEN fk_m=0 AND ov_m>=16000 THEN 0 END AS mf
  FROM ov JOIN orders ON o_orderkey=file_id),
targets AS (SELECT file_id, win_idx,
   CASE WHEN vf=1 OR mf=1 THEN 1 WHEN is_view AND unk THEN NULL WHEN fk_s+fk_m=0 THEN 0 END AS t_file, vf AS t_voice,
   CASE WHEN is_view AND mm THEN NULL ELSE mf END AS t_music,
   CASE WHEN mr THEN NULL WHEN ov_s>=16000 THEN 1 WHEN ov_s=0 THEN 0 END AS t_vp,
   CASE WHEN is_view AND mm THEN NULL WHEN ov_m>=16000 THEN 1 WHEN ov_m=0 THEN 0 END AS t_mp FROM lab)"""


def _target_windows(spark, sf):
    comps = components(spark, sf)
    n = comps.groupBy("file_id").agg(F.max("end").alias("n"))
    w = n.select("file_id", F.posexplode(N.sliding_starts(F.col("n"))).alias("win_idx", "start"))
    w = w.withColumn("end", F.col("start") + N.WINDOW_SAMPLES)
    return I.window_targets(w, comps, view_items(spark, sf)).withColumn("win_idx", F.col("win_idx").cast("long"))


@query("window_targets", f"WITH {_TARGET} SELECT * FROM targets")
def window_targets(spark, sf):
    return _target_windows(spark, sf)


@query("masked_window_loss", f"""WITH {_TARGET}, z AS (SELECT *, ((file_id*7+win_idx*3)%41-20)/5e0 AS a, ((file_id*11+win_idx*5)%43-21)/5e0 AS b FROM targets),
l AS (SELECT sum(CASE WHEN t_file IS NOT NULL THEN greatest(a,0)-a*t_file+ln(1e0+exp(-abs(a))) ELSE 0 END)/greatest(count(t_file),1) AS la,
  sum(CASE WHEN t_voice IS NOT NULL THEN greatest(b,0)-b*t_voice+ln(1e0+exp(-abs(b))) ELSE 0 END)/greatest(count(t_voice),1) AS lb FROM z)
SELECT round(la,7) AS loss_z_file, round(lb,7) AS loss_z_voice, round(la*1e0+lb*0.5e0,7) AS loss FROM l""")
def masked_window_loss(spark, sf):
    from ..operators.metrics import masked_logit_loss

    t = _target_windows(spark, sf).select(
        (((F.col("file_id") * 7 + F.col("win_idx") * 3) % 41 - 20) / 5.0).alias("z_file"),
        (((F.col("file_id") * 11 + F.col("win_idx") * 5) % 43 - 21) / 5.0).alias("z_voice"),
        "t_file", "t_voice", F.col("t_file").isNotNull().alias("m_file"), F.col("t_voice").isNotNull().alias("m_voice"),
    )
    return B.rounded(masked_logit_loss(t, [("z_file", "t_file", "m_file", 1.0), ("z_voice", "t_voice", "m_voice", 0.5)]), 7)


KINDS = ("speech_real", "speech_fake", "music_real", "music_vocal_fake", "partial", "partial_real_music",
         "sim_rf", "seq_rf", "overlap_rf", "mystery")


def renders(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(
        k.alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 10 + 1).cast("int")).alias("kind"),
        F.when(k % 3 == 0, "speech_then_music").otherwise("music_then_speech").alias("order"),
        F.when(k % 4 < 2, "speech_first").otherwise("music_first").alias("overlap_order"),
        (64000 + k * 7919 % 400000).alias("n"),
        F.when((k % 10).isin(1, 3, 4, 5), 1).otherwise((k % 2).cast("int")).alias("voice_fake"),
        F.when((k % 10).isin(0, 1, 2, 3, 4, 5), 0).otherwise((k % 3 == 0).cast("int")).alias("music_fake"),
        (k % 40 / 20.0).alias("splice_start_s"), ((k % 30) / 15.0).alias("splice_seconds"),
    )


_RENDERS = """r AS (SELECT o_orderkey AS id, ['speech_real','speech_fake','music_real','music_vocal_fake','partial','partial_real_music','sim_rf','seq_rf','overlap_rf','mystery'][o_orderkey%10+1] AS kind,
  o_orderkey%3=0 AS stm, o_orderkey%4<2 AS sf, 64000+o_orderkey*7919%400000 AS n,
  CASE WHEN o_orderkey%10 IN (1,3,4,5) THEN 1 ELSE o_orderkey%2 END AS vf, CASE WHEN o_orderkey%10 IN (0,1,2,3,4,5) THEN 0 WHEN o_orderkey%3=0 THEN 1 ELSE 0 END AS mf,
  round_even(o_orderkey%40/20e0*16000,0)::BIGINT AS a, round_even(o_orderkey%40/20e0*16000,0)::BIGINT+round_even(o_orderkey%30/15e0*16000,0)::BIGINT AS b FROM orders),
c AS (SELECT id, 0 AS s, n AS e, 'speech' AS kind, vf AS f FROM r WHERE kind IN ('speech_real','speech_fake','sim_rf')
 UNION ALL SELECT id, 0, n, 'speech', 1 FROM r WHERE kind='music_vocal_fake'
 UNION ALL SELECT id, 0, n, 'music', mf FROM r WHERE kind IN ('music_real','music_vocal_fake','sim_rf')
 UNION ALL SELECT id, 0, n, 'music', 0 FROM r WHERE kind='partial_real_music'
 UNION ALL SELECT id, 0, a, 'speech', 0 FROM r WHERE kind LIKE 'partial%'
 UNION ALL SELECT id, a, b, 'speech', 1 FROM r WHERE kind LIKE 'partial%'
 UNION ALL SELECT id, b, n, 'speech', 0 FROM r WHERE kind LIKE 'partial%'
 UNION ALL SELECT id, CASE WHEN stm THEN 0 ELSE n//2 END, CASE WHEN stm THEN n//2 ELSE n END, 'speech', vf FROM r WHERE kind='seq_rf'
 UNION ALL SELECT id, CASE WHEN stm THEN n//2 ELSE 0 END, CASE WHEN stm THEN n ELSE n//2 END, 'music', mf FROM r WHERE kind='seq_rf'
 UNION ALL SELECT id, CASE WHEN sf THEN 0 ELSE n//3 END, CASE WHEN sf THEN n//3*2 ELSE n END, 'speech', vf FROM r WHERE kind='overlap_rf'
 UNION ALL SELECT id, CASE WHEN sf THEN n//3 ELSE 0 END, CASE WHEN sf THEN n ELSE n//3*2 END, 'music', mf FROM r WHERE kind='overlap_rf')"""


@query("render_components", f"WITH {_RENDERS} SELECT id, s::BIGINT AS start, e::BIGINT AS \"end\", kind, f::INT AS fake FROM c WHERE e > s")
def render_components(spark, sf):
    return I.component_layout(renders(spark, sf))[0]


@query("render_layout_violations", f"""WITH {_RENDERS}, k AS (SELECT r.id, r.kind, vf, mf, coalesce(max(CASE WHEN c.kind='speech' THEN f END),0) AS cv,
   coalesce(max(CASE WHEN c.kind='music' THEN f END),0) AS cm, count(c.id) AS nc FROM r LEFT JOIN c ON c.id=r.id AND c.e > c.s GROUP BY ALL)
SELECT id, 'unknown kind' AS rule FROM k WHERE kind='mystery'
UNION ALL SELECT id, 'voice label differs from layout' FROM k WHERE kind NOT IN ('mystery','music_vocal_fake') AND cv<>vf
UNION ALL SELECT id, 'music label differs from layout' FROM k WHERE kind<>'mystery' AND cm<>mf""")
def render_layout_violations(spark, sf):
    return I.component_layout(renders(spark, sf))[1]


@query("bag_features", """WITH b AS (SELECT label, embedding::DOUBLE[] AS x, (vec_id%7+1)/7e0 AS w FROM embeddings),
l AS (SELECT label, w, (generate_subscripts(x,1)-1)::INT AS bin, unnest(x) AS v FROM b)
SELECT label, bin, round(sum(w*v)/sum(w),7)+0e0 AS value FROM l GROUP BY 1,2""")
def bag_features(spark, sf):
    e = B.table(spark, sf, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("x"), ((F.col("vec_id") % 7 + 1) / 7.0).alias("w")
    )
    return B.rounded(P.bag_features(e, ["label"], "x", "w"), 7)


@query("presence_classes", """WITH p AS (SELECT label, vec_id, abs(embedding[1]::DOUBLE) AS a, abs(embedding[6]::DOUBLE) AS b, abs(embedding[11]::DOUBLE) AS c, abs(embedding[4]::DOUBLE) AS d FROM embeddings)
SELECT label, round(max(greatest(a,b)),8) AS voice_present, round(max(greatest(c,d)),8) AS music_present FROM p GROUP BY 1""")
def presence_classes(spark, sf):
    probs = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    e = B.table(spark, sf, "embeddings").select("label", probs.alias("p"))
    return B.rounded(e.groupBy("label").agg(
        F.max(P.presence_from_classes(F.col("p"), (0, 5))).alias("voice_present"),
        F.max(P.presence_from_classes(F.col("p"), (10, 3))).alias("music_present"),
    ))


@query("crop_means", f"""WITH {B.SCORE13}, c AS (SELECT file_id, list_transform(spectra_scores, lambda v: CASE WHEN v > 0.95 THEN NULL ELSE v END) AS s FROM score13)
SELECT file_id, CASE WHEN list_count(s)=len(s) THEN round(list_avg(s),8) END AS all_valid,
 CASE WHEN list_count(s)=len(s) THEN round(list_avg(list_sort(s)),8) END AS sorted_valid, round(list_avg(s),8) AS finite_only FROM c""")
def crop_means(spark, sf):
    s = F.transform("spectra_scores", lambda v: F.when(v <= 0.95, v))
    d = B.score13(spark, sf).select("file_id", s.alias("s"))
    return B.rounded(d.select(
        "file_id", P.crop_mean(F.col("s")).alias("all_valid"), P.crop_mean(F.col("s"), "sorted").alias("sorted_valid"),
        P.crop_mean(F.col("s"), "finite").alias("finite_only"),
    ))


@query("silent_streams", f"""WITH {B.SEGMENTS}, s AS (SELECT file_id, stream, max(score) AS m, avg(score) AS a, sqrt(avg(score*score))*(file_id%3)/100 AS rms FROM segments GROUP BY 1,2)
SELECT file_id, stream, rms < 1e-5 AS silent, CASE WHEN rms < 1e-5 THEN 0e0 ELSE round(m,8) END AS pooled_max,
 CASE WHEN rms < 1e-5 THEN 0e0 ELSE round(a,8) END AS pooled_mean FROM s""")
def silent_streams(spark, sf):
    s = B.segment_scores(spark, sf).groupBy("file_id", "stream").agg(
        F.max("score").alias("m"), F.avg("score").alias("a"), F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("r")
    )
    silent = F.col("r") * (F.col("file_id") % 3) / 100 < A.SILENCE_RMS
    heard = lambda c: F.when(silent, 0.0).otherwise(F.col(c))
    return B.rounded(s.select("file_id", "stream", silent.alias("silent"), heard("m").alias("pooled_max"), heard("a").alias("pooled_mean")))


@query("stream_array_pooling", f"""WITH {B.SCORE13}, a AS (SELECT file_id, CASE WHEN file_id%3=0 THEN []::DOUBLE[] ELSE spectra_scores END AS s FROM score13)
SELECT file_id, CASE WHEN len(s)=0 THEN 0e0 ELSE round(list_max(s),8) END AS p_max, CASE WHEN len(s)=0 THEN 0e0 ELSE round(list_avg(s),8) END AS p_mean,
 CASE WHEN len(s)=0 THEN 0e0 ELSE round(list_avg(list_sort(s,'DESC')[1:2]),8) END AS p_top2, CASE WHEN len(s)=0 THEN 0e0 ELSE round(0.25*list_avg(s)+0.75*list_max(s),8) END AS p_mix FROM a""")
def stream_array_pooling(spark, sf):
    d = B.score13(spark, sf)
    seg = P.silence(F.col("spectra_scores"), (F.col("file_id") % 3).cast("double"))
    return B.rounded(d.select("file_id", P.pool_array(seg, "max").alias("p_max"), P.pool_array(seg, "mean").alias("p_mean"),
                              P.pool_array(seg, "topk", 2).alias("p_top2"), P.pool_array(seg, "mix", 0.25).alias("p_mix")))
