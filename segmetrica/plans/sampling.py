"""Sampling, splits, components, ledger, signal, fits and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as LG
from ..operators import sampling as SP
from ..operators import scorers as S
from ..operators import signal as SI
from ..session import scratch_path
from . import bindings as B
from .registry import query

HASH = lambda seed, *parts: f"md5('{seed}:' || {' || chr(58) || '.join(parts)})"


def _labelled(spark, sf):
    return B.items(spark, sf).withColumn("label", F.col("file_fake"))


_LAB = f"{B.ITEMS}, lb AS (SELECT *, file_fake AS label FROM items)"


@query("group_kfold", f"""WITH {_LAB}, g AS (SELECT grp, ntile(4) OVER (ORDER BY {HASH(5, 'grp')}, grp)-1 AS fold FROM (SELECT DISTINCT grp FROM lb))
SELECT file_id, grp, fold::INT AS fold FROM lb JOIN g USING (grp)""")
def group_kfold(spark, sf):
    return SP.group_kfold(_labelled(spark, sf), "grp", 4, 5).select("file_id", "grp", "fold")


@query("group_split", f"""WITH {_LAB}, g AS (SELECT grp, count(*) AS n FROM lb GROUP BY 1),
r AS (SELECT grp, sum(n) OVER (ORDER BY {HASH(9, "'0'", 'grp')}, grp)-n AS before, row_number() OVER (ORDER BY {HASH(9, "'0'", 'grp')}, grp) AS k, count(*) OVER () AS gs, sum(n) OVER () AS total FROM g)
SELECT file_id, before < greatest(1, round_even(total*0.2e0, 0)) AND k < gs AS is_val FROM lb JOIN r USING (grp)""")
def group_split(spark, sf):
    return SP.group_split(_labelled(spark, sf), "grp", "label", 0.2, 9).select("file_id", "is_val")


@query("stratified_subsample", f"""WITH {_LAB}, r AS (SELECT file_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASH(3, 'file_id')}, file_id) AS k, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS t FROM lb)
SELECT file_id, label FROM r WHERE k <= round_even(1000e0*n/t, 0)""")
def stratified_subsample(spark, sf):
    return SP.stratified_subsample(_labelled(spark, sf), "file_id", "label", 1000, 3).select("file_id", "label")


@query("draw_weights", f"""WITH {_LAB}, w AS (SELECT *, CASE domain WHEN 'BUILDING' THEN 'a' ELSE 'b' END AS src, 1e0+file_id%3 AS wt FROM lb), c AS (SELECT src, label, sum(wt) AS cw, count(*) OVER (PARTITION BY src) AS nc FROM w GROUP BY 1,2)
SELECT file_id, round(CASE src WHEN 'a' THEN 0.25e0 ELSE 0.75e0 END*wt/(cw*nc)*1e6,8) AS draw_weight FROM w JOIN c USING (src,label)""")
def draw_weights(spark, sf):
    d = _labelled(spark, sf).withColumn("src", F.when(F.col("domain") == "BUILDING", "a").otherwise("b")).withColumn("wt", 1.0 + F.col("file_id") % 3)
    d = SP.draw_weights(d, "src", "label", "wt", {"a": 1.0, "b": 3.0})
    return B.rounded(d.select("file_id", (F.col("draw_weight") * 1e6).alias("draw_weight")))


@query("draw_weights_plain", f"""WITH {_LAB}, w AS (SELECT *, CASE domain WHEN 'BUILDING' THEN 'a' ELSE 'b' END AS src, 1e0+file_id%3 AS wt FROM lb), c AS (SELECT src, sum(wt) AS cw FROM w GROUP BY 1)
SELECT file_id, round(CASE src WHEN 'a' THEN 0.25e0 ELSE 0.75e0 END*wt/cw*1e6,8) AS draw_weight FROM w JOIN c USING (src)""")
def draw_weights_plain(spark, sf):
    """Shares per source without balancing the labels."""
    d = _labelled(spark, sf).withColumn("src", F.when(F.col("domain") == "BUILDING", "a").otherwise("b")).withColumn("wt", 1.0 + F.col("file_id") % 3)
    d = SP.draw_weights(d, "src", "label", "wt", {"a": 1.0, "b": 3.0}, balanced=False)
    return B.rounded(d.select("file_id", (F.col("draw_weight") * 1e6).alias("draw_weight")))


@query("sampled_rows", f"WITH {_LAB} SELECT file_id, label FROM (SELECT *, row_number() OVER (ORDER BY {HASH(4, 'file_id')}, file_id) AS k FROM lb) WHERE k <= 300")
def sampled_rows(spark, sf):
    return SP.sample_rows(_labelled(spark, sf), "file_id", "label", 300, 4).select("file_id", "label")


@query("ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def ordered_limit(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return SP.first_rows(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query("balanced_pairs", f"""WITH {_LAB}, p AS (SELECT grp, arg_min(CASE WHEN label=0 THEN file_id END, CASE WHEN label=0 THEN {HASH(1, 'file_id')} END) AS real_id,
  arg_min(CASE WHEN label=1 THEN file_id END, CASE WHEN label=1 THEN {HASH(1, 'file_id')} END) AS fake_id FROM lb GROUP BY 1 HAVING max(label)=1 AND min(label)=0),
r AS (SELECT *, row_number() OVER (ORDER BY {HASH(1, 'grp')}, grp) AS k FROM p) SELECT grp, real_id, fake_id FROM r WHERE k <= 100""")
def balanced_pairs(spark, sf):
    return SP.balanced_pairs(_labelled(spark, sf), "file_id", "grp", "label", 200, 1)


@query("limited_groups", f"""WITH {_LAB}, g AS (SELECT grp, row_number() OVER (ORDER BY {HASH(2, 'grp')}, grp) AS k FROM (SELECT DISTINCT grp FROM lb)) SELECT file_id, grp FROM lb JOIN g USING (grp) WHERE k <= 50""")
def limited_groups(spark, sf):
    return SP.limit_groups(_labelled(spark, sf), "grp", 50, 2).select("file_id", "grp")


@query("generator_round_robin", f"""WITH RECURSIVE {_LAB}, ok AS (SELECT grp FROM lb GROUP BY 1 HAVING min(label)=0 AND max(label)=1),
o AS (SELECT grp, family, arg_min(file_id, ({HASH(4, 'file_id')}, file_id)) AS fake_id, min(({HASH(4, 'file_id')}, file_id)) AS c FROM lb JOIN ok USING (grp) WHERE label=1 GROUP BY 1, 2),
n AS (SELECT family, row_number() OVER (ORDER BY family)-1 AS j, count(*) OVER () AS nf FROM (SELECT DISTINCT family FROM o)),
q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY c) AS pos FROM o JOIN n USING (family)),
t AS (SELECT 0 AS k, []::BIGINT[] AS taken, NULL::BIGINT AS grp, NULL::VARCHAR AS family, NULL::BIGINT AS fake_id
 UNION ALL SELECT k+1, list_append(taken, b.grp), b.grp, b.family, b.fake_id FROM (SELECT t.k, t.taken, arg_min(struct_pack(grp := q.grp, family := q.family, fake_id := q.fake_id), q.pos) AS b
  FROM t JOIN q ON q.j = t.k % q.nf AND q.pos <= 41 AND NOT list_contains(t.taken, q.grp) WHERE t.k < 40 GROUP BY t.k, t.taken))
SELECT grp, family, fake_id, ((k-1) // (SELECT max(nf) FROM n))::INT AS round FROM t WHERE k > 0""")
def generator_round_robin(spark, sf):
    return SP.generator_round_robin(_labelled(spark, sf), "file_id", "grp", "label", "family", 40, 4)


@query("window_draws", f"""WITH it AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey%4=0 THEN 'view' ELSE 'mix' END AS pool, floor(o_totalprice)::BIGINT AS len FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {HASH(7, 'item')}, item)-1 AS idx, count(*) OVER (PARTITION BY pool) AS pn FROM it),
d AS (SELECT id AS draw, CASE WHEN ('0x'||substr({HASH(7, "'pool'", 'id')},1,8))::BIGINT/4294967296e0 < 0.75e0 THEN 'mix' ELSE 'view' END AS pool FROM range(5000) t(id))
SELECT draw, pool, item, ('0x'||substr({HASH(7, "'start'", 'draw')},1,8))::BIGINT % (greatest(len-64000,0)+1) AS start FROM d JOIN r USING (pool) WHERE idx=('0x'||substr({HASH(7, "'item'", 'draw')},1,8))::BIGINT % pn""")
def window_draws(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "view").otherwise("mix").alias("pool"), F.floor("o_totalprice").alias("len"))
    return SP.window_draws(o, "o_orderkey", "pool", "len", 5000, {"mix": 3.0, "view": 1.0}, 7, 64000)


@query("stratified_draws", f"""WITH {B.ITEMS}, i AS (SELECT file_id, domain, file_fake, CASE WHEN file_id%11=0 THEN 0e0 ELSE (1+file_id%4)::DOUBLE END AS w FROM items),
c AS (SELECT *, sum(w) OVER (PARTITION BY domain, file_fake ORDER BY {HASH(6, 'file_id')}, file_id) AS hi, sum(w) OVER (PARTITION BY domain, file_fake) AS al FROM i WHERE w > 0),
s AS (SELECT domain, file_fake, max(al) AS al, row_number() OVER (ORDER BY domain, file_fake)-1 AS j, count(*) OVER () AS n FROM c GROUP BY 1, 2),
d AS (SELECT id AS draw, s.domain, s.file_fake, ('0x'||substr({HASH(6, "'item'", 'id')},1,8))::BIGINT/4294967296e0*al AS u FROM range(20000) t(id) JOIN s ON ('0x'||substr({HASH(6, "'stratum'", 'id')},1,8))::BIGINT % n = j)
SELECT draw, domain, file_fake, file_id FROM d JOIN c USING (domain, file_fake) WHERE c.hi-c.w <= u AND u < c.hi""")
def stratified_draws(spark, sf):
    """Panel and class first, all alike, then a file by its weight, with replacement."""
    i = B.items(spark, sf).withColumn("w", F.when(F.col("file_id") % 11 == 0, 0.0).otherwise((1 + F.col("file_id") % 4).cast("double")))
    return SP.stratified_draws(i, "file_id", ["domain", "file_fake"], 20000, 6, "w")


@query("repeated_rows", "SELECT o_orderkey, c::INT AS copy FROM orders, range(1,4) t(c) WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus='P'")
def repeated_rows(spark, sf):
    o = B.table(spark, sf, "orders")
    return SP.repeat_rows(o.filter("o_orderstatus = 'F'").select("o_orderkey"), 3).unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(0).alias("copy")))


@query("deduplicated_documents", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source='web' OR doc_id%50=0) GROUP BY 1")
def deduplicated_documents(spark, sf):
    """Dedup by content hash after removing everything on a blocklist."""
    d = B.table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id", "source")
    block = d.filter("source = 'web' OR doc_id % 50 = 0").select("digest").distinct()
    return d.join(block, "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


def _source_edges(spark, sf):
    """Orders with the sources they come from: a customer's orders of one priority and year, and those of four
    neighbouring customers in one month. Sources overlap in few orders, so components stay small at every scale."""
    o = B.table(spark, sf, "orders")
    year, month = F.year("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM")
    a = F.concat_ws("-", F.lit("a"), "o_custkey", F.substring("o_orderpriority", 1, 1), year)
    b = F.concat_ws("-", F.lit("b"), F.floor(F.col("o_custkey") / 4), month)
    return o.select("o_orderkey", F.explode(F.array(a, b)).alias("token"))


_COMPONENTS = """WITH RECURSIVE e AS (SELECT o_orderkey AS i, unnest([concat_ws('-', 'a', o_custkey, left(o_orderpriority, 1), year(o_orderdate)),
  concat_ws('-', 'b', o_custkey // 4, strftime(o_orderdate, '%Y-%m'))]) AS t FROM orders),
p AS (SELECT DISTINCT x.i AS a, y.i AS b FROM e x JOIN e y USING (t) WHERE x.i <> y.i),
r AS (SELECT DISTINCT i AS root, i FROM e UNION SELECT r.root, p.b FROM r JOIN p ON r.i = p.a),
c AS (SELECT i, min(root) AS component FROM r GROUP BY 1)"""


@query("source_components", f"{_COMPONENTS} SELECT component, count(*)::BIGINT AS size FROM c GROUP BY 1")
def source_components(spark, sf):
    c = SP.connected_groups(_source_edges(spark, sf), "o_orderkey", "token")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("fold_purge", f"{_COMPONENTS} SELECT i AS o_orderkey FROM c WHERE i % 10 <> 0 AND component NOT IN (SELECT component FROM c WHERE i % 10 = 0)")
def fold_purge(spark, sf):
    """Training items (other folds) that share no component with the held-out items."""
    c = SP.connected_groups(_source_edges(spark, sf), "o_orderkey", "token")
    held = c.filter("o_orderkey % 10 = 0").select("component").distinct()
    return c.filter("o_orderkey % 10 <> 0").join(held, "component", "left_anti").select("o_orderkey")


# --- ledger ---------------------------------------------------------------------------

@query("running_best", """WITH l AS (SELECT o_orderkey, o_orderdate, o_totalprice AS s, max(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM orders)
SELECT o_orderkey, pb AS previous_best, pb IS NULL OR s > pb AS new_best, CASE WHEN pb IS NULL OR s > pb THEN round(s-pb,6) END AS gain, CASE WHEN pb IS NULL OR s > pb THEN round(-(s-pb)/0.3e0,5) END AS music_error_change FROM l""")
def running_best(spark, sf):
    d = LG.running_best(B.table(spark, sf, "orders"), F.to_date("o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")
    return d.select("o_orderkey", "previous_best", "new_best", F.round("gain", 6).alias("gain"), F.round(LG.implied_error_change(F.col("gain"), "music"), 5).alias("music_error_change"))


@query("ledger_scan", "SELECT CASE WHEN o_orderkey%6=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS day, count(*)::BIGINT AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def ledger_scan(spark, sf):
    """Ledger CSV with dates that may be text, written and scanned with its schema."""
    from ..sources.manifests import read_ledger

    o = B.table(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 6 == 0, "not recorded").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = scratch_path(spark, "ledger")
    o.select(F.col("o_orderkey").cast("string").alias("id"), day.alias("date_kst"), F.lit("x, \"y\"").alias("change"), F.col("o_totalprice").cast("string").alias("score"),
             F.lit("").alias("ads"), F.lit("n/a").alias("cps"), F.lit("completed").alias("status"), F.lit("no").alias("kept")).write.option("header", True).option("escape", '"').csv(path)
    d = read_ledger(spark, path)
    return d.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score_value"), 2).alias("total"))


@query("quota_by_day", """WITH u AS (SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS used FROM events GROUP BY 1), d AS (SELECT unnest(generate_series((SELECT min(day) FROM u)::TIMESTAMP, (SELECT max(day) FROM u)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT day::VARCHAR AS day, coalesce(used,0)::BIGINT AS used, greatest(300-coalesce(used,0),0)::BIGINT AS remaining, coalesce(used,0)>300 AS over FROM d LEFT JOIN u USING (day)""")
def quota_by_day(spark, sf):
    q = LG.quota_by_day(B.table(spark, sf, "events"), "ts", 300)
    return q.withColumn("day", F.col("day").cast("string"))


@query("quota_budget", """WITH b AS (SELECT event_id, ts AS n, TIMESTAMP '2024-01-20 04:30:00' AS d, event_id%5 AS u FROM events), l AS (SELECT *, n >= d AS closed, (n+INTERVAL 9 HOUR)::DATE AS t, (d+INTERVAL 9 HOUR)::DATE AS e FROM b),
f AS (SELECT *, CASE WHEN closed THEN 0 ELSE greatest(date_diff('day',t,e)-1,0) END AS full_days, CASE WHEN closed OR e<=t THEN 0 ELSE 1 END AS partial_days FROM l), p AS (SELECT *, CASE WHEN closed THEN 0 ELSE 5-u END + 5*(full_days+partial_days) AS r FROM f)
SELECT event_id, closed, full_days::INT AS full_days, partial_days::INT AS partial_days, r::BIGINT AS platform_remaining, least(r, 40-event_id%30)::BIGINT AS effective_remaining FROM p""")
def quota_budget(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.col("ts").alias("now"), F.expr("TIMESTAMP_NTZ '2024-01-20 04:30:00'").alias("deadline"), (F.col("event_id") % 5).alias("used"), (F.col("event_id") % 30).alias("spent"))
    return LG.budget(e, "now", "deadline", 5, "used", 40, "spent").select("event_id", "closed", "full_days", "partial_days", "platform_remaining", "effective_remaining")


# --- signal ---------------------------------------------------------------------------

def _frames(spark, sf):
    """Embeddings as frames of 64 samples, label as the file."""
    return B.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("file_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v * 4).alias("samples"))


@query("time_measures", """WITH s AS (SELECT label, vec_id, list_transform(embedding, lambda v: (v*4)::FLOAT::DOUBLE) AS x FROM embeddings), f AS (SELECT label, list_sum(list_transform(x, lambda v: v*v)) AS sq, len(list_filter(x, lambda v: abs(v)>=0.999)) AS c FROM s)
SELECT label::BIGINT AS file_id, round(sqrt(sum(sq)/(64*count(*))),7) AS rms, round(sum(c)/(64*count(*)),8) AS clipped_sample_fraction, round(avg((sqrt(sq/64)<=0.001)::INT),8) AS silent_frame_fraction FROM f GROUP BY 1""")
def time_measures(spark, sf):
    m = SI.time_measures(_frames(spark, sf))
    return m.select("file_id", F.round("rms", 7).alias("rms"), F.round("clipped_sample_fraction", 8).alias("clipped_sample_fraction"), F.round("silent_frame_fraction", 8).alias("silent_frame_fraction"))


@query("spectral_measures")
def spectral_measures(spark, sf):
    return B.rounded(SI.spectral_measures(SI.frame_power(_frames(spark, sf), 64), 64), 6)


@query("fakeprint")
def fakeprint(spark, sf):
    return B.rounded(SI.fakeprint(SI.frame_power(_frames(spark, sf), 64, db=True), 64), 6)


@query("tree_score_signal22")
def tree_score_signal22(spark, sf):
    """The measured signal features of a file next to its 17 logits."""
    from . import models as MD
    from .scoring import evidence

    f = _frames(spark, sf)
    m = SI.time_measures(f).join(SI.spectral_measures(SI.frame_power(f, 64), 64), "file_id").withColumnRenamed("file_id", "fid")
    d = evidence(spark, sf).withColumn("fid", F.col("file_id") % 10).join(m, "fid")
    return B.rounded(S.tree_score(d, "signal22", MD.tree_model(22, 14), "score").select("file_id", "score"), 6)


@query("binary_digests", "SELECT doc_id::BIGINT AS doc_id, sha256(text) AS sha256, doc_id%3=0 AS differs FROM documents")
def binary_digests(spark, sf):
    """Content digests against stored ones (P3), over whole texts as bytes."""
    from ..operators.quality import hash_mismatches
    from ..sources.manifests import with_digest

    d = with_digest(B.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")))
    stored = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper("sha256")).alias("sha256"))
    bad = hash_mismatches(stored, d.select("doc_id", "sha256"), "doc_id").select("doc_id", F.lit(True).alias("bad"))
    return d.join(bad, "doc_id", "left").select("doc_id", "sha256", F.coalesce("bad", F.lit(False)).alias("differs"))


@query("header_probe", """SELECT page_id::VARCHAR AS path, CASE page_id % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp3' ELSE '' END AS codec,
  (CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 16000 ELSE 44100 END WHEN 1 THEN 44100 END)::INT AS sample_rate,
  (CASE page_id % 3 WHEN 0 THEN 1 + page_id % 2 WHEN 1 THEN 2 END)::INT AS channels,
  (CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 256 ELSE 1411 END WHEN 1 THEN 128 END)::INT AS bitrate_kbps,
  CASE page_id % 3 WHEN 0 THEN strlen(html) / (2e0 * (1 + page_id % 2) * (CASE WHEN page_id % 2 = 0 THEN 16000 ELSE 44100 END))
    WHEN 1 THEN CASE WHEN page_id % 2 = 1 THEN (page_id + 1) * 1152e0 / 44100 ELSE 834 / 16000e0 END END AS duration_seconds
FROM pages""")
def header_probe(spark, sf):
    """Header facts of files built from each page: RIFF around its text, MPEG frames behind text and tags, plain text."""
    from ..sources.probe import probe

    n, k = F.octet_length("html"), F.col("page_id")
    word = lambda c, digits: F.lpad(F.hex(c.cast("long")), digits, "0")
    little = lambda c, digits: F.concat(*[F.substring(word(c, digits), p, 2) for p in range(digits - 1, 0, -2)])
    channels, rate = 1 + k % 2, F.when(k % 2 == 0, 16000).otherwise(44100)
    form = F.concat(
        F.lit("524946460000000057415645666D742010000000"), F.lit("0100"), little(channels, 4), little(rate, 8), little(rate * channels * 2, 8),
        little(channels * 2, 4), F.lit("1000"), F.lit("64617461"), little(n, 8))
    riff = F.concat(F.unhex(form), F.encode("html", "UTF-8"))
    # two frames of 417 bytes at 128 kbit/s and 44.1 kHz; odd pages carry a VBR tag with page_id + 1 frames
    blank = F.lit("00" * 413)
    tag = F.concat(F.lit("00" * 32), F.lit("58696E6700000001"), word(k + 1, 8), F.lit("00" * (413 - 44)))
    frames = F.concat(F.lit("FFFB9000"), F.when(k % 2 == 1, tag).otherwise(blank), F.lit("FFFB9000"), blank)
    mpeg = F.concat(F.encode("html", "UTF-8"), F.unhex(frames))
    content = F.when(k % 3 == 0, riff).when(k % 3 == 1, mpeg).otherwise(F.encode("html", "UTF-8"))
    return probe(B.table(spark, sf, "pages").select(k.cast("string").alias("path"), content.alias("content")))


# --- fits ------------------------------------------------------------------------------

@query("grouped_fit")
def grouped_fit(spark, sf):
    """Grouped cross-validation over C, pooled out-of-fold EER, refit, export and its parity error."""
    from ..functions.features import feature_set
    from ..operators.fits import fit_grouped

    d = B.score13(spark, sf)
    pairs = feature_set("file17")
    names = [n for n, _ in pairs]
    x = d.select("grp", F.col("file_fake").alias("label"), *[c.alias(n) for n, c in pairs])
    model, search = fit_grouped(x, names, "label", "grp")
    scored = S.linear_score(x, names, model, "score").agg(F.avg("score").alias("mean_score"))
    from ..operators.prefix import attach

    return B.rounded(attach(search.withColumn("chosen", F.col("C") == model["C"]), scored, []), 5)


# --- streaming ----------------------------------------------------------------------------

FILE_EVENTS = 1_000_000


def _split_events(spark, sf, parts: int = 3) -> tuple[str, int]:
    """The events in files of up to about FILE_EVENTS, and how many of them make a batch, so that a stream sees several batches."""
    path, e = scratch_path(spark, "events"), B.table(spark, sf, "events")
    each = max(1, -(-e.count() // (parts * FILE_EVENTS)))
    e.repartition(parts * each, "event_id").write.parquet(path)
    return path, each


def _stream(spark, sf, again: str | None = None):
    """again: a condition for rows that come a second time, in files of their own."""
    path, each = _split_events(spark, sf)
    if again:
        B.table(spark, sf, "events").filter(again).repartition(2).write.mode("append").parquet(path)
    return spark.readStream.schema(B.table(spark, sf, "events").schema).option("maxFilesPerTrigger", each).parquet(path)


@query("incremental_scoring", "SELECT event_id, round(value/500,8) AS score FROM events")
def incremental_scoring(spark, sf):
    from ..streaming import incremental as R

    out = scratch_path(spark, "scores")
    q = R.score_new(_stream(spark, sf, again="event_id % 3 = 0"), "event_id", lambda d: d.select("event_id", F.round(F.col("value") / 500, 8).alias("score")), out, out + "-ck")
    q.awaitTermination()
    return R.read_scores(spark, out)


@query("incremental_latest", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1,2")
def incremental_latest(spark, sf):
    from ..streaming import incremental as R

    out = scratch_path(spark, "latest")
    s = _stream(spark, sf, again="event_id % 3 = 0").select("user_id", "event_type", "event_id", "value")
    q = R.last_write_wins(s, ["user_id", "event_type"], ["event_id"], out, out + "-ck")
    q.awaitTermination()
    return R.read_latest(spark, out, s.schema)


def _latest_update(spark, df, name, keys, order):
    """Write an update-mode stream as batches and keep the newest row per key."""
    from ..operators.quality import first_wins

    out = scratch_path(spark, name)
    q = (
        df.writeStream.outputMode("update")
        .foreachBatch(lambda b, e: b.withColumn("_batch", F.lit(e)).write.mode("overwrite").parquet(f"{out}/b={e}"))
        .option("checkpointLocation", out + "-ck").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return first_wins(spark.read.parquet(f"{out}/*"), keys, ["_batch", *order], last=True).drop("_batch")


@query("streaming_pool", "SELECT user_id, max(value/500) AS p_max, round(avg(value/500),6) AS p_mean, count(*)::BIGINT AS n FROM events GROUP BY 1")
def streaming_pool(spark, sf):
    from ..streaming import incremental as R

    s = _stream(spark, sf).withColumn("score", F.col("value") / 500)
    d = _latest_update(spark, R.running_pool(s, "user_id", "score"), "pool", ["user_id"], ["n"])
    return d.select("user_id", "p_max", F.round(F.col("total") / F.col("n"), 6).alias("p_mean"), "n")


@query("streaming_smooth_max", "SELECT user_id, round(ln(avg(exp(value/100-zm)))+max(zm),7) AS pooled, count(*)::BIGINT AS n FROM (SELECT *, max(value/100) OVER (PARTITION BY user_id) AS zm FROM events) GROUP BY 1")
def streaming_smooth_max(spark, sf):
    from ..streaming import incremental as R

    s = _stream(spark, sf).select("user_id", (F.col("value") / 100).alias("z"))
    sums = _latest_update(spark, R.running_smooth_max(s, "user_id", "z"), "lse", ["user_id", "part"], ["n"])
    d = R.smooth_max(sums, "user_id")
    return d.select("user_id", F.round("pooled", 7).alias("pooled"), "n")


@query("streaming_drift", """WITH w AS (SELECT value/500 AS s, event_type='error' AS f, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01')-INTERVAL 12 HOUR]) AS a FROM events)
SELECT strftime(a,'%Y-%m-%d %H:%M') AS window_start, count(*)::BIGINT AS n, round(avg(s),8) AS mean_score, round(avg(f::INT),8) AS fake_rate FROM w GROUP BY 1""")
def streaming_drift(spark, sf):
    from ..streaming import incremental as R

    path = scratch_path(spark, "drift")
    # Files in time order: rows later than the watermark would be dropped by design.
    B.table(spark, sf, "events").write.parquet(path)
    s = spark.readStream.schema(B.table(spark, sf, "events").schema).parquet(path)
    d = R.drift(s, "ts", F.col("value") / 500, F.col("event_type") == "error").select(F.col("w.start").alias("a"), "n", "mean_score", "fake_rate")
    out = _latest_update(spark, d, "driftout", ["a"], ["n"])
    return B.rounded(out.select(F.date_format("a", "yyyy-MM-dd HH:mm").alias("window_start"), "n", "mean_score", "fake_rate"))
