"""Manifests, licences, pairings, stores, quality rules, leaks and sinks.

Input bindings here are SQL expressions that mean the same in both engines; the
operators under test are not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import labels as LB
from ..operators import quality as Q
from ..schemas import MANIFEST, PREDICTION_COLUMNS
from ..session import scratch_path
from ..sources import manifests as MF
from ..sources import sinks, stores
from . import bindings as B
from .registry import query


def bound(spark, sf, table, exprs):
    return B.table(spark, sf, table).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def cte(name, table, exprs):
    return f"{name} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {table})"


_S = "CAST(doc_id AS STRING)"
MANIFEST_ROWS = {
    "row": "doc_id + 2",
    "sample_id": f"CASE WHEN doc_id % 97 = 5 THEN '' WHEN doc_id % 50 = 7 THEN concat('s', CAST(doc_id - 1 AS STRING)) ELSE concat('s', {_S}) END",
    "relative_path": f"CASE WHEN doc_id % 61 = 3 THEN concat('../', {_S}) WHEN doc_id % 70 = 9 THEN concat('a/', CAST(doc_id - 9 AS STRING)) ELSE concat('a/', {_S}) END",
    "sha256": f"CASE WHEN doc_id % 43 = 1 THEN 'xyz' ELSE concat(md5({_S}), md5(source)) END",
    "source_dataset": "source", "source_version": "'v1'", "source_url": "CASE WHEN doc_id % 37 = 2 THEN ' ' ELSE 'http://x' END",
    "license_id": "'CC0-1.0'", "license_url": "'https://x'",
    "redistribution_allowed": "CASE WHEN doc_id % 31 = 4 THEN 'False' WHEN doc_id % 101 = 6 THEN 'maybe' ELSE 'true' END",
    "derivatives_allowed": "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END", "attribution": "'someone'",
    "file_fake": "CASE WHEN doc_id % 41 = 8 THEN '2' WHEN doc_id % 3 = 0 THEN '' ELSE '1' END", "voice_fake": "''", "music_fake": "''",
    "voice_present": "CASE WHEN doc_id % 5 = 0 THEN '1' ELSE '' END", "music_present": "''",
    "generator_family": "lang", "generator_model": "lang", "source_family": "source", "speaker_id": "''", "content_id": "''", "codec": "'wav'",
    "sample_rate": "'16000'", "channels": "'1'", "duration_seconds": "'1.5'", "parent_sha256": "''",
    "transformations_json": "CASE WHEN doc_id % 29 = 3 THEN '{\"a\":1}' WHEN doc_id % 23 = 1 THEN '[\"mp3\"]' WHEN doc_id % 19 = 0 THEN '' ELSE '[]' END",
}


@query("manifest_violations", f"""WITH {cte('m', 'documents', MANIFEST_ROWS)},
d1 AS (SELECT "row", sample_id, relative_path, min("row") OVER (PARTITION BY sample_id) AS f1, min("row") OVER (PARTITION BY relative_path) AS f2 FROM m)
SELECT "row", 'empty sample_id' AS rule FROM m WHERE sample_id=''
UNION ALL SELECT "row", 'unsafe relative_path' FROM m WHERE relative_path LIKE '../%'
UNION ALL SELECT "row", 'redistribution_allowed is not true or false' FROM m WHERE redistribution_allowed='maybe'
UNION ALL SELECT "row", 'not deliverable' FROM m WHERE redistribution_allowed='False'
UNION ALL SELECT "row", 'source_url is required' FROM m WHERE trim(source_url)=''
UNION ALL SELECT "row", 'file_fake must be empty, 0 or 1' FROM m WHERE file_fake='2'
UNION ALL SELECT "row", 'no known label' FROM m WHERE file_fake='' AND voice_present=''
UNION ALL SELECT "row", 'transformations_json is not a list' FROM m WHERE transformations_json LIKE '{{%'
UNION ALL SELECT "row", 'transformed without permission' FROM m WHERE transformations_json='["mp3"]' AND derivatives_allowed='false'
UNION ALL SELECT "row", 'sha256 is invalid' FROM m WHERE sha256='xyz'
UNION ALL SELECT "row", 'duplicate sample_id' FROM d1 WHERE sample_id<>'' AND "row">f1
UNION ALL SELECT "row", 'duplicate relative_path' FROM d1 WHERE "row">f2""")
def manifest_violations(spark, sf):
    return Q.manifest_violations(bound(spark, sf, "documents", MANIFEST_ROWS))


@query("manifest_csv_round_trip", f"""WITH {cte('m', 'documents', MANIFEST_ROWS)}
SELECT source_dataset, count(*)::BIGINT AS n, count(DISTINCT sha256)::BIGINT AS hashes, max(transformations_json) AS last_json FROM m GROUP BY 1""")
def manifest_csv_round_trip(spark, sf):
    """Write the canonical CSV and its JSON side table, read the CSV back with its fixed schema."""
    path = scratch_path(spark, "manifest")
    sinks.write_manifests(bound(spark, sf, "documents", MANIFEST_ROWS), path + "/csv", path + "/jsonl")
    back = MF.read_csv(spark, path + "/csv", MANIFEST)
    return back.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("hashes"), F.max("transformations_json").alias("last_json"))


CONFIG_ROWS = {
    "row": "o_orderkey + 2", "file": "CASE WHEN o_orderkey % 40 = 1 THEN '' WHEN o_orderkey % 53 = 2 THEN 'x/../y.wav' WHEN o_orderkey % 60 = 3 THEN concat('d/', CAST(o_orderkey - 1 AS STRING), '.wav') ELSE concat(' d/', CAST(o_orderkey AS STRING), '.wav') END",
    "verdict": "CASE WHEN o_orderstatus = 'F' THEN ' Spoof' WHEN o_orderstatus = 'O' THEN 'genuine' WHEN o_orderkey % 10 = 0 THEN 'dunno' ELSE '0' END",
    "who": "CASE WHEN o_custkey % 6 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END", "generator_family": "o_orderpriority",
}


@query("configurable_manifest", f"""WITH {cte('m', 'orders', CONFIG_ROWS)}, p AS (SELECT *, trim(file) AS rel, CASE lower(trim(verdict)) WHEN 'spoof' THEN 1 WHEN 'genuine' THEN 0 WHEN '0' THEN 0 END AS y FROM m)
SELECT "row", rel AS sample_id, 'root/' || rel AS audio_path, y AS label, CASE WHEN trim(who)='' THEN 'unknown' ELSE who END AS content_group, generator_family, 'unknown' AS license, 'unknown' AS transform
FROM p WHERE rel<>'' AND rel NOT LIKE '%..%' AND y IS NOT NULL""")
def configurable_manifest(spark, sf):
    d = bound(spark, sf, "orders", CONFIG_ROWS)
    return MF.manifest_rows(d, {"rel_path": "file", "label": "verdict", "content_group": "who"}, root="root")[0]


@query("configurable_manifest_violations", f"""WITH {cte('m', 'orders', CONFIG_ROWS)}, p AS (SELECT *, trim(file) AS rel, min("row") OVER (PARTITION BY trim(file)) AS f FROM m)
SELECT "row", 'no audio path' AS rule FROM p WHERE rel='' UNION ALL SELECT "row", 'unsafe rel_path' FROM p WHERE rel LIKE '%..%'
UNION ALL SELECT "row", 'unknown label' FROM p WHERE verdict='dunno' UNION ALL SELECT "row", 'duplicate sample' FROM p WHERE rel<>'' AND "row">f""")
def configurable_manifest_violations(spark, sf):
    d = bound(spark, sf, "orders", CONFIG_ROWS)
    return MF.manifest_rows(d, {"rel_path": "file", "label": "verdict", "content_group": "who"}, root="root")[1]


_SCANNED = f"""{cte('m', 'orders', CONFIG_ROWS)}, p AS (SELECT *, row_number() OVER (ORDER BY "row")+1 AS nr, trim(file) AS rel, CASE lower(trim(verdict)) WHEN 'spoof' THEN 1 WHEN 'genuine' THEN 0 WHEN '0' THEN 0 END AS y FROM m)"""


def _scanned(spark, sf):
    """The manifest as one file in order, some of its fields with line ends and quotes, scanned with the rows' numbers."""
    path = scratch_path(spark, "manifest") + "/manifest.csv"
    d = bound(spark, sf, "orders", CONFIG_ROWS)
    note = F.when(F.col("row") % 9 == 0, F.concat(F.lit('two\nlines, "quoted" of '), "row")).otherwise(F.lit("-"))
    sinks.write_ordered(d.withColumn("note", note), path, ["row"], ["file", "verdict", "who", "generator_family", "note"])
    return MF.read_csv(spark, path, row="row")


@query("scanned_manifest", f"""WITH {_SCANNED} SELECT nr AS "row", rel AS sample_id, y AS label, CASE WHEN trim(who)='' THEN 'unknown' ELSE trim(who) END AS content_group,
 CASE WHEN ("row")%9=0 THEN 'two' || chr(10) || 'lines, "quoted" of ' || "row" ELSE '-' END AS note FROM p WHERE rel<>'' AND rel NOT LIKE '%..%' AND y IS NOT NULL""")
def scanned_manifest(spark, sf):
    d = _scanned(spark, sf)
    rows = MF.manifest_rows(d, {"rel_path": "file", "label": "verdict", "content_group": "who"}, root="root")[0]
    return rows.join(d.select("row", "note"), "row").select("row", "sample_id", "label", F.trim("content_group").alias("content_group"), "note")


@query("scanned_manifest_violations", f"""WITH {_SCANNED}, q AS (SELECT *, min(nr) OVER (PARTITION BY rel) AS f FROM p)
SELECT nr AS "row", 'no audio path' AS rule FROM q WHERE rel='' UNION ALL SELECT nr, 'unsafe rel_path' FROM q WHERE rel LIKE '%..%'
UNION ALL SELECT nr, 'unknown label' FROM q WHERE verdict='dunno' UNION ALL SELECT nr, 'duplicate sample' FROM q WHERE rel<>'' AND nr>f""")
def scanned_manifest_violations(spark, sf):
    return MF.manifest_rows(_scanned(spark, sf), {"rel_path": "file", "label": "verdict", "content_group": "who"}, root="root")[1]


TRAIN_ROWS = {"relative_path": "concat('wav/', CAST(o_orderkey AS STRING), '.flac')", "file_fake": "CASE WHEN o_orderstatus = 'F' THEN 'bona-fide' ELSE 'SPOOF' END",
              "speaker": "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END", "weight": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS STRING) END", "channel": "o_orderpriority"}


@query("training_manifest", f"""WITH {cte('m', 'orders', TRAIN_ROWS)} SELECT 'data/' || relative_path AS path, CASE WHEN file_fake='SPOOF' THEN 1 ELSE 0 END AS label,
 'tag:' || CASE WHEN speaker='' THEN regexp_extract(relative_path,'([^/]+)[.]flac$',1) ELSE speaker END AS "group", CASE WHEN weight='' THEN 1e0 ELSE weight::DOUBLE END AS weight, channel FROM m""")
def training_manifest(spark, sf):
    d = MF.training_rows(bound(spark, sf, "orders", TRAIN_ROWS), "tag", "data")
    return d.select("path", "label", "group", "weight", F.element_at("meta", "channel").alias("channel"))


PAIRS = {"row": "o_orderkey", "track_id": "CASE WHEN o_orderkey % 90 = 1 THEN 'bad' ELSE CAST(o_custkey AS STRING) END", "subset": "CASE WHEN o_orderstatus = 'F' THEN 'large' ELSE ' small' END",
         "original_audio": "concat('orig', CAST(o_custkey AS STRING))", "title": "o_orderpriority", "artist": "''", "license": "'Attribution'", "duration": "CASE WHEN o_orderkey % 8 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END"}
_PAIRS_SQL = f"""{cte('pr', 'orders', PAIRS)}, pairs AS (SELECT track_id::BIGINT AS track_id, original_audio, title, artist, license, CASE WHEN duration='n/a' THEN NULL ELSE duration::DOUBLE END AS duration FROM
 (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY "row") AS k FROM pr WHERE trim(subset)='small' AND track_id<>'bad') WHERE k=1)"""


def _pairs(spark, sf):
    return MF.pairings(bound(spark, sf, "orders", PAIRS))


@query("pairing_rows", f"WITH {_PAIRS_SQL} SELECT track_id, original_audio, title, duration FROM pairs")
def pairing_rows(spark, sf):
    return _pairs(spark, sf).select("track_id", "original_audio", "title", "duration")


FACTS = {"row": "l_orderkey * 100000 + l_partkey * 10 + l_linenumber", "track_id": "CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_suppkey AS STRING) END",
         "license_title": "CASE l_linenumber % 5 WHEN 0 THEN 'Attribution-NonCommercial-NoDerivs' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN 'Attribution Share Alike' WHEN 3 THEN 'Public Domain' ELSE 'Custom Terms' END",
         "license_url": "CASE l_linenumber % 5 WHEN 0 THEN 'http://creativecommons.org/licenses/by-nc-nd/3.0/us/' WHEN 1 THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 2 THEN 'http://creativecommons.org/licenses/by-sa/4.0/' WHEN 3 THEN 'https://x.org/terms' ELSE 'https://y.org/' END",
         "track_url": "'http://t'", "artist_name": "concat('artist', CAST(l_suppkey % 3 AS STRING))"}
_FACTS_SQL = f"""{cte('fr', 'lineitem', FACTS)}, facts AS (SELECT track_id::BIGINT AS track_id, license_title, license_url, track_url, artist_name FROM
 (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY "row" DESC, license_title) AS k FROM fr WHERE track_id<>'x' AND track_id::BIGINT IN (SELECT track_id FROM pairs)) WHERE k=1)"""
_LIC = """CASE license_title WHEN 'Attribution-NonCommercial-NoDerivs' THEN 'CC-BY-NC-ND-3.0-US' WHEN 'CC0 1.0' THEN 'CC0-1.0' WHEN 'Attribution Share Alike' THEN 'CC-BY-SA-4.0' WHEN 'Public Domain' THEN 'CC-PD' ELSE 'CUSTOM-TERMS' END"""


def _facts(spark, sf):
    d = bound(spark, sf, "lineitem", FACTS)
    return MF.licence_index(d, _pairs(spark, sf))


@query("licence_terms", f"""WITH {_PAIRS_SQL}, {cte('fr', 'lineitem', FACTS)} SELECT license_title AS raw_title, {_LIC} AS license_id, replace(license_url,'http://','https://') AS license_url,
 license_title NOT LIKE '%NoDeriv%' AS derivatives_allowed, license_title NOT LIKE '%NonCommercial%' AS commercial_use_allowed, count(*)::BIGINT AS n FROM fr GROUP BY ALL""")
def licence_terms(spark, sf):
    d = bound(spark, sf, "lineitem", FACTS).select(LB.licence(F.col("license_title"), F.col("license_url")).alias("l")).select("l.*")
    return d.groupBy("raw_title", "license_id", "license_url", "derivatives_allowed", "commercial_use_allowed").agg(F.count(F.lit(1)).alias("n"))


_REALS = f"""{_PAIRS_SQL}, {_FACTS_SQL}, reals AS (SELECT printf('fma-%06d-original', track_id) AS sample_id, md5(track_id::VARCHAR) AS sha256, {_LIC} AS license_id,
  license_title NOT LIKE '%NoDeriv%' AS derivatives_allowed, artist_name || ' - ' || title || ' (' || track_url || '), licensed ' || {_LIC} AS attribution, printf('fma-%06d', track_id) AS content_id, original_audio
  FROM pairs JOIN facts USING (track_id))"""


def _reals(spark, sf):
    facts = _facts(spark, sf).withColumn("sha256", F.md5(F.col("track_id").cast("string")))
    return MF.real_rows(_pairs(spark, sf), facts)


@query("real_manifest_rows", f"WITH {_REALS} SELECT sample_id, sha256, license_id, derivatives_allowed, attribution, content_id FROM reals")
def real_manifest_rows(spark, sf):
    return _reals(spark, sf).select("sample_id", "sha256", "license_id", "derivatives_allowed", "attribution", "content_id")


FAKES = {"original_audio": "concat('orig', CAST(event_id % 1500 AS STRING))", "path_in_dataset": "concat('set/', event_type, '/Clip_', CAST(event_id AS STRING), '.mp3')", "generator": "concat(event_type, ' ')",
         "type": "CASE WHEN event_id % 2 = 0 THEN 'ata' ELSE 'TTA' END"}


@query("fake_manifest_rows", f"""WITH {_REALS}, {cte('fk', 'events', FAKES)} SELECT 'echoes-clip-' || regexp_extract(path_in_dataset,'_([0-9]+)',1) AS sample_id, trim(generator) AS generator_family, upper(type) AS generation_type,
 CASE WHEN type='ata' THEN 'audio-and-text' ELSE 'text-only' END AS conditioning, CASE WHEN type='ata' THEN sha256 ELSE '' END AS parent_sha256, content_id, '1' AS file_fake FROM fk JOIN reals USING (original_audio)""")
def fake_manifest_rows(spark, sf):
    return MF.fake_rows(_reals(spark, sf), bound(spark, sf, "events", FAKES))


@query("paired_fakes", f"""WITH {_PAIRS_SQL}, {cte('fk', 'events', FAKES)} SELECT original_audio, path_in_dataset, row_number() OVER (PARTITION BY original_audio ORDER BY path_in_dataset) AS pos FROM fk WHERE original_audio IN (SELECT original_audio FROM pairs)""")
def paired_fakes(spark, sf):
    return MF.paired_fakes(bound(spark, sf, "events", FAKES), _pairs(spark, sf)).select("original_audio", "path_in_dataset", "pos")


@query("path_safety", """SELECT page_id, CASE WHEN p='' OR p LIKE '%/' THEN 'not a file' WHEN p LIKE '/%' OR regexp_matches(p,'^[A-Za-z]:') THEN 'absolute' WHEN regexp_matches(p,'(^|/)[.][.](/|$)') THEN 'escapes its root' END AS reason
FROM (SELECT page_id, CASE page_id%6 WHEN 0 THEN url || '/' WHEN 1 THEN '/' || url WHEN 2 THEN 'C:/' || url WHEN 3 THEN 'a/../' || url WHEN 4 THEN '' ELSE replace(url, ':', '_') END AS p FROM pages)""")
def path_safety(spark, sf):
    u, m = F.col("url"), F.col("page_id") % 6
    p = F.when(m == 0, F.concat(u, F.lit("/"))).when(m == 1, F.concat(F.lit("/"), u)).when(m == 2, F.concat(F.lit("C:\\"), u)).when(m == 3, F.concat(F.lit("a\\..\\"), u)).when(m == 4, "").otherwise(F.replace(u, F.lit(":"), F.lit("_")))
    return B.table(spark, sf, "pages").select("page_id", LB.unsafe_path(p).alias("reason"))


@query("text_slugs")
def text_slugs(spark, sf):
    """Slug of whole texts; accents are folded by a vectorised helper."""
    d = B.table(spark, sf, "documents").select("doc_id", LB.slug(LB.fold_accents(F.col("text"))).alias("slug"))
    return d.select("doc_id", F.length("slug").alias("n"), F.md5("slug").alias("digest"))


@query("member_paths", "SELECT o_orderkey, printf('fma-%06d', o_orderkey*13) AS content_group, printf('fma_small/%03d/%06d.mp3', o_orderkey*13//1000, o_orderkey*13) AS member FROM orders")
def member_paths(spark, sf):
    k = F.col("o_orderkey") * 13
    return B.table(spark, sf, "orders").select("o_orderkey", LB.content_group(k).alias("content_group"), LB.member_path(k).alias("member"))


@query("config_fingerprints", """SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}'),1,16) AS fingerprint FROM part""")
def config_fingerprints(spark, sf):
    j = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    return B.table(spark, sf, "part").select("p_partkey", H.fingerprint(j).alias("fingerprint"))


@query("checksum_listing", "SELECT 'fma/' || c_name || '.mp3' AS member, md5(c_name) AS digest FROM customer WHERE c_custkey%10<>0")
def checksum_listing(spark, sf):
    line = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.upper(F.md5("c_name")), F.lit("  "), F.col("c_name"), F.lit(".mp3"))).otherwise(F.lit("broken"))
    return MF.checksums(B.table(spark, sf, "customer").select(line.alias("value")), "fma")


# --- stores ---------------------------------------------------------------------------

EVENT_RECORDS = {"seq": "event_id", "sample_id": "CAST(user_id AS STRING)", "audio_sha256": "md5(concat(CAST(user_id AS STRING), event_type))", "value": "value"}


def _event_lines(spark, sf):
    d = B.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("sample_id"), F.md5(F.concat(F.col("user_id").cast("string"), "event_type")).alias("audio_sha256"),
        F.lit("cfg").alias("config_fingerprint"), (F.col("event_id") % 2).cast("int").alias("label"), (F.col("value") / 500).alias("voice_present"), F.lit(0.5).alias("music_present"),
        *[F.struct(F.array(F.col("value") / 500).alias("segments"), F.lit(False).alias("silent")).alias(s) for s in ("voice", "music", "mixture")])
    text = F.to_json(F.struct("*"))
    k = F.col("seq")
    return d.select(F.when(k % 50 == 3, F.substring(text, 1, 40)).when(k % 50 == 4, F.lit('{"seq": 1}')).when(k % 50 == 5, F.lit(" ")).otherwise(text).alias("value"))


@query("record_store_latest", """SELECT user_id::VARCHAR AS sample_id, md5(user_id::VARCHAR || event_type) AS audio_sha256, max(event_id) AS seq, round(arg_max(value, event_id)/500,8) AS voice_present
FROM events WHERE event_id%50 NOT IN (3,4,5) GROUP BY user_id, event_type""")
def record_store_latest(spark, sf):
    """Append JSON lines, compact them, load them again: later line wins, corrupt lines skipped."""
    path = scratch_path(spark, "store")
    _event_lines(spark, sf).write.text(path + "/a")
    stores.compact(spark, path + "/a", path + "/b")
    records, _ = stores.load_store(spark, path + "/b")
    return B.rounded(records.select("sample_id", "audio_sha256", "seq", "voice_present"))


@query("record_store_corrupt", "SELECT sum((event_id%50 IN (3,4))::INT)::BIGINT AS corrupt_lines FROM events")
def record_store_corrupt(spark, sf):
    return stores.parse_records(_event_lines(spark, sf))[1]


@query("score_cache_split", """SELECT d.doc_id%2=0 AS hit, count(*)::BIGINT AS n, round(sum(CASE WHEN doc_id%2=0 THEN (doc_id%100)/100e0 ELSE 0 END),6) AS cached_sum FROM documents d GROUP BY 1""")
def score_cache_split(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("sha256"))
    cache = d.filter("doc_id % 2 = 0").select(F.concat_ws(":", F.lit("det-v1"), "sha256").alias("cache_key"), (F.col("doc_id") % 100 / 100.0).alias("score"))
    hits, misses = stores.cache_split(d, cache, "det-v1")
    both = hits.select(F.lit(True).alias("hit"), "score").unionByName(misses.select(F.lit(False).alias("hit"), F.lit(0.0).alias("score")))
    return both.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("cached_sum"))


def _length_scorer():
    def score(pdf):
        if (pdf["sample_id"].astype(int) % 31 == 0).any():
            raise ValueError("unreadable")
        return pdf["n"].mod(97) / 96.0

    return score


@query("scored_with_cache", """WITH d AS (SELECT *, bool_or(doc_id%2=0) OVER (PARTITION BY text) AS hit, min(doc_id::VARCHAR) OVER (PARTITION BY text)::BIGINT AS first FROM documents)
SELECT CASE WHEN hit THEN 'cached' WHEN first%31=0 THEN 'ValueError' ELSE 'fresh' END AS outcome, count(*)::BIGINT AS n, round(sum(CASE WHEN hit THEN 0.25e0 WHEN first%31=0 THEN 0 ELSE (length(text)%97)/96e0 END),6) AS total FROM d GROUP BY 1""")
def scored_with_cache(spark, sf):
    """A user scorer over whole texts: equal texts are scored once, cached ones are reused, failures become rows."""
    d = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.length("text").alias("n"), F.sha2("text", 256).alias("sha256"))
    cache = d.filter("CAST(sample_id AS BIGINT) % 2 = 0").select(F.concat_ws(":", F.lit("len"), "sha256").alias("cache_key"), F.lit(0.25).alias("score"))
    scores, _, failures = stores.score_with_cache(d, cache, "len", _length_scorer)
    rows = scores.select(F.when(F.col("cached"), "cached").otherwise("fresh").alias("outcome"), "score").unionByName(failures.select(F.col("error_type").alias("outcome"), F.lit(0.0).alias("score")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("resume_anti_join", "SELECT event_id, value FROM events WHERE event_id%3<>0")
def resume_anti_join(spark, sf):
    e = B.table(spark, sf, "events")
    return stores.unscored(e, e.filter("event_id % 3 = 0"), "event_id").select("event_id", "value")


@query("last_write_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1,2")
def last_write_wins(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return Q.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"], last=True).select("user_id", "event_type", "event_id", "value")


# --- predictions, templates, leaks --------------------------------------------------------

TEMPLATE_ROWS = {"pos": "o_orderkey", "ID": "concat('T', CAST(o_orderkey AS STRING))"}
PRED_ROWS = {"pos": "o_orderkey", "ID": "CASE WHEN o_orderkey % 300 = 7 THEN concat('T', CAST(o_orderkey - 1 AS STRING)) ELSE concat('T', CAST(o_orderkey AS STRING)) END",
             **{c: "CASE WHEN o_orderkey % 211 = 5 THEN 'abc' WHEN o_orderkey % 223 = 6 THEN '1.5' WHEN o_orderkey % 227 = 8 THEN 'NaN' ELSE '0.25' END" if i == 0 else "'0.5'" for i, c in enumerate(PREDICTION_COLUMNS)}}


@query("prediction_violations", f"""WITH {cte('p', 'orders', PRED_ROWS)}, {cte('t', 'orders', TEMPLATE_ROWS)}
SELECT p.pos, 'id or order differs from the template' AS rule FROM p JOIN t USING (pos) WHERE p.ID<>t.ID
UNION ALL SELECT pos, 'FILE_FAKE_PROB is not numeric' FROM p WHERE FILE_FAKE_PROB='abc' UNION ALL SELECT pos, 'FILE_FAKE_PROB is out of range' FROM p WHERE FILE_FAKE_PROB IN ('1.5','NaN')
UNION ALL SELECT pos, 'duplicate id' FROM (SELECT pos, min(pos) OVER (PARTITION BY ID) AS f FROM p) WHERE pos>f""")
def prediction_violations(spark, sf):
    return Q.prediction_violations(bound(spark, sf, "orders", PRED_ROWS), bound(spark, sf, "orders", TEMPLATE_ROWS))


@query("template_alignment", "SELECT 'T' || o_orderkey AS ID, CASE WHEN o_orderkey%10=0 THEN 'missing' ELSE 'extra' END AS rule FROM orders WHERE o_orderkey%10=0 OR o_orderkey%77=1")
def template_alignment(spark, sf):
    """Template CSV written and read back, aligned with the files found."""
    t = bound(spark, sf, "orders", TEMPLATE_ROWS).filter("NOT (pos % 77 = 1 AND pos % 10 <> 0)")
    path = scratch_path(spark, "template")
    sinks.write_predictions(t.select("pos", "ID", *[F.lit(0.5).alias(c) for c in PREDICTION_COLUMNS]), path)
    back = MF.template(spark, path)
    found = bound(spark, sf, "orders", TEMPLATE_ROWS).filter("pos % 10 <> 0").select("ID")
    return Q.align(back.select("pos", "ID"), found)[1]


@query("ordered_predictions", f"""WITH {cte('t', 'orders', TEMPLATE_ROWS)} SELECT row_number() OVER (ORDER BY pos)::BIGINT AS pos, ID, round((pos % 7) / 7e0, 6)::VARCHAR AS FILE_FAKE_PROB FROM t""")
def ordered_predictions(spark, sf):
    """Predictions exported as one file in template order, read back as a plain template: the row's number is its position."""
    t = bound(spark, sf, "orders", TEMPLATE_ROWS)
    value = F.round(F.col("pos") % 7 / F.lit(7.0), 6)
    path = scratch_path(spark, "export") + "/predictions.csv"
    sinks.export_predictions(t.select("pos", "ID", *[value.alias(c) for c in PREDICTION_COLUMNS]), path)
    return MF.template(spark, path).select("pos", "ID", "FILE_FAKE_PROB")


def _cache_rows(spark, sf):
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    parents = F.when(k % 21 == 3, F.lit("[]")).otherwise(F.concat(F.lit('[{"sha256":"p'), s(F.floor(k / 3)), F.lit('"}]')))
    prov = F.to_json(F.struct(F.when(k % 17 == 2, " ").otherwise(F.concat(F.lit("spk"), s(k % 200))).alias("speaker"), F.concat(F.lit("c"), s(F.floor(k / 2))).alias("content_id"),
                              parents.alias("parents_json"), F.col("lang").alias("music_generator")))
    return B.table(spark, sf, "documents").select(
        s(k).alias("sample_id"), s(k % 100).alias("grp"), F.when(k % 33 == 1, "failed").otherwise("ok").alias("status"), F.when(k % 35 == 1, '["x"]').otherwise("[]").alias("fallbacks_json"),
        F.lit("[]").alias("errors_json"), F.when(k % 39 == 2, None).otherwise((k % 2).cast("int")).alias("file_fake"), prov.alias("provenance_json"),
        F.md5("text").alias("audio_sha256"), F.lit("pipe").alias("pipeline_fingerprint"), "doc_id", "source")


@query("cache_row_violations", """SELECT doc_id::VARCHAR AS sample_id, 'status is not ok' AS rule FROM documents WHERE doc_id%33=1 UNION ALL SELECT doc_id::VARCHAR, 'fallbacks used' FROM documents WHERE doc_id%35=1
UNION ALL SELECT doc_id::VARCHAR, 'label is not binary' FROM documents WHERE doc_id%39=2 UNION ALL SELECT doc_id::VARCHAR, 'missing speaker' FROM documents WHERE doc_id%17=2
UNION ALL SELECT doc_id::VARCHAR, 'parent hashes required' FROM documents WHERE doc_id%21=3""")
def cache_row_violations(spark, sf):
    return Q.cache_row_violations(_cache_rows(spark, sf))


_IDS = """ids AS (SELECT doc_id, doc_id%100 AS grp, unnest(['speaker','content_id','parent_sha256','audio_sha256','sample_id','group']) AS kind,
 unnest([CASE WHEN doc_id%17=2 THEN ' ' ELSE 'spk' || doc_id%200 END, 'c' || doc_id//2, CASE WHEN doc_id%21=3 THEN NULL ELSE 'p' || doc_id//3 END, md5(text), doc_id::VARCHAR, (doc_id%100)::VARCHAR]) AS value FROM documents)"""


@query("identity_owners", f"WITH {_IDS} SELECT kind, value FROM ids WHERE value IS NOT NULL AND kind NOT IN ('sample_id','group') GROUP BY 1,2 HAVING count(DISTINCT grp)>1")
def identity_owners(spark, sf):
    return Q.ownership_violations(Q.identity_table(_cache_rows(spark, sf)))


@query("identity_leaks", f"""WITH {_IDS}, u AS (SELECT doc_id, kind, value FROM ids WHERE value IS NOT NULL UNION ALL SELECT doc_id, 'all_audio_content', value FROM ids WHERE value IS NOT NULL AND kind IN ('parent_sha256','audio_sha256')),
g AS (SELECT kind, value, bool_or(doc_id%5<>0) AS d, bool_or(doc_id%5=0) AS v FROM u GROUP BY 1,2)
SELECT kind, sum(d::INT)::BIGINT AS development, sum(v::INT)::BIGINT AS validation, sum((d AND v)::INT)::BIGINT AS overlap FROM g GROUP BY 1""")
def identity_leaks(spark, sf):
    c = _cache_rows(spark, sf)
    return Q.split_overlap(Q.identity_table(c.filter("doc_id % 5 <> 0")), Q.identity_table(c.filter("doc_id % 5 = 0")))


@query("benchmark_leaks", "SELECT DISTINCT d.doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d JOIN (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark) b USING (line)")
def benchmark_leaks(spark, sf):
    """Token leak check with whole lines as tokens: documents sharing one with the benchmark."""
    d = B.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\u0001")).alias("g"))
    b = B.table(spark, sf, "benchmark").select(F.replace("text", F.lit("\n"), F.lit("\u0001")).alias("g"))
    return Q.token_leaks(d.select("doc_id", F.replace(F.replace("g", F.lit("|"), F.lit("\u0002")), F.lit("\u0001"), F.lit("|")).alias("g")),
                         b.select(F.replace(F.replace("g", F.lit("|"), F.lit("\u0002")), F.lit("\u0001"), F.lit("|")).alias("g")), "doc_id", "g")


@query("first_manifest_wins", "SELECT md5(text) AS sha256, arg_min(source, (source, doc_id)) AS source, min(doc_id) FILTER (WHERE true) AS any_doc FROM documents GROUP BY 1")
def first_manifest_wins(spark, sf):
    d = B.table(spark, sf, "documents").select(F.md5("text").alias("sha256"), "source", "doc_id")
    first = Q.first_wins(d, ["sha256"], ["source", "doc_id"]).select("sha256", "source")
    return first.join(d.groupBy("sha256").agg(F.min("doc_id").alias("any_doc")), "sha256")


@query("label_lookup_coverage", "SELECT source, count(*)::BIGINT AS n, count(quality)::BIGINT AS covered, sum((quality=1)::INT)::BIGINT AS fakes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def label_lookup_coverage(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source").join(B.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("covered"), F.sum((F.col("quality") == 1).cast("int")).alias("fakes"))


@query("id_differences", "SELECT doc_id, 'unlabelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_differences(spark, sf):
    d, y = B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels").select("doc_id")
    return d.join(y, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).unionByName(y.join(d, "doc_id", "left_anti").withColumn("side", F.lit("orphan")))


@query("render_groups", """SELECT o_orderkey AS id, concat_ws('|', c1.c_mktsegment, c2.c_name, CASE WHEN o_orderkey%3=0 THEN c3.c_name END) AS grp FROM orders
JOIN customer c1 ON c1.c_custkey=o_custkey JOIN customer c2 ON c2.c_custkey=(o_custkey*7)%(SELECT count(*) FROM customer) LEFT JOIN customer c3 ON c3.c_custkey=o_orderkey%(SELECT count(*) FROM customer)""")
def render_groups(spark, sf):
    """Group label of a render from up to three source ids."""
    c = B.table(spark, sf, "customer")
    from ..operators.prefix import attach

    o = attach(B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), c.agg(F.count(F.lit(1)).alias("n")), [])
    look = lambda k, v: c.select(F.col("c_custkey").alias(k), F.col("c_mktsegment" if v == "g1" else "c_name").alias(v))
    o = o.withColumn("k1", F.col("o_custkey")).withColumn("k2", F.col("o_custkey") * 7 % F.col("n")).withColumn("k3", F.col("id") % F.col("n"))
    o = o.join(look("k1", "g1"), "k1").join(look("k2", "g2"), "k2").join(look("k3", "g3"), "k3", "left")
    return o.select("id", F.concat_ws("|", "g1", "g2", F.when(F.col("id") % 3 == 0, F.col("g3"))).alias("grp"))
