"""Readers of manifests, pairings, templates, ledgers, checksums and audio folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import AUDIO_EXTENSIONS, known, parse_label, parse_training_label
from ..operators.prefix import accumulate
from ..operators.quality import duplicates, first_wins
from ..session import materialize
from ..schemas import LEDGER
from .lines import read_records

# Fixed candidate columns of training manifests.
PATH_COLUMNS = ("path", "relative_path", "file", "audio_path")
LABEL_CANDIDATES = ("label", "voice_fake", "file_fake")
GROUP_COLUMNS = ("group", "speaker_id", "speaker", "content_id")
META_COLUMNS = ("system", "channel", "source")


def read_csv(spark: SparkSession, path: str, schema=None, row: str | None = None) -> DataFrame:
    """CSV of strings with a header; a byte order mark is tolerated, files are split whatever they hold.

    ``row`` adds the number of each record in its file, the header being 1.
    """
    return read_records(spark, path, schema, row)


def manifest_rows(df: DataFrame, columns: Mapping[str, str] | None = None, root: str = "", row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a manifest whose columns may be renamed.

    df carries a row number; absolute paths win over relative ones; missing metadata
    becomes 'unknown'.
    """
    names = dict(rel_path="rel_path", audio_path="audio_path", label="label", content_group="content_group",
                 generator_family="generator_family", license="license", transform="transform")
    names.update(columns or {})
    has = lambda c: names[c] in df.columns
    if not (has("rel_path") or has("audio_path")) or not has("label"):
        raise ValueError("manifest needs a label and a path column")
    text = lambda c: F.trim(F.coalesce(F.col(names[c]), F.lit(""))) if has(c) else F.lit("")
    rel = F.replace(text("rel_path"), F.lit("\\"), F.lit("/"))
    absolute = text("audio_path")
    path = F.when(absolute != "", absolute).when(rel != "", F.concat(F.lit(root.rstrip("/") + "/" if root else ""), rel))
    meta = lambda c: known(F.col(names[c])) if has(c) else F.lit("unknown")
    d = df.select(
        row, F.when(rel != "", rel).otherwise(path).alias("sample_id"), path.alias("audio_path"), parse_label(F.col(names["label"])).alias("label"),
        *[meta(c).alias(c) for c in ("content_group", "generator_family", "license", "transform")],
        (rel.rlike(r"(^|/)\.\.(/|$)") & (absolute == "")).alias("_unsafe"),
    )
    rules = F.array(F.when(F.col("audio_path").isNull(), "no audio path"), F.when(F.col("_unsafe"), "unsafe rel_path"), F.when(F.col("label").isNull(), "unknown label"))
    bad = d.select(row, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    bad = bad.unionByName(duplicates(d.filter("sample_id IS NOT NULL"), "sample_id", row, "duplicate sample"))
    good = d.filter(F.col("audio_path").isNotNull() & ~F.col("_unsafe") & F.col("label").isNotNull()).drop("_unsafe")
    return good, bad


def training_rows(df: DataFrame, tag: str, root: str = "") -> DataFrame:
    """Training manifest: first existing candidate column of each kind; groups prefixed by the tag."""
    def pick(candidates: Sequence[str], needed: bool = True) -> str | None:
        found = next((c for c in candidates if c in df.columns), None)
        if found is None and needed:
            raise ValueError(f"manifest lacks one of {candidates}")
        return found

    p, y, g = pick(PATH_COLUMNS), pick(LABEL_CANDIDATES), pick(GROUP_COLUMNS, needed=False)
    path = F.when(F.col(p).startswith("/"), F.col(p)).otherwise(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col(p)))
    stem = F.regexp_replace(F.element_at(F.split(F.col(p), "/"), -1), r"(.)\.[^.]*$", "$1")
    group = F.coalesce(F.nullif(F.col(g), F.lit("")), stem) if g else stem
    weight = F.coalesce(F.nullif(F.col("weight"), F.lit("")).try_cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    sha = F.nullif(F.lower(F.trim("sha256")), F.lit("")) if "sha256" in df.columns else F.lit(None).cast("string")
    meta = [x for c in META_COLUMNS if c in df.columns for x in (F.lit(c), F.col(c))]
    return df.select(
        path.alias("path"), parse_training_label(F.col(y)).alias("label"), F.concat_ws(":", F.lit(tag), group).alias("group"),
        weight.alias("weight"), sha.alias("sha256"), (F.create_map(*meta) if meta else F.create_map().cast("map<string,string>")).alias("meta"),
    )


def pairings(df: DataFrame, subset: str | None = "small", row: str = "row") -> DataFrame:
    """Pairing rows of a subset, the first row per track id."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    d = df if subset is None else df.filter(t("subset") == subset)
    d = d.withColumn("track_id", F.trim("track_id").try_cast("bigint")).withColumn("duration", F.nullif(t("duration"), F.lit("")).try_cast("double"))
    d = d.filter("track_id IS NOT NULL")
    return first_wins(d, ["track_id"], [row]).drop(row)


def licence_index(df: DataFrame, wanted: DataFrame, row: str = "row") -> DataFrame:
    """Licence facts of wanted ids only; a later row replaces an earlier one."""
    d = df.withColumn("track_id", F.when(F.trim("track_id").rlike("^[0-9]+$"), F.trim("track_id").cast("bigint")))
    return first_wins(d.join(wanted.select("track_id"), "track_id", "left_semi"), ["track_id"], [row], last=True).drop(row)


def paired_fakes(df: DataFrame, originals: DataFrame) -> DataFrame:
    """Fakes of wanted originals with their position in path order.

    Positions are counted in two levels over ranges of the paths found in the data, so an original with very many
    fakes is shared by many tasks and nothing is collected.
    """
    d = df.withColumn("original_audio", F.trim("original_audio")).join(originals.select("original_audio").distinct(), "original_audio", "left_semi")
    d = materialize(d.repartitionByRange("original_audio", "path_in_dataset").withColumn("_range", F.spark_partition_id()), "fakes")
    d = accumulate(d.withColumn("_one", F.lit(1)), ["original_audio"], [F.col("path_in_dataset").asc()], F.col("_range"), ["_one"], descending=False).drop("_range")
    return d.withColumn("pos", F.col("_one_cum")).drop("_one", "_one_cum", "_one_all")


def template(spark: SparkSession, path: str) -> DataFrame:
    """Submission template in its own order: pos is the column of that name, or the number of the row in the file."""
    df = read_csv(spark, path, row="_row")
    pos = F.col("pos").cast("long") if "pos" in df.columns else F.col("_row") - 1
    return df.withColumn("ID", F.trim("ID")).withColumn("pos", pos).drop("_row")


def template_violations(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.trim("ID"), F.lit("")) == "").select("pos", F.lit("empty id").alias("rule")).unionByName(
        duplicates(df, "ID", "pos", "duplicate id"))


def ledger(df: DataFrame) -> DataFrame:
    """Typed ledger; dates may be the text 'not recorded'."""
    return df.select(
        "*", F.try_to_date(F.col("date_kst"), "yyyy-MM-dd").alias("day"), *[F.col(c).try_cast("double").alias(f"{c}_value") for c in ("score", "ads", "cps")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return ledger(read_csv(spark, path, LEDGER))


def audio_files(spark: SparkSession, folder: str, content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, violations): supported extensions in any case, id = stem, ids unique."""
    d = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    d = d.withColumn("ext", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).withColumn("file_id", F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))
    d = d.filter(F.col("ext").isin(*AUDIO_EXTENSIONS)).select("file_id", "path", "ext", "length", *(["content"] if content else []))
    return d, duplicates(d, "file_id", "path", "duplicate audio id")


def with_digest(df: DataFrame) -> DataFrame:
    return df.withColumn("sha256", F.sha2("content", 256))


def checksums(lines: DataFrame, prefix: str) -> DataFrame:
    """'digest  path' lines to (member, digest)."""
    parts = F.split(F.col("value"), "  ", 2)
    digest, path = F.lower(F.trim(F.get(parts, F.lit(0)))), F.trim(F.get(parts, F.lit(1)))
    return lines.select(F.concat(F.lit(prefix + "/"), path).alias("member"), digest.alias("digest")).filter("member IS NOT NULL AND digest <> ''")


def real_rows(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Manifest rows of genuine originals: pairing + licence + file facts."""
    from ..functions.labels import content_group, licence

    c = F.col
    d = pairs.join(facts, "track_id").withColumn("lic", licence(F.coalesce(F.nullif(c("license_title"), F.lit("")), c("license")), c("license_url")))
    artist = F.coalesce(F.nullif(c("artist_name"), F.lit("")), F.nullif(c("artist"), F.lit("")), F.lit("unknown artist"))
    title = F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("untitled"))
    return d.filter("lic.license_id IS NOT NULL").select(
        F.format_string("fma-%06d-original", c("track_id")).alias("sample_id"), F.lower("sha256").alias("sha256"),
        c("lic.license_id").alias("license_id"), c("lic.license_url").alias("license_url"),
        c("lic.derivatives_allowed").alias("derivatives_allowed"), F.format_string("%s - %s (%s), licensed %s", artist, title, c("track_url"), c("lic.license_id")).alias("attribution"),
        F.lit("0").alias("file_fake"), F.lit("").alias("parent_sha256"), content_group(c("track_id")).alias("content_id"), c("original_audio"))


def fake_rows(reals: DataFrame, fakes: DataFrame) -> DataFrame:
    """Manifest rows of fakes; the real's hash is carried only where generation used its audio."""
    from ..functions.labels import slug

    c = F.col
    kind = F.upper(F.trim("type"))
    stem = F.regexp_extract(c("path_in_dataset"), r"([^/]+?)(\.[^./]*)?$", 1)
    return fakes.join(reals.select("original_audio", F.col("sha256").alias("real_sha256"), "content_id"), "original_audio").select(
        F.concat(F.lit("echoes-"), slug(stem)).alias("sample_id"), F.trim("generator").alias("generator_family"), kind.alias("generation_type"),
        F.when(kind == "ATA", "audio-and-text").otherwise("text-only").alias("conditioning"),
        F.when(kind == "ATA", c("real_sha256")).otherwise("").alias("parent_sha256"), "content_id", F.lit("1").alias("file_fake"))
