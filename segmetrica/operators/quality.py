"""Rules over manifests, predictions and cached scores, and leak checks between splits.

Every check returns violation rows; nothing raises on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..schemas import LABEL_COLUMNS, MANIFEST_COLUMNS, PREDICTION_COLUMNS

REQUIRED_TEXT = ("source_dataset", "source_version", "source_url", "license_id", "license_url", "attribution")


def _rules(df: DataFrame, keys: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    hit = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(hit).alias("rule"))


def duplicates(df: DataFrame, column: str, row: str, rule: str) -> DataFrame:
    """Rows after the first one with the same value; grouped counts, no window over a hot value."""
    first = df.groupBy(column).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return df.join(first, column).filter(F.col(row) > F.col("_first")).select(row, F.lit(rule).alias("rule"))


def manifest_violations(df: DataFrame, row: str = "row") -> DataFrame:
    """(row, rule) of a manifest of strings."""
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    d = df.withColumn("_path", F.replace(t("relative_path"), F.lit("\\"), F.lit("/"))).withColumn("_id", t("sample_id"))
    flag = lambda c: F.lower(t(c))
    steps = F.coalesce(F.nullif(t("transformations_json"), F.lit("")), F.lit("[]"))
    parsed = F.from_json(steps, "array<string>")
    is_list = steps.rlike(r"^\s*\[") & F.json_array_length(steps).isNotNull()
    known = sum((F.when(t(c) != "", 1).otherwise(0) for c in LABEL_COLUMNS), F.lit(0))
    rules = [
        F.when(F.col("_id") == "", "empty sample_id"),
        F.when((F.col("_path") == "") | F.col("_path").rlike(r"(^|/)\.\.(/|$)"), "unsafe relative_path"),
        F.when(~flag("redistribution_allowed").isin("true", "false"), "redistribution_allowed is not true or false"),
        F.when(flag("redistribution_allowed") == "false", "not deliverable"),
        F.when(~flag("derivatives_allowed").isin("true", "false"), "derivatives_allowed is not true or false"),
        *[F.when(t(c) == "", f"{c} is required") for c in REQUIRED_TEXT],
        *[F.when(~t(c).isin("", "0", "1"), f"{c} must be empty, 0 or 1") for c in LABEL_COLUMNS],
        F.when(known == 0, "no known label"),
        F.when(~is_list | parsed.isNull(), "transformations_json is not a list"),
        F.when(is_list & (F.json_array_length(steps) > 0) & (flag("derivatives_allowed") == "false"), "transformed without permission"),
        F.when(~F.lower(t("sha256")).rlike("^[0-9a-f]{64}$"), "sha256 is invalid"),
    ]
    return (
        _rules(d, [row], rules)
        .unionByName(duplicates(d.filter("_id <> ''"), "_id", row, "duplicate sample_id"))
        .unionByName(duplicates(d.filter("_path <> ''"), "_path", row, "duplicate relative_path"))
    )


def hash_mismatches(manifest: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """Rows whose stored digest is not the content digest."""
    return manifest.join(digests.withColumnRenamed("sha256", "_actual"), key).filter(
        F.lower(F.trim("sha256")) != F.col("_actual")).select(key, "sha256", F.col("_actual").alias("actual"))


def prediction_violations(pred: DataFrame, template: DataFrame) -> DataFrame:
    """(pos, rule): ids and order as the template, ids unique, probabilities finite and in range.

    Both carry pos; prediction values are strings as read from CSV.
    """
    t = template.select("pos", F.col("ID").alias("_want"))
    j = pred.join(t, "pos", "full")
    rules = [F.when(~F.col("ID").eqNullSafe(F.col("_want")), "id or order differs from the template")]
    for c in PREDICTION_COLUMNS:
        v = F.col(c).try_cast("double")
        rules.append(F.when(F.col("ID").isNotNull() & v.isNull(), f"{c} is not numeric"))
        rules.append(F.when(v.isNotNull() & ~A.is_probability(v), f"{c} is out of range"))
    return _rules(j, ["pos"], rules).unionByName(duplicates(pred, "ID", "pos", "duplicate id"))


def align(template: DataFrame, found: DataFrame, key: str = "ID") -> tuple[DataFrame, DataFrame]:
    """(rows in template order, missing/extra ids)."""
    j = template.join(found.withColumn("_found", F.lit(True)), key, "full")
    problems = j.filter(F.col("pos").isNull() | F.col("_found").isNull()).select(
        key, F.when(F.col("pos").isNull(), "extra").otherwise("missing").alias("rule"))
    return j.filter(F.col("pos").isNotNull() & F.col("_found").isNotNull()).drop("_found").orderBy("pos"), problems


PROVENANCE = "struct<speaker:string,content_id:string,parents_json:string,music_generator:string>"
PARENTS = "array<struct<sha256:string>>"


def with_provenance(df: DataFrame) -> DataFrame:
    """Parse the JSON text and the JSON text inside it."""
    d = df.withColumn("prov", F.from_json("provenance_json", PROVENANCE))
    return d.withColumn("parents", F.from_json(F.col("prov.parents_json"), PARENTS))


def cache_row_violations(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Health of cached score rows."""
    d = with_provenance(df)
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    empty_list = lambda c: F.coalesce(F.json_array_length(F.col(c)), F.lit(-1)) == 0
    parents = F.coalesce(F.size("parents"), F.lit(0))
    return _rules(d, [key], [
        F.when(~F.col("status").eqNullSafe("ok"), "status is not ok"),
        F.when(~empty_list("fallbacks_json"), "fallbacks used"),
        F.when(~empty_list("errors_json"), "errors recorded"),
        F.when(F.col("file_fake").isNull() | ~F.col("file_fake").cast("string").isin("0", "1"), "label is not binary"),
        F.when(blank("prov.speaker"), "missing speaker"),
        F.when(blank("prov.content_id"), "missing content_id"),
        F.when((parents <= 0) | F.exists("parents", lambda p: p["sha256"].isNull() | (p["sha256"] == "")), "parent hashes required"),
        F.when(blank("pipeline_fingerprint"), "missing pipeline identity"),
    ])


def identity_table(df: DataFrame) -> DataFrame:
    """Long (kind, value, grp) table of everything that identifies a source."""
    d = with_provenance(df)
    fixed = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
        for k, c in (("sample_id", "sample_id"), ("group", "grp"), ("speaker", "prov.speaker"), ("content_id", "prov.content_id"),
                     ("audio_sha256", "audio_sha256"), ("pipeline", "pipeline_fingerprint"))
    ])
    parents = F.transform(F.coalesce("parents", F.array().cast(PARENTS)), lambda p: F.struct(F.lit("parent_sha256").alias("kind"), p["sha256"].alias("value")))
    return d.select("grp", F.explode(F.concat(fixed, parents)).alias("i")).select("i.kind", "i.value", F.col("grp").cast("string").alias("grp")).filter("value IS NOT NULL")


OWNED = ("speaker", "content_id", "parent_sha256", "audio_sha256")


def ownership_violations(ids: DataFrame) -> DataFrame:
    """Identities found in more than one group, and mixed pipelines.

    min <> max instead of a distinct count: it combines on the map side.
    """
    owned = ids.filter(F.col("kind").isin(*OWNED)).groupBy("kind", "value").agg(F.min("grp").alias("a"), F.max("grp").alias("b"))
    pipes = ids.filter("kind = 'pipeline'").groupBy("kind").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return owned.filter("a <> b").select("kind", "value").unionByName(
        pipes.filter("a <> b").select("kind", F.lit("mixed").alias("value")))


def split_overlap(dev: DataFrame, val: DataFrame) -> DataFrame:
    """Counts per identity kind: development, validation, overlap; plus pooled audio content."""
    def wide(ids):
        audio = ids.filter(F.col("kind").isin("parent_sha256", "audio_sha256")).withColumn("kind", F.lit("all_audio_content"))
        return ids.filter("kind <> 'pipeline'").unionByName(audio).select("kind", "value").distinct()

    j = wide(dev).withColumn("d", F.lit(1)).join(wide(val).withColumn("v", F.lit(1)), ["kind", "value"], "full")
    return j.groupBy("kind").agg(F.count("d").alias("development"), F.count("v").alias("validation"),
                                 F.sum(F.when(F.col("d").isNotNull() & F.col("v").isNotNull(), 1).otherwise(0)).alias("overlap"))


def token_leaks(train: DataFrame, held: DataFrame, key: str = "id", group: str = "grp") -> DataFrame:
    """Train items sharing a source token with held-out items."""
    tokens = held.select(F.explode(F.split(F.col(group), r"\|")).alias("token")).distinct()
    return train.select(key, F.explode(F.split(F.col(group), r"\|")).alias("token")).join(tokens, "token", "left_semi").select(key).distinct()


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
