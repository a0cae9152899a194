"""Resumable stores: JSON lines with later-line-wins, and a keyed score cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import first_wins
from ..schemas import RECORD, REQUIRED_RECORD_FIELDS
from ..session import scratch_path

KEY = ["config_fingerprint", "audio_sha256"]


def parse_records(lines: DataFrame, schema: str = RECORD, required=REQUIRED_RECORD_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(records, one-row corrupt count) from JSON text in ``value``."""
    text = lines.filter(F.trim("value") != "")
    fields = F.json_object_keys("value")
    complete = F.coalesce(F.array_size(F.array_intersect(fields, F.array(*[F.lit(k) for k in required]))) == len(required), F.lit(False))
    parsed = text.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), complete.alias("ok"))
    good = F.col("ok") & F.col("r._bad").isNull()
    return (
        parsed.filter(good).select("r.*").drop("_bad"),
        parsed.agg(F.sum(F.when(good, 0).otherwise(1)).alias("corrupt_lines")),
    )


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records, one per key; the largest seq wins (text files carry no row number)."""
    records, corrupt = parse_records(spark.read.text(path))
    return first_wins(records, KEY, ["seq"], last=True), corrupt


def append(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """One line per key into a new path; readers switch to it when it is complete."""
    records, _ = load_store(spark, path)
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(target)


def cache_split(rows: DataFrame, cache: DataFrame, detector: str) -> tuple[DataFrame, DataFrame]:
    """(hits with score, misses) for rows with a sha256 column; cache(cache_key, score).

    One left join serves both. The cache counts once a key, whatever it holds twice (the smallest score).
    """
    keyed = rows.withColumn("cache_key", F.concat_ws(":", F.lit(detector), F.col("sha256")))
    once = cache.groupBy("cache_key").agg(F.min("score").alias("score"), F.lit(True).alias("_hit"))
    found = keyed.join(once, "cache_key", "left")
    return found.filter("_hit").drop("_hit"), found.filter("_hit IS NULL").drop("_hit", "score")


def unscored(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


RESULT = "cache_key string, sample_id string, score double, seconds double, error_type string, message string"


def run_scorer(rows: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """Score rows with a user function, model built once per task; a failed row is recorded.

    ``make_scorer`` returns a function of a whole Arrow batch. If a batch raises, its rows are
    tried one by one so that one bad file does not fail its neighbours.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        scorer = None
        for pdf in batches:
            if scorer is None:
                scorer = make_scorer()
            started = time.perf_counter()
            out = pdf[["cache_key", "sample_id"]].copy()
            out["error_type"] = out["message"] = None
            try:
                out["score"] = pd.Series(scorer(pdf)).to_numpy(dtype=float)
            except Exception:  # noqa: BLE001
                values, kinds, texts = [], [], []
                for i in range(len(pdf)):
                    try:
                        values.append(float(scorer(pdf.iloc[[i]]).iloc[0]))
                        kinds.append(None)
                        texts.append(None)
                    except Exception as e:  # noqa: BLE001
                        values.append(float("nan"))
                        kinds.append(type(e).__name__)
                        texts.append(str(e))
                out["score"], out["error_type"], out["message"] = values, kinds, texts
            bad = ~pd.Series(out["score"]).map(lambda v: v == v and abs(v) != float("inf")).to_numpy()
            out.loc[bad & out["error_type"].isna().to_numpy(), ["error_type", "message"]] = ["ScoringFailure", "score is not finite"]
            out.loc[bad, "score"] = None
            out["seconds"] = (time.perf_counter() - started) / max(len(pdf), 1)
            yield out[["cache_key", "sample_id", "score", "seconds", "error_type", "message"]]

    return rows.mapInPandas(work, RESULT)


def score_with_cache(rows: DataFrame, cache: DataFrame, detector: str, make_scorer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, new cache rows, failures). Each missing key is scored once, for its smallest sample_id, written once,
    and given to all rows of that key; the new cache rows have every key once."""
    hits, misses = cache_split(rows, cache, detector)
    path = scratch_path(rows.sparkSession, "scored")
    run_scorer(first_wins(misses, ["cache_key"], ["sample_id"]).select(*misses.columns), make_scorer).write.parquet(path)
    fresh = rows.sparkSession.read.schema(RESULT).parquet(path)
    ok = fresh.filter("score IS NOT NULL").select("cache_key", "score")
    given = misses.select("cache_key", "sample_id").join(fresh.drop("sample_id"), "cache_key")
    scores = hits.select("sample_id", "score", F.lit(True).alias("cached")).unionByName(
        given.filter("score IS NOT NULL").select("sample_id", "score", F.lit(False).alias("cached")))
    return scores, ok, given.filter("score IS NULL").select("sample_id", "error_type", "message")
