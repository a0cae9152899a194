"""Streams that are retried, restarted or fail: no row is lost, none is scored twice."""

import glob
import os
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from segmetrica.session import folders
from segmetrica.sources import stores
from segmetrica.streaming import incremental as R

SCHEMA = "id long, v double"


def source(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def score(df):
    return df.select("id", (F.col("v") * 2).alias("score"))


def forget_last_commit(checkpoint):
    last = max((p for p in glob.glob(f"{checkpoint}/commits/*") if p.rsplit("/", 1)[1].isdigit()), key=lambda p: int(p.rsplit("/", 1)[1]))
    os.replace(last, f"{last}.lost")
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.replace(crc, f"{crc}.lost")


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def scored(spark, table):
    return sorted(map(tuple, R.read_scores(spark, table, "id long, score double").collect()))


def test_a_retried_batch_keeps_its_rows(spark, place):
    source(spark, place + "/in", [(k, float(k)) for k in range(10)])
    source(spark, place + "/in", [(k, float(k)) for k in range(5, 20)])
    R.score_new(stream(spark, place + "/in"), "id", score, place + "/t", place + "/ck").awaitTermination()
    want = [(k, 2.0 * k) for k in range(20)]
    assert scored(spark, place + "/t") == want
    forget_last_commit(place + "/ck")
    R.score_new(stream(spark, place + "/in"), "id", score, place + "/t", place + "/ck").awaitTermination()
    assert scored(spark, place + "/t") == want


def test_a_new_checkpoint_scores_nothing_twice(spark, place):
    source(spark, place + "/in", [(k, float(k)) for k in range(10)])
    R.score_new(stream(spark, place + "/in"), "id", score, place + "/t", place + "/ck").awaitTermination()
    source(spark, place + "/in", [(k, -1.0) for k in range(5, 15)])
    R.score_new(stream(spark, place + "/in"), "id", score, place + "/t", place + "/ck2").awaitTermination()
    got = scored(spark, place + "/t")
    assert [k for k, _ in got] == list(range(15))
    assert {s for k, s in got if k >= 10} == {-2.0}


def test_the_first_row_by_order_is_scored(spark, place):
    source(spark, place + "/in", [(1, 5.0), (1, 3.0), (1, 4.0)])
    R.score_new(stream(spark, place + "/in"), "id", score, place + "/t", place + "/ck", order=["v"]).awaitTermination()
    assert scored(spark, place + "/t") == [(1, 6.0)]


def latest(spark, table):
    return sorted(map(tuple, R.read_latest(spark, table, SCHEMA).collect()))


def test_latest_survives_a_retry_and_a_new_checkpoint(spark, place):
    source(spark, place + "/in", [(k, 1.0) for k in range(10)])
    source(spark, place + "/in", [(k, 2.0) for k in range(3)])
    run = lambda ck: R.last_write_wins(stream(spark, place + "/in"), ["id"], ["v"], place + "/t", place + ck, parts=4).awaitTermination()
    run("/ck")
    want = [(k, 2.0 if k < 3 else 1.0) for k in range(10)]
    assert latest(spark, place + "/t") == want
    forget_last_commit(place + "/ck")
    run("/ck")
    assert latest(spark, place + "/t") == want
    source(spark, place + "/in", [(20, 9.0)])
    run("/ck2")
    assert latest(spark, place + "/t") == [*want, (20, 9.0)]
    assert len({f.split("-")[0] for f in folders(spark, place + "/t")}) == len(folders(spark, place + "/t"))


def test_a_failing_read_is_raised(spark, place):
    source(spark, place + "/in", [(1, 1.0)])
    R.last_write_wins(stream(spark, place + "/in"), ["id"], ["v"], place + "/t", place + "/ck", parts=1).awaitTermination()
    for part in glob.glob(place + "/t/*/part=0/part-*.parquet"):
        with open(part, "wb") as f:
            f.write(b"no parquet")
    for crc in glob.glob(place + "/t/*/part=0/.part-*.crc"):
        os.replace(crc, crc + ".lost")
    source(spark, place + "/in", [(2, 1.0)])
    with pytest.raises(StreamingQueryException):
        R.last_write_wins(stream(spark, place + "/in"), ["id"], ["v"], place + "/t", place + "/ck", parts=1).awaitTermination()


def test_equal_contents_are_scored_once(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 3.0)], "sample_id string, sha256 string, n double")
    none = spark.createDataFrame([], "cache_key string, score double")
    scores, cache, failures = stores.score_with_cache(rows, none, "d", lambda: lambda pdf: pdf["n"])
    assert sorted(map(tuple, scores.select("sample_id", "score").collect())) == [("a", 1.0), ("b", 1.0), ("c", 3.0)]
    assert cache.count() == 2 and failures.count() == 0
    twice = cache.union(cache)
    again, new, _ = stores.score_with_cache(rows, twice, "d", lambda: lambda pdf: pdf["n"])
    assert again.count() == 3 and again.filter("cached").count() == 3 and new.count() == 0
