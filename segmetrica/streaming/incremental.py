"""Incremental scoring, last-write-wins state, running pooling and metric drift."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import first_wins
from ..session import complete, folders, remove


def _run_id(checkpoint: str) -> str:
    """The same for every restart from one checkpoint."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _scored(spark: SparkSession, table: str, skip: str | None = None) -> list[str]:
    """Committed batch folders of a score table."""
    found = (f"{table}/{r}/{b}" for r in folders(spark, table) for b in folders(spark, f"{table}/{r}"))
    return [p for p in found if p != skip and complete(spark, p)]


def read_scores(spark: SparkSession, table: str, schema=None, skip: str | None = None) -> DataFrame:
    """All scored rows; without a committed batch an empty table, for which a schema is needed."""
    paths = _scored(spark, table, skip)
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)


def score_new(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, order: Sequence[str] = ()):
    """Score only rows whose key is not in the score table yet; of rows with one key in a batch the first by ``order``.

    A batch writes the folder run=<checkpoint>/batch=<number>, and asks all other committed folders, of this and
    of earlier runs, which keys are done. So a batch retried after its write finds its own rows undone and writes
    the same folder again, and a new checkpoint on an existing table scores nothing twice. ``order`` defaults to
    all other columns. Rows without a key are scored once.
    """
    run = _run_id(checkpoint)

    def batch(df: DataFrame, epoch: int) -> None:
        spark, own = df.sparkSession, f"{table}/run={run}/batch={epoch}"
        todo = first_wins(df, [key], list(order) or [c for c in df.columns if c != key]).select(*df.columns)
        done = read_scores(spark, table, score(df.limit(0)).schema, own).select(F.col(key).alias("_done"))
        score(todo.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")).write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str, int, str]]:
    """(version, run, batch, folder) of all committed versions, oldest first."""
    found = []
    for name in folders(spark, table):
        number, run, epoch = name.removeprefix("v=").split("-")
        if complete(spark, f"{table}/{name}"):
            found.append((int(number), run, int(epoch), name))
    return sorted(found)


def _newest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[str]]:
    """Folders that hold each part of the state, newest first."""
    held: dict[int, list[str]] = {}
    for number, _, _, name in reversed(_versions(spark, table)):
        if before is None or number < before:
            for part in folders(spark, f"{table}/{name}"):
                held.setdefault(int(part.removeprefix("part=")), []).append(f"{table}/{name}/{part}")
    return held


def read_latest(spark: SparkSession, table: str, schema) -> DataFrame:
    """The current state: the newest version of every part."""
    paths = [p[0] for p in _newest(spark, table).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def last_write_wins(stream: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, parts: int = 64):
    """Latest row per key. The state is cut into parts by a hash of the keys; a batch rewrites only parts it touches.

    A batch writes one version folder from the newest older version of each touched part. Repeated after a failure
    it takes the same version number and the same older parts. A new checkpoint goes on with the next number. Parts
    older than the one a retry would need are removed. Only a table that doesn't exist counts as empty; any other
    read error is raised. Needs the same ``parts`` for the table's whole life.
    """
    run = _run_id(checkpoint)

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        new.persist()
        try:
            touched = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
            if not touched:
                return
            known = _versions(spark, table)
            number = next((n for n, r, e, _ in known if (r, e) == (run, epoch)), max((n for n, *_ in known), default=-1) + 1)
            held = _newest(spark, table, number)
            old = [held[p][0] for p in touched if p in held]
            merged = new
            if old:
                kept = spark.read.schema(df.schema).parquet(*old)
                merged = new.unionByName(kept.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
            out = first_wins(merged, keys, order, last=True).select(*df.columns, "part")
            out.write.mode("overwrite").partitionBy("part").parquet(f"{table}/v={number}-{run}-{epoch}")
            for p in touched:
                for path in held.get(p, [])[1:]:
                    remove(spark, path)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_pool(stream: DataFrame, key: str, score: str) -> DataFrame:
    """Max and mean so far per file (update mode)."""
    return stream.groupBy(key).agg(F.max(score).alias("p_max"), F.sum(score).alias("total"), F.count(score).alias("n"))


SPAN = 32.0  # logits over tau that share a scale


def running_smooth_max(stream: DataFrame, key: str, z: str, tau: float = 1.0) -> DataFrame:
    """Sums of smooth-max pooling so far per file (update mode): (key, part, total, n, known), for ``smooth_max``.

    A file has a row for each span of SPAN its logits lie in, with the sum of exp(z / tau) in that span's scale, so no sum
    overflows or vanishes and plain aggregates keep the state. n counts rows, known those with a logit.
    """
    x = F.col(z) / F.lit(float(tau))
    rows = stream.select(key, x.alias("_x"), F.floor(x / SPAN).alias("part"))
    return rows.groupBy(key, "part").agg(
        F.sum(F.exp(F.col("_x") - F.col("part") * SPAN)).alias("total"), F.count(F.lit(1)).alias("n"), F.count("_x").alias("known"))


def smooth_max(sums: DataFrame, key: str, tau: float = 1.0) -> DataFrame:
    """(key, pooled, n) from the newest rows of ``running_smooth_max``."""
    top = sums.groupBy(key).agg(F.max("part").alias("_top"), F.collect_list(F.struct("part", "total")).alias("_parts"),
                                F.sum("n").alias("n"), F.sum("known").alias("_known"))
    scaled = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + F.coalesce(p["total"] * F.exp((p["part"] - F.col("_top")) * SPAN), F.lit(0.0)))
    pooled = F.lit(float(tau)) * (F.log(scaled / F.col("_known")) + F.col("_top") * SPAN)
    return top.select(key, F.when(F.col("_known") > 0, pooled).alias("pooled"), "n")


def drift(stream: DataFrame, ts: str, score, fake, width: str = "1 day", hop: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Score mean and fake rate per sliding event-time window."""
    return (
        stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
        .groupBy(F.window("_ts", width, hop).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(fake.cast("double")).alias("fake_rate"))
    )
