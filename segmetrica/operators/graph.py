"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch_path

HUB = 1_000  # rows of a key from which on it may be cut into salts
MAX_HUBS = 50_000  # a broadcast table of hubs has at most so many rows


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger end first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def with_least(rows: DataFrame, key: str, value: str, total: int, name: str = "m") -> DataFrame:
    """Adds the least value of each key, without gathering a key that very many rows share.

    Minima and sizes are combined before the shuffle. A key with more rows than HUB, and than its share of ``total`` (at
    least the number of rows) that keeps the list of such keys below MAX_HUBS, is cut into salts: its rows are dealt by a
    hash of their value, and its minimum is copied to each salt. The list of hubs, at most MAX_HUBS rows, is broadcast.
    """
    bound = max(HUB, -(-total // MAX_HUBS))
    facts = rows.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(bound)).cast("int")
    hubs = facts.where(F.col("_n") > bound).select(F.col(key).alias("_hub"), salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hubs), F.col(key) == F.col("_hub"), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(value), F.col("_salts")), F.lit(0)).cast("int"))
    copies = F.when(F.col("_n") > bound, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    least = facts.select(F.col(key).alias("_key"), name, F.explode(copies).alias("_at"))
    return dealt.join(least, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_at"))).select(*rows.columns, name)


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), as (node, root) with root the smallest node reachable.

    Alternates large-star and small-star until the edges stay the same; the number of rounds follows the graph and has
    no cap. The centre of a large star is a hub of ``with_least``, so its edges are shared by many tasks. Each round is
    written to the shared folder and the round before it removed. Nodes without an edge to another node are not returned;
    an empty input gives no rows. Null ends are ignored.
    """
    spark = edges.sparkSession
    now, path = _written(_ordered(edges.select("a", "b")))
    size, seen = now.count(), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = with_least(both, "a", "b", 2 * size).withColumn("m", F.least("a", "m"))
        large = _ordered(star.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small-star keeps the tie of each centre to its least neighbour, and ties the other neighbours to that
        small = with_least(large, "a", "b", 2 * size)
        ties = small.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after, old = _written(_ordered(ties)), path
        now, path = after
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        remove(spark, old)
        if tuple(row) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, size = tuple(row), row[0]
