"""A Merkle manifest of documents: a digest tree per language, one root over all, and a proof for each document.

Every node is labelled with the interval of leaf ranks that it covers. Level k has buckets of 8**k ranks. A level's nodes
group their children by bucket, so no group holds more than FAN rows, however many documents a language has. On the way
down each node finds its parent by an equal bucket at the parent's level and by containment of its interval; what is left
of the parent's interval, before and behind the node's own, are its siblings. A proof is thus handed from parents to
children, and only the last join touches all leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(parts: Column) -> Column:
    """Digest of a string, as 32 bytes."""
    return F.unhex(F.sha2(parts, 256))


def text_of(digests: Column) -> Column:
    """The digests of an array (of structs with a field digest) as one hex text."""
    return F.array_join(F.transform(digests, lambda c: F.lower(F.hex(c["digest"]))), "")


def field(value: Column) -> Column:
    """- for null, else byte count, colon and value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column, fields: Sequence[str] = FIELDS) -> Column:
    return sha(F.concat(*[field(text if f == "text" else F.col(f)) for f in fields]))


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds lo (from 0, by ``order`` within a tree, nulls first) and size (rows of the tree).

    The rows are sorted by range, so a large tree is shared by many tasks; only counts a (range, tree) are accumulated.
    """
    spread = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (tree, *order)]).withColumn("_part", F.spark_partition_id())
    kept = written(spread, "ranges").withColumn("_tree", F.struct(tree))
    counts = kept.groupBy("_tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_tree").orderBy("_part")
    counts = counts.select(
        "_tree", "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_base"),
        F.sum("_n").over(Window.partitionBy("_tree")).alias("size"),
    )
    inside = Window.partitionBy("_tree", "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    at = kept.withColumn("_at", F.row_number().over(inside))
    found = at.join(counts, ["_tree", "_part"])
    return found.withColumn("lo", F.col("_base") + F.col("_at") - 1).drop("_tree", "_part", "_base", "_at")


def bucket(level: int) -> Column:
    """Number of the level's bucket that a node starts in; 8**21 ranks are more than a long holds."""
    return F.expr(f"lo div {FAN**level}L") if level < 21 else F.lit(0).cast("long")


def levels_of(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Nodes of level 1, 2, ... as written tables (tree, size, lo, hi, digest, children), from leaves (tree, size, lo, hi, digest)."""
    out, below, width = [], leaves, 1
    while width < largest:
        level = len(out) + 1
        grouped = (
            below.where(F.col("size") > width)
            .groupBy("tree", "size", bucket(level).alias("_bucket"))
            .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        )
        nodes = grouped.select(
            "tree", "size", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
            sha(text_of(F.col("children"))).alias("digest"), "children",
        )
        below = written(nodes, f"level{level}")
        out.append(below)
        width *= FAN
    return out


def whole(nodes: DataFrame, width: int) -> DataFrame:
    """The roots of trees that end at a level of this width."""
    ends = F.col("size") == 1 if width == 1 else (F.col("size") <= width) & (F.col("size") > width // FAN)
    return nodes.where(ends)


def step(children: Column, lo: Column, hi: Column) -> Column:
    """Siblings as text: what the parent's interval holds before and behind the node's own."""
    return F.struct(
        text_of(F.filter(children, lambda c: c["hi"] < lo)).alias("before"),
        text_of(F.filter(children, lambda c: c["lo"] > hi)).alias("behind"),
    )


def descend(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes of one level with the path of their parent, one step longer: (..., path: array<struct<before, behind>>)."""
    p = parents.select(
        F.col("tree").alias("_tree"), bucket(level + 1).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.col("children").alias("_children"), F.col("path").alias("_path"), F.col("subroot").alias("_subroot"),
    )
    child = nodes.withColumn("_at", bucket(level + 1))
    inside = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_at") == F.col("_bucket"))
    joined = child.join(p, inside & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi")))
    mine = F.array(step(F.col("_children"), F.col("lo"), F.col("hi")))
    return joined.select(*nodes.columns, F.concat(mine, "_path").alias("path"), F.col("_subroot").alias("subroot"))


def with_paths(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Leaves with path and subroot. roots: (tree, path, subroot), one row a tree."""
    r = roots.select(F.col("tree").alias("_tree"), "path", "subroot")
    above = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1] if level else leaves
        tops = whole(nodes, FAN**level)
        tops = tops.join(r, tops["tree"].eqNullSafe(r["_tree"])).drop("_tree")
        found = tops.select(*nodes.columns, "path", "subroot")
        if above is not None:
            found = found.unionByName(descend(nodes.where(F.col("size") > FAN**level), above, level))
        above = found
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(acc, s):
        # a lone run (no siblings) is hashed all the same
        return F.sha2(F.concat(s["before"], acc, s["behind"]), 256)

    return F.aggregate(path, F.lower(F.hex(leaf)), up)


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", tampered: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Proof of every document: key, tree, rank, leaf, subroot, root, siblings (text), folded_root, verified.

    ``tampered`` tells which rows are checked with a text whose A-Z were lower-cased (null: none). All of ``fields`` go
    into a leaf, null as ``-``; a null key or tree sorts first. Rows that repeat a key are ordered by their leaf, equal
    rows are leaves of their own with any order among them, so results don't depend on it but for which of them has which
    siblings. Empty and very long texts need nothing special. Extra columns are not read. An empty table gives no row.
    """
    spark = docs.sparkSession
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    text = F.col("text")
    rows = docs.select(
        F.col(key).alias("key"), F.col(tree).alias("tree"), leaf_digest(text, fields).alias("digest"),
        F.when(changed, leaf_digest(F.translate(text, UPPER, LOWER), fields)).alias("other"),
    )
    leaves = written(ranked(rows, "tree", ["key", "digest"]).withColumn("hi", F.col("lo")), "leaves")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {tree} {docs.schema[tree].dataType.simpleString()}"
    largest = leaves.agg(F.max("size")).first()[0]
    if largest is None:
        return spark.createDataFrame([], schema + ", rank long, leaf string, subroot string, root string, siblings string, folded_root string, verified boolean")
    plain = leaves.select("tree", "size", "lo", "hi", "digest")
    levels = levels_of(plain, largest)

    # a second tree of the same kind over the roots of the first ones
    ends = whole(plain, 1)
    for k, nodes in enumerate(levels, 1):
        ends = ends.unionByName(whole(nodes, FAN**k).select(*plain.columns))
    subroots = ends.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "digest")
    tops = written(ranked(subroots, "all", ["name"]).select(F.col("all").alias("tree"), "name", "size", "lo", F.col("lo").alias("hi"), "digest"), "subroots")
    n_trees = tops.agg(F.max("size")).first()[0]
    upper = levels_of(tops.drop("name"), n_trees)
    root = (whole(upper[-1], FAN ** len(upper)) if upper else tops).first()["digest"]
    start = spark.createDataFrame([(0,)], "tree int").select(
        "tree", F.array().cast("array<struct<before:string,behind:string>>").alias("path"), F.lit(None).cast("binary").alias("subroot")
    )
    named = with_paths(tops, upper, start).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    named = written(named, "tree-paths")

    found = with_paths(leaves.select("key", "tree", "size", "lo", "hi", "digest", "other"), levels, named)
    hexed = F.lit(bytes(root).hex())
    folded = fold(F.coalesce("other", "digest"), F.col("path"))
    return found.select(
        F.col("key").alias(key), F.col("tree").alias(tree), F.col("lo").alias("rank"), F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"), hexed.alias("root"),
        F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["behind"])), "").alias("siblings"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(heights: int = 12) -> str:
    """The same in DuckDB SQL: one pair of steps for each level, for trees of up to FAN**heights leaves."""
    def put(c):
        s = f"CAST({c} AS VARCHAR)"
        return f"coalesce(strlen({s}) || ':' || {s}, '-')"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = "sha256(" + " || ".join(put(f) for f in FIELDS) + ")"
    changed = "sha256(" + " || ".join(put(low if f == "text" else f) for f in FIELDS) + ")"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"
    )
    parts = [
        f"""d AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} END AS other FROM documents)""",
        """l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           count(*) OVER (PARTITION BY lang) AS n FROM d)""",
        "n0 AS (SELECT lang AS t, n, i, leaf AS h FROM l0)",
    ]
    def up(name, k):
        """Nodes of the next level; trees that have ended stay as they are."""
        return (
            f"{name}{k + 1} AS (SELECT t, CAST(ceil(n / {FAN}.0) AS BIGINT) AS n, i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h "
            f"FROM {name}{k} WHERE n > 1 GROUP BY t, n, i // {FAN} UNION ALL SELECT t, n, i, h FROM {name}{k} WHERE n = 1)"
        )

    def side(name, k):
        """Text before and behind every node among its run."""
        w = f"PARTITION BY t, i // {FAN} ORDER BY i ROWS BETWEEN"
        return (
            f"{name}s{k} AS (SELECT t, i, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
            f"coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {name}{k} WHERE n > 1)"
        )

    for k in range(heights):
        parts += [up("n", k), side("n", k)]
    parts += [
        f"""m0 AS (SELECT 0 AS t, count(*) OVER () AS n, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, h FROM n{heights})""",
        f"names AS (SELECT t AS lang, h AS subroot, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS j FROM n{heights})",
    ]
    tops = 4
    for k in range(tops):
        parts += [up("m", k), side("m", k)]
    parts.append(
        "p0 AS (SELECT l0.doc_id, l0.lang, l0.i, leaf, coalesce(other, leaf) AS f, '' AS proof, subroot, j "
        "FROM l0 JOIN names ON l0.lang IS NOT DISTINCT FROM names.lang)"
    )
    def climb(k, name, level, at, tree):
        on = f"s.t IS NOT DISTINCT FROM {tree} AND s.i = p.{at} // {FAN**level}"
        return (
            f"p{k + 1} AS (SELECT p.doc_id, p.lang, p.i, leaf, CASE WHEN s.i IS NULL THEN f ELSE sha256(b || f || e) END AS f, "
            f"proof || coalesce(b || e, '') AS proof, subroot, j FROM p{k} p LEFT JOIN {name}s{level} s ON {on})"
        )
    for k in range(heights):
        parts.append(climb(k, "n", k, "i", "p.lang"))
    for k in range(tops):
        parts.append(climb(heights + k, "m", k, "j", "0"))
    return (
        "WITH " + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
        + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{heights + tops}, (SELECT h FROM m{tops})"
    )
