"""Near-duplicate documents by MinHash: universal hash minima, banding, proof of each link, components by stars.

1. Every text gives its set of word shingles (64-bit hashes), and ``HASHES`` minima of universal hash functions over it.
2. Documents with equal sets are one class from here on, held by its smallest id.
3. Bands of ``ROWS`` minima give bucket keys; classes that share a bucket may be linked.
4. In each bucket, links are looked for in rounds. First every class is compared with the bucket's hub, the class that
   shares most buckets with others; then those that are not connected with the bucket's largest component have a hub of
   their own. Buckets that still hold several components are then searched whole, in blocks of bounded size: signatures
   gather what may be linked into clusters, and inside a cluster the full sets decide. What is already connected needs
   no comparison, so large groups of copies cost about one comparison a class.
5. A pair first passes a comparison of signatures, wide enough not to lose a link, and is then proved on the full sets.

The chance that a pair at the limit of 0.75 shares no bucket is (1 - 0.75**5)**48, two in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import SpanHasher, mix, raw, slices, stream, words_of
from .shared import components, materialize, written

SHINGLE, BANDS, ROWS = 5, 48, 5
HASHES = BANDS * ROWS
SURE_BELOW = 0.60  # five standard deviations of the estimate below 0.75
BLOCK = 256

_A, _B = stream(HASHES, 11) | np.uint64(1), stream(HASHES, 12)
_LINK = stream(SHINGLE, 13) | np.uint64(1)


def shingle_sets(strings: pa.Array, hasher: SpanHasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one of the whole sequence."""
    data, at = raw(strings)
    low, starts, ends, first = words_of(data, at)
    words = hasher(low, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        n = len(words) - SHINGLE + 1
        runs = np.zeros(max(n, 0), np.uint64)
        for k in range(SHINGLE):
            runs += mix(words[k : k + len(runs)] * _LINK[k])
        runs = mix(runs)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo >= SHINGLE:
                out.append(np.unique(runs[lo : hi - SHINGLE + 1]))
            elif hi > lo:
                short = mix(words[lo:hi] * _LINK[: hi - lo] + np.uint64(hi - lo))
                out.append(mix(np.add.reduce(short, keepdims=True) + np.uint64(0x5EED)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(values: np.ndarray, step: int = 64) -> np.ndarray:
    """The minimum of each universal hash function (a x + b) over the set, from the upper 32 bits of 64."""
    x = values >> np.uint64(32)
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((step, HASHES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), step):
            part = x[k : k + step, None]
            here = room[: len(part)]
            np.multiply(part, _A, out=here)
            here += _B
            np.minimum(best, here.min(axis=0), out=best)
    return best >> np.uint64(32)


_BAND_MIX = stream(ROWS, 14) | np.uint64(1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = mix(sig.reshape(BANDS, ROWS) * _BAND_MIX)
        return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2: digest of the set, bands, sig: one byte a minimum). An empty set has no digest and no bands."""

    def run(batches):
        hasher = SpanHasher()
        for part, strings in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(5)]
            with np.errstate(over="ignore"):
                for s in shingle_sets(strings, hasher):
                    cols[0].append(len(s))
                    if len(s) == 0:
                        for c in cols[1:]:
                            c.append(None)
                        continue
                    sig = minima(s)
                    cols[1].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    cols[2].append(int(mix(s + np.uint64(17)).sum(dtype=np.uint64).astype(np.int64)))
                    cols[3].append(band_keys(sig))
                    cols[4].append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"
    )


def similar_enough(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _close_sigs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out a link."""
    one = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            keep = (x == y).mean(axis=1) >= SURE_BELOW
            yield pa.RecordBatch.from_arrays([t.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _proved(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough. Texts travel, not sets, as they are smaller."""
    text = docs.select("doc_id", "text")
    both = pairs.join(text.toDF("b", "text_b"), "b").join(text.toDF("a", "text_a"), "a")

    def run(batches):
        hasher, held, held_set = SpanHasher(), None, None
        for part, strings in slices(batches, "text_b"):
            sets = shingle_sets(strings, hasher)
            a = part.column(0).to_pylist()
            keep = []
            for k, other in enumerate(sets):
                if a[k] != held:
                    held = a[k]
                    held_set = shingle_sets(part.column(3).slice(k, 1).cast(pa.string()).fill_null(""), hasher)[0]
                common = len(np.intersect1d(held_set, other, assume_unique=True))
                keep.append(similar_enough(common, len(held_set), len(other), percent))
            yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "text_b", "text_a").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id")
    )


def _main_roots(members: DataFrame) -> DataFrame:
    """(key, main, most, all): each bucket's largest component, its members there, and all its members."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))


def _hub_pairs(rows: DataFrame, outside_main: bool) -> DataFrame:
    """Pairs (a, b) of each bucket's hub with its members of other components.

    The hub is the member that shares most buckets with others, as the text that near copies were made from does;
    ``outside_main`` takes it from the members outside the bucket's largest component.
    """
    able = rows
    if outside_main:
        able = rows.join(_main_roots(rows).select("key", "main"), "key").where("root <> main")
    hubs = able.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("least"), "root")).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.least")).alias("hub"), F.col("hub.root").alias("hub_root"))
    pairs = rows.join(hubs, "key").where("root <> hub_root")
    return pairs.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()


def _whole_buckets(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all documents of different components which signatures don't rule out, bucket by bucket.

    Rows are (key, doc_id, root); all but a bucket's largest component are compared with everything in it. Cells pair a
    block of the smaller components with a block of the bucket, so a cell has at most about twice ``BLOCK`` small rows,
    and it emits less than one edge a row.
    """
    per = _main_roots(members)
    per = per.withColumn("small", F.ceil((F.col("all") - F.col("most")) / BLOCK)).withColumn("large", F.ceil(F.col("most") / BLOCK))
    rows = members.join(per, "key")
    spot = F.pmod(F.xxhash64("doc_id", "key"), F.when(F.col("root") == F.col("main"), F.col("large")).otherwise(F.col("small")))
    rows = rows.withColumn("minor", F.col("root") != F.col("main")).withColumn("spot", spot).join(sigs.select("doc_id", "sig"), "doc_id")
    blocks = F.sequence(F.lit(0).cast("long"), F.col("small") - 1)
    # a cell is (block of the smaller components, block it is compared with, whether that one is of the largest)
    as_side = rows.withColumn("i", F.explode(blocks)).where("not minor or i <= spot").select(
        "key", "i", F.col("spot").alias("j"), (~F.col("minor")).alias("main"), "doc_id", "root", "sig", F.lit(False).alias("lead")
    )
    minor = rows.where("minor")
    to_main = minor.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("large") - 1))).withColumn("main", F.lit(True))
    to_minor = minor.withColumn("j", F.explode(blocks)).where("j >= spot").withColumn("main", F.lit(False))
    leads = to_main.unionByName(to_minor).select(
        "key", F.col("spot").alias("i"), "j", "main", "doc_id", "root", "sig", F.lit(True).alias("lead")
    )

    def run(cell: pa.Table) -> pa.Table:
        doc, root = cell["doc_id"].to_numpy(), cell["root"].to_numpy()
        lead = cell["lead"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        two, group = np.flatnonzero(~lead), np.arange(len(doc))
        for i in np.flatnonzero(lead):
            near = (sig[two] == sig[i]).mean(axis=1) >= SURE_BELOW
            hit = two[near & (root[two] != root[i])]
            if len(hit):
                joined = np.unique(np.append(group[hit], group[i]))
                group[np.isin(group, joined)] = joined[0]
        out = np.flatnonzero(group != np.arange(len(doc)))
        return pa.table({"a": doc[group[out]], "b": doc[out]})

    cells = as_side.unionByName(leads)
    return cells.groupBy("key", "i", "j", "main").applyInArrow(run, "a long, b long")


def _links_in_clusters(clusters: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components inside each cluster of close documents (cluster, doc_id, root).

    All pairs of a cluster are looked at, but none leaves its task unless it is a link that joins two components. A
    cluster is cut into blocks; a task holds the texts of two.
    """
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = clusters.join(sizes, "cluster").withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("spot", "t").alias("i"), F.greatest("spot", "t").alias("j"), "spot", "doc_id", "root", "text")

    def run(cell: pa.Table) -> pa.Table:
        doc, spot = cell["doc_id"].to_numpy(), cell["spot"].to_numpy()
        sets = shingle_sets(cell["text"].combine_chunks().cast(pa.string()).fill_null(""), SpanHasher())
        size = np.array([len(s) for s in sets])
        group = np.unique(cell["root"].to_numpy(), return_inverse=True)[1]
        one, two = np.flatnonzero(spot == cell["i"][0].as_py()), np.flatnonzero(spot == cell["j"][0].as_py())
        a, b = [], []
        for x in one:
            fits = (100 * np.minimum(size[two], size[x]) >= percent * np.maximum(size[two], size[x])) & (group[two] != group[x])
            for y in two[fits & (two != x)]:
                if group[y] != group[x] and similar_enough(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), size[x], size[y], percent):
                    group[group == group[y]] = group[x]
                    a.append(doc[x])
                    b.append(doc[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row with a doc_id.

    Documents are linked where their sets' similarity is at least ``percent``; component_id is the smallest doc_id
    reachable by links, and that document is kept. Texts without words (null, empty, white space) have no shingle, are
    linked with nothing and are kept. doc_id is taken as a key: rows that repeat one are one document if their texts
    agree. Extra columns are ignored. An empty table gives no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    sets = written(signatures(docs), "signatures")
    reps = sets.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = materialize(sets.select("doc_id", "n_shingles", "d1", "d2").join(reps, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    held = sets.where("n_shingles > 0").join(member.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = held.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "key").select("key", "doc_id", "size"), "buckets")
    degree = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    members = materialize(members.drop("size").join(degree, "doc_id"), "buckets")
    sigs = sets.select("doc_id", "sig")
    labels = None
    for step in ("hub", "next hub", "all"):
        if labels is None:
            rows = members.withColumn("root", F.col("doc_id"))
        else:
            rows = _labelled(members, labels)
            several = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
            rows = materialize(rows.join(several, "key", "left_semi"), "open-buckets")
            if rows.isEmpty():
                break
        if step == "all":
            close = components(_whole_buckets(rows.select("key", "doc_id", "root"), sigs))
            inside = close.union(close.select("root", "root").distinct()).toDF("doc_id", "cluster")
            found = _links_in_clusters(_labelled(inside, labels), docs, percent)
        else:
            close = _close_sigs(_hub_pairs(rows, outside_main=step != "hub"), sigs)
            found = _proved(materialize(close, "close-pairs"), docs, percent)
        new = materialize(found, "links")
        labels = components(new if labels is None else labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
    roots = labels.select(F.col("node").alias("rep"), "root")
    return (
        member.join(roots, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
