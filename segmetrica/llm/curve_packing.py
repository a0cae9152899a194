"""Packs documents into training sequences along a Hilbert curve.

A document's tokens are hashed into a vector, projected to a few dimensions, centred and scaled by the corpus, and
placed on a Hilbert curve. Documents sorted by their place on the curve are laid end to end and cut every ``size``
tokens, so neighbours share sequences and only the very last sequence can be short.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import mix, slices, stream
from .shared import written
from .units import SLICE, binary, encoder, with_end

DIMS, BITS, HASHED = 4, 8, 4096
RANGE_BYTES = 24 << 20
_COORDS = [f"c{k}" for k in range(DIMS)]


def projection() -> np.ndarray:
    """Fixed signs: a row of ``DIMS`` values for each of ``HASHED`` vector components."""
    bits = (stream(HASHED, 4)[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.float64) * 2 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (rows: points, columns: dimensions)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(dims):
            inside = (x[k] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            place = place << 1 | (x[k] >> b & 1)
    return place


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, spaces_count: bool = False) -> DataFrame:
    """(doc_id, ids: 2-byte ids, n, coordinates) of every row; a null text is empty and has the end id alone."""
    table, salts = projection(), mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(99))
    rows_of = table[(salts % np.uint64(HASHED)).astype(np.int64)]

    def run(batches):
        enc = encoder(tokenizer, spaces_count, "<u2")
        for part, strings in slices(batches, "text", SLICE):
            ids, at = with_end(*enc(strings), end_id)
            n = np.diff(at)
            sums = np.stack([np.add.reduceat(rows_of[:, k][ids], at[:-1]) for k in range(DIMS)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), binary(ids, at), pa.array(n), *(pa.array(s / n) for s in sums)],
                names=["doc_id", "ids", "n", *_COORDS],
            )

    kinds = ", ".join(f"{c} double" for c in _COORDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, ids binary, n long, {kinds}")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, vocabulary: int = 49_408) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids: 2-byte ids) of all documents.

    Each token lies in one piece; sequences are numbered along the curve and filled to ``size`` but for the last. Equal
    documents share a place on the curve; they are ordered by a hash of their id, so a large group of copies is shared
    by many ranges. Documents are cut freely. A row without doc_id is packed too. An empty table gives no rows.

    The token table is written once. Range bounds are approximate quantiles of the order key; every range's token count
    is exact, so the running total gives each range its first position and no range waits for another. The driver sees
    one number a range.
    """
    if vocabulary > 1 << 16:
        raise ValueError("ids are stored in two bytes")
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer, end_id), "tokens")
    stats = tokens.agg(
        F.coalesce(F.sum("n"), F.lit(0)), *(F.avg(c) for c in _COORDS), *(F.stddev_pop(c) for c in _COORDS)
    ).first()
    total = stats[0]
    mean = np.array([x or 0.0 for x in stats[1 : 1 + DIMS]])
    spread = np.array([x or 1.0 for x in stats[1 + DIMS :]])

    def order(doc_ids: pa.Array, coords: list[pa.Array]) -> np.ndarray:
        z = (np.stack([c.to_numpy() for c in coords], axis=1) - mean) / spread
        # squeezed to (0, 1), about evenly for bell-shaped coordinates
        cell = np.clip(((1 / (1 + np.exp(-1.7 * z))) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        salt = mix(doc_ids.fill_null(0).to_numpy().astype(np.uint64)) >> np.uint64(33)
        return hilbert(cell) << 31 | salt.astype(np.int64)

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(order(b.column(0), b.columns[2:])), b.column(1)], names=["rank", "n"])

    ranges = max(1, ceil(total * 2 / RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = tokens.select("doc_id", "n", *_COORDS).mapInArrow(keys, "rank long, n long")
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    found = keyed.agg(F.percentile_approx("rank", shares, 20 * ranges)).first()[0] if ranges > 1 else []
    bounds = np.unique(np.array(found or [], np.int64))

    def bucket_of(rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, rank, side="left").astype(np.int32)

    def buckets(batches):
        for b in keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0).to_numpy())), b.column(1)], names=["bucket", "n"])

    sized = tokens.select("doc_id", "n", *_COORDS).mapInArrow(buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    counts = np.zeros(len(bounds) + 2, np.int64)
    for bucket, n in sized.collect():
        counts[bucket + 1] = n
    first = np.cumsum(counts)

    def dealt(batches):
        for b in batches:
            rank = order(b.column(0), b.columns[3:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(rank)), pa.array(rank), *b.columns[:3]], names=["bucket", "rank", "doc_id", "ids", "n"]
            )

    def cut(batches):
        here, at = -1, 0
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != here:
                    here, at = bucket, int(first[bucket])
                body = body.as_buffer().to_pybytes()
                n, start = len(body) // 2, 0
                while start < n:
                    offset = at % size
                    length = min(size - offset, n - start)
                    for column, value in zip(out, (doc, start, length, n, at // size, offset, body[2 * start : 2 * (start + length)]), strict=True):
                        column.append(value)
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(out)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    rows = tokens.select("doc_id", "ids", "n", *_COORDS).mapInArrow(dealt, "bucket int, rank long, doc_id long, ids binary, n long")
    ordered = rows.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "rank", "doc_id", "ids")
    return ordered.select("bucket", "doc_id", "ids").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, docs, ids): the tokens of each sequence in order. A group holds one sequence, no more."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    return pieces.groupBy("sequence_id").agg(joined.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("length"),
        F.col("parts.doc_id").alias("docs"),
        F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
    )
