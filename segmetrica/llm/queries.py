"""Queries of this folder's operators over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, curve_packing, fm_index, language, licences, merkle, minhash, mixing, neighbours, pages, records, token_counts, whitening
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op1_language_spans(spark, sf_dir):
    """Language of every document; learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


@query
def op2_tag_paths(spark, sf_dir):
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op3_record_files(spark, sf_dir):
    """Every document's ids, written as record files in doc_id order and read back."""
    files, folder = records.export(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return records.token_layout(files, folder)


@query
def op4_curve_packing(spark, sf_dir):
    """All documents packed along a Hilbert curve into sequences of 2048 tokens."""
    pieces = curve_packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)

    def digest(batches):
        for b in batches:
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in b.column(6)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(sums, pa.int64())], names=[*b.schema.names[:6], "ids_crc32"])

    kinds = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    return pieces.mapInArrow(digest, kinds)


@query
def op5_learned_partitions(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op6_licence_sentences(spark, sf_dir):
    """Licence sentences and licences of every document."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("identifiers").cast("long").alias("n_sentences"),
        F.concat_ws(" ", "identifiers").alias("identifiers"), F.concat_ws(",", "licences").alias("licences"),
    )


ORACLES["op6_licence_sentences"] = licences.oracle()


@query
def op7_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_chunk_dedup(spark, sf_dir):
    """All documents without the passages that a smaller doc_id has too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = chunks.remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", F.size("spans").alias("n_spans"), removed.alias("n_bytes_removed"), "spans", "text")


@query
def op9_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_decontaminate(spark, sf_dir):
    """Benchmark items that occur in each document, and the words they cover."""
    found = fm_index.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = fm_index.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


@query
def op11_context_mixing(spark, sf_dir):
    """Log-probability of every document by a mixing model of all documents that aren't held out, beside unigrams."""
    seventh = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found = mixing.score(table(spark, sf_dir, "documents"), ~seventh)
    return found.select("doc_id", seventh.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op12_whitening(spark, sf_dir):
    """Eight whitened coordinates of every vector, from the exact covariance of all of them."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_merkle_manifest(spark, sf_dir):
    """Leaf, root and proof of every document; every third one by hash is checked with a changed text."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs, tampered=third)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


ORACLES["op13_merkle_manifest"] = merkle.oracle()
