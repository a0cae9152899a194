"""A corpus made ready for training: five stages, each written and read again before the next one.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, but for the last, which
returns packed pieces. Stages decide on the whole of what their predecessor kept, need the columns doc_id and text, pass
other columns on unchanged, and leave rows without doc_id out. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrica.llm import chunks, curve_packing, fm_index, language, minhash
from segmetrica.llm.shared import table, written

TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without a letter (und) go. lang becomes the language found.

    The model is learned from the labelled rows of docs. If no row has a label nothing can be told: then every document
    with a letter is kept, as it is.
    """
    model = language.train(docs)
    named = docs.where("doc_id is not null")
    if not model.known:
        return named.where(F.col("text").rlike(r"\p{L}"))
    found = written(language.identify(named.select("doc_id", "text"), model).select("doc_id", "lang_pred"), "languages")
    known = found.where(F.col("lang_pred") != language.UNKNOWN).dropDuplicates(["doc_id"])
    return named.join(known, "doc_id").select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that with the smallest doc_id; of repeated rows one."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has too; n_chars follows. Documents stay, even if empty."""
    cut = chunks.remove_repeats(docs).drop("spans")
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of the benchmark; clean documents stay as they are."""
    found = fm_index.find_passages(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("spans") > 0).select("doc_id").distinct()
    return docs.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left along the curve: one row a piece, with its ids."""
    return curve_packing.pack(docs, TOKENIZER, END)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the trained model nor the hashed stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
