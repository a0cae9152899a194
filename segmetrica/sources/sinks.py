"""Writers of scores, rankings, manifests, predictions and window scores."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import folder_of, remove, scratch_path
from ..schemas import MANIFEST_COLUMNS, PREDICTION_COLUMNS

SCORE_COLUMNS = ("rank", "formula", "anchor", "formula_key", "sample_id", "label", "content_group", "generator_family", "score")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def write_scores(scores: DataFrame, ranking: DataFrame, path: str, top_n: int | None = None) -> None:
    """Long per-file scores of the best formulas; the ranking has one row per formula."""
    r = ranking if top_n is None else ranking.filter(F.col("rank") <= top_n)
    names = r.select("formula_id", "rank", F.col("name").alias("formula"), "anchor", "formula_key")
    write_csv(scores.join(names, "formula_id").select(*SCORE_COLUMNS), path)


def write_manifests(rows: DataFrame, csv_path: str, jsonl_path: str) -> None:
    """Canonical CSV plus a JSON side table with every column."""
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in MANIFEST_COLUMNS])
    write_csv(full, csv_path)
    rows.select(*sorted(rows.columns)).write.json(jsonl_path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions with their template position; parts are sorted and ranged by it."""
    out = df.select("pos", "ID", *PREDICTION_COLUMNS).repartitionByRange("pos").sortWithinPartitions("pos")
    write_csv(out, path)


def write_window_scores(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


JOIN_BYTES = 8 << 20  # read and written at a time when parts are joined
#: Columns of a ranking file, in order, and where they come from (fixed names).
RANKING_COLUMNS = {
    "rank": "rank", "formula": "name", "anchor": "anchor", "formula_key": "formula_key", "selection_metric": "selection_metric",
    "selection_value": "selection_value", "overall_eer": "eer", "overall_auc": "roc_auc", "worst_family_eer": "worst_family_eer",
    "worst_family": "worst_family", "blend_eer": "blend_eer", "bootstrap_lower": "lower", "bootstrap_upper": "upper",
    "tie_rate": "tie_rate", "voice_pooling": "voice_pooling", "music_pooling": "music_pooling", "mixture_pooling": "mixture_pooling",
    "combine": "combine", "voice_exponent": "voice_exponent", "music_exponent": "music_exponent", "mixture_weight": "mixture_weight",
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str], columns: Sequence[str] | None = None) -> None:
    """One CSV file with all rows in order, and the given columns (all, if None).

    Rows are sorted by ranges and written as part files, each committed by Spark. One task then joins the parts, a few
    megabytes at a time, under a name of its own and renames that to ``path`` at the end: a repeated task, or a job that
    was stopped, leaves no half file there. A file that is there already is replaced at that moment.
    """
    spark = df.sparkSession
    parts = scratch_path(spark, "parts")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = list(columns or df.columns)
    ordered.select(*columns).write.option("header", False).option("escape", '"').csv(parts)
    names = sorted(f for f in folder_of(spark, parts) if f.startswith("part-"))
    header = ",".join(columns) + "\n"

    def join(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                source, base = _store(parts)
                store, target = _store(path)
                mine = f"{target}.{uuid.uuid4().hex}"
                if "/" in target:
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                size = len(header)
                with store.open_output_stream(mine) as out:
                    out.write(header.encode())
                    for name in names:
                        with source.open_input_stream(f"{base}/{name}", compression=None) as part:
                            while chunk := part.read(JOIN_BYTES):
                                out.write(chunk)
                                size += len(chunk)
                store.move(mine, target)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["bytes"])

    spark.range(0, 1, 1, 1).mapInArrow(join, "bytes long").collect()
    remove(spark, parts)


def write_ranking(ranking: DataFrame, path: str, metric: str = "worst_family") -> None:
    """One row a formula with what it was selected by, in order of rank, as one file."""
    r = ranking.withColumn("selection_metric", F.lit(metric))
    write_ordered(r.select(*[F.col(c).alias(n) for n, c in RANKING_COLUMNS.items()]), path, ["rank"])


def export_predictions(df: DataFrame, path: str) -> None:
    """Predictions in the order of the template, as one file without the position."""
    write_ordered(df, path, ["pos"], ["ID", *PREDICTION_COLUMNS])
