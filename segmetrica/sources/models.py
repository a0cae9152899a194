"""Strict reading of small model files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MAX_MODEL_BYTES = 2_000_000


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key in model JSON")
    return out


def _no_constant(text):
    raise ValueError(f"non-finite constant in model JSON: {text}")


def parse_model(raw: str) -> dict:
    if len(raw.encode()) > MAX_MODEL_BYTES:
        raise ValueError("model file is too large")
    return json.loads(raw, object_pairs_hook=_no_repeats, parse_constant=_no_constant)


def load_model(spark: SparkSession, path: str) -> dict:
    """A model export is one file; its size is checked before it reaches the driver."""
    files: DataFrame = spark.read.format("binaryFile").load(path)
    if files.filter(files.length > MAX_MODEL_BYTES).limit(1).count():
        raise ValueError("model file is too large")
    rows = files.select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one model file expected")
    return parse_model(bytes(rows[0].content).decode())
