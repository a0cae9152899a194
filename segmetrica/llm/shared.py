"""Spark helpers of the operators: inputs, written tables, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components
from ..session import materialize, scratch_path, shuffles_removed

__all__ = ["components", "materialize", "scratch_path", "shuffles_removed", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, compressed harder than the default, for rows that hold text or ids."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
