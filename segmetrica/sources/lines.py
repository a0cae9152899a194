"""CSV records with their numbers in the file, from files that Spark splits.

A reader of splits doesn't know how many records stand before its own, nor whether it begins inside a quoted field. Both
follow from counts of the splits before: each split counts its lines' quotes, and its record starts for both cases. Prefix
sums over one row a split then give every line its record. Only the lines of records with quoted line ends are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINES = "file string, block long, line long, odd boolean, own boolean, even_starts long, odd_starts long, value string"


def _numbered(batches):
    """Adds to each line of a split: its number, whether an odd number of quotes stands before it in the split, whether it
    holds an odd number itself, and how many records have started up to it, if the split begins outside or inside quotes."""
    at, line, quotes, starts = None, 0, 0, np.zeros(2, np.int64)
    for batch in batches:
        files, blocks, values = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        codes = files.dictionary_encode()
        key = np.stack([codes.indices.to_numpy(), blocks], axis=1)
        own = pc.count_substring(values, '"').to_numpy().astype(np.int64)
        blank = pc.equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
            if a == b:
                continue
            name = (files[int(a)].as_py(), int(blocks[a]))
            if name != at:
                at, line, quotes, starts = name, 0, 0, np.zeros(2, np.int64)
            before = (quotes + np.cumsum(own[a:b]) - own[a:b]) % 2
            begun = np.stack([(before == k) & ~blank[a:b] for k in (0, 1)])
            counted = starts[:, None] + np.cumsum(begun, axis=1)
            yield pa.RecordBatch.from_arrays(
                [files.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(line + np.arange(b - a)), pa.array(before == 1),
                 pa.array(own[a:b] % 2 == 1), pa.array(counted[0]), pa.array(counted[1]), values.slice(a, b - a)],
                names=["file", "block", "line", "odd", "own", "even_starts", "odd_starts", "value"],
            )
            line, quotes, starts = line + b - a, quotes + int(own[a:b].sum()), counted[:, -1]


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): every CSV record of the files in a path, numbered from 0 in each file, blank lines left out.

    A record may hold quoted line ends, wherever Spark splits the file. Reading is done twice: for one row of counts a
    split, and for the lines. A last record whose quotes never close is kept as it is.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = text.mapInArrow(_numbered, _LINES)
    own_parity = (F.col("odd") != F.col("own")).cast("int")
    counts = lines.groupBy("file", "block").agg(
        F.max_by(own_parity, "line").alias("parity"), F.max("even_starts").alias("even_total"), F.max("odd_starts").alias("odd_total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_open", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("_open") == 0, F.col("even_total")).otherwise(F.col("odd_total"))
    counts = counts.withColumn("_begun", begun).withColumn("_base", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)))
    based = lines.join(counts.select("file", "block", "_open", "_base"), ["file", "block"])
    starts = F.when(F.col("_open") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    inside = F.col("odd") != (F.col("_open") == 1)  # the line begins within quotes
    placed = based.select("file", (F.col("_base") + starts - 1).alias("record"), "block", "line", "value", inside.alias("_inside"), "own")
    plain = placed.where("NOT _inside AND NOT own AND trim(value) <> ''")
    several = placed.where("(_inside OR own) AND record >= 0").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("_l"))
    joined = several.select("file", "record", F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("text"))
    return plain.select("file", "record", F.col("value").alias("text")).unionByName(joined)


def read_records(spark: SparkSession, path: str, schema=None, row: str | None = None) -> DataFrame:
    """CSV of strings with a header in each file, by its records; ``row`` names a column for the record's number in its file.

    Numbers count from 2, the header being 1. A byte order mark is tolerated. Files must have the same header, which is
    read from one of them; with ``schema`` its names and order hold.
    """
    records = numbered_records(spark, path)
    head = records.where("record = 0").orderBy("file").select("text").first()
    if schema is None:
        if head is None:
            raise ValueError(f"no header in {path}")
        width = F.size(F.split(F.regexp_replace(F.lit(head[0]), '"[^"]*"', ""), ","))
        n = spark.range(1).select(width).first()[0]
        names = spark.range(1).select(F.from_csv(F.lit(head[0].lstrip("﻿")), ", ".join(f"c{k} string" for k in range(n)), {"escape": '"'}).alias("h")).first()[0]
        ddl = ", ".join(f"`{(c or f'_c{k}').strip()}` string" for k, c in enumerate(names))
    else:
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.where("record > 0").select((F.col("record") + 1).alias("_row"), F.from_csv("text", ddl, {"escape": '"'}).alias("_r"))
    return parsed.select(*([F.col("_row").alias(row)] if row else []), "_r.*")
