"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put to the tokenizer by itself; those that come back as exactly their own single
token are proved "whole". A pre-token that is a whole token counts one; only the others go through the merges of the
library. Texts are cut into units first (see ``units``), each different unit is split by the tokenizer's pattern once, and its
count is kept in a bounded cache.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import slices
from .units import SLICE, Cutter, UnitCache, letters, library, merges_only, special_strings


def whole_tokens(path: str) -> frozenset[str]:
    """The proof: vocabulary strings (in byte letters) that the library's merges turn into their own single token."""
    tok = library(path)
    model = tok.model
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    proved = set()
    for piece, number in vocab.items():
        found = model.tokenize(piece)
        if len(found) == 1 and found[0].id == number:
            proved.add(piece)
    return frozenset(proved)


class Counter:
    """Counts tokens of texts as the library does, special strings included."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        tok = library(path)
        self.whole, self.split, self.model, self.tok = whole_tokens(path), regex.compile(pattern).findall, merges_only(path), tok
        self.special = special_strings(tok)
        self.cut, self.units = Cutter(True, list(self.special)), UnitCache(lambda new: [self.count(u.decode()) for u in new])

    def count(self, unit: str) -> int:
        if any(s in unit for s in self.special):
            return len(self.tok.encode(unit, add_special_tokens=False).ids)
        pieces = map(letters, self.split(unit))
        return sum(1 if p in self.whole else len(self.model.tokenize(p)) for p in pieces)

    def __call__(self, strings: pa.Array) -> np.ndarray:
        different, which, owner = self.cut(strings)
        held = self.units.need([different])
        n = np.fromiter((held[u] for u in different), np.int64, len(different))
        total = np.concatenate([[0], np.cumsum(n[which])])
        return np.diff(total[owner])


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter_of(path: str, pattern: str) -> Counter:
    """One per worker process, kept between tasks."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of whole texts; a null or empty text has 0 of both. One pass, no shuffle.

    ``tokenizer`` is a byte-level BPE file whose pre-tokens are those of ``pattern``. Every row gives a row.
    """

    def run(batches):
        counter = counter_of(tokenizer, pattern)
        for part, strings in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counter(strings))], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
        .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", key)
    )
