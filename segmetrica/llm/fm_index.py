"""Finds benchmark passages in training text with an FM-index of every shard of documents.

A shard is a run of documents, a few megabytes of text, inside one task. Its words become numbers; words that no
benchmark item has, and document ends, become separators, since no phrase can cross them. The shard's sequence is
suffix-sorted, its Burrows-Wheeler transform is kept in a wavelet tree, and every suffix that starts at a multiple of
``SAMPLE`` keeps its position. All phrases are searched backwards at once, word by word, by ranks in the tree; the
occurrences are located by walking to a sampled suffix, and overlapping ones are merged into removal spans.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import slices
from .shared import materialize, written

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

#: Letters, digits and all bytes of other characters stay (A-Z in lower case), anything else becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, each sorted by the bits above (a wavelet matrix)."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.counts = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``ends`` places."""
        lo, hi = np.zeros_like(ends), ends.copy()
        for level, (ones, zeros) in enumerate(zip(self.counts, self.zeros, strict=True)):
            up = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + l1, lo - l1), np.where(up, zeros + h1, hi - h1)
        return hi - lo

    def at(self, places: np.ndarray) -> np.ndarray:
        """The symbols at some places."""
        p, out = places.copy(), np.zeros(len(places), np.int64)
        for ones, zeros in zip(self.counts, self.zeros, strict=True):
            one = ones[p + 1] - ones[p]
            out = out << 1 | one
            p = np.where(one == 1, zeros + ones[p], p - ones[p])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes by doubling; from the second round on only suffixes that still tie are sorted."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    rank = np.zeros(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = seq[sa[1:]] != seq[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = 1
    while True:
        head = np.append(np.flatnonzero(new), n)
        big = np.diff(head) > 1
        if not big.any():
            return sa
        size = np.diff(head)
        places = np.flatnonzero(np.repeat(big, size))
        block = sa[places]
        after = np.where(block + span < n, rank[np.minimum(block + span, n - 1)], -1)
        order = np.lexsort((after, rank[block]))
        block, after = block[order], after[order]
        group = rank[block]
        sa[places] = block
        start = np.ones(len(block), bool)
        start[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        rank[block] = places[np.maximum.accumulate(np.where(start, np.arange(len(block)), 0))]
        new[places] = start
        span *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE) -> None:
        """seq: symbols 0 to top, where 0 separates. Inside, all are one larger, and the only 0 is the end mark."""
        seq, top = np.append(seq + 1, 0).astype(np.int64), top + 1
        sa = suffix_array(seq)
        self.n, self.tree = len(seq), WaveletTree(seq[sa - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        held = sa % sample == 0
        self.sampled, self.kept = np.concatenate([[0], np.cumsum(held)]), sa[held]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (one a row, right-aligned and padded in front)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            alive = alive[(hi[alive] > lo[alive])]
            todo = alive[lengths[alive] > step]
            if not len(todo):
                break
            c = phrases[todo, phrases.shape[1] - 1 - step] + 1
            lo[todo], hi[todo] = self.before[c] + self.tree.rank(c, lo[todo]), self.before[c] + self.tree.rank(c, hi[todo])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps, at, todo = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(todo):
            here = at[todo]
            found = self.sampled[here + 1] > self.sampled[here]
            done = todo[found]
            out[done] = self.kept[self.sampled[at[done]]] + steps[done]
            todo = todo[~found]
            c = self.tree.at(at[todo])
            at[todo] = self.before[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text or "")]
            for k in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[k : k + window]), set()).add(item)
        self.top = len(self.vocab)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int64)
        for k, x in enumerate(owners):
            self.table[k, window - len(x) :] = x
        self.shortest = int(self.lengths.min()) if len(owners) else 1


def scan(texts: list[str], phrases: Phrases):
    """For each text: number of words, removal spans (start, end) in words, and the items found."""
    get, counts, ids = phrases.vocab.get, [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        ids.extend(map(get, w, (0,) * len(w)))
        ids.append(0)
    full = np.array(ids, np.int64)
    # runs of words that some item has; shorter ones than any phrase can hold none
    edge = np.diff(np.concatenate([[0], (full > 0).astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= phrases.shortest
    keep = np.zeros(len(full) + 1, np.int32)
    np.add.at(keep, a[long], 1)
    np.add.at(keep, b[long] + 1, -1)  # with the separator behind
    where = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
    spans, items = [[] for _ in texts], [set() for _ in texts]
    if not len(where) or not len(phrases.table):
        return counts, spans, items
    index = FMIndex(full[where], phrases.top)
    lo, hi = index.search(phrases.table, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if len(found):
        times = hi[found] - lo[found]
        which = np.repeat(found, times)
        rows = np.repeat(lo[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start = where[index.locate(rows)]
        first = np.cumsum([0] + [c + 1 for c in counts])
        doc = np.searchsorted(first, start, side="right") - 1
        for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d].update(phrases.owners[p])
        order = np.argsort(start)
        for d, s, e in zip(doc[order].tolist(), (start - first[doc])[order].tolist(), (start - first[doc] + phrases.lengths[which])[order].tolist(), strict=True):
            if spans[d] and s <= spans[d][-1][1]:
                spans[d][-1][1] = max(e, spans[d][-1][1])
            else:
                spans[d].append([s, e])
    return counts, spans, items


_SCAN = "row long, doc_id long, n_words long, spans array<array<int>>, items array<string>"


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: merged spans [start, end) in words, and the ids of items found.

    docs: doc_id, text; benchmark: item_id, text. A window is ``window`` consecutive words of an item, or all words of
    a shorter one. Null and empty texts have no words; items without words are never found; rows without item_id are
    ignored; repeated items count once by id. A document row gives a row; an empty benchmark gives rows without hits.

    The benchmark goes to the tasks in blocks of items of about ``block_bytes``, the size being measured first, and
    every block is searched in all documents; with one block there is no shuffle at all. With more, documents are written
    once with a number for each row, by which what the blocks found is merged.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    if blocks > 1:
        docs = written(docs, "numbered")

    def search(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])

        def run(batches):
            phrases = Phrases(shared.value, window)
            for part, strings in slices(batches, "text", SHARD_BYTES):
                counts, spans, found = scan(strings.to_pylist(), phrases)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    ],
                    names=["row", "doc_id", "n_words", "spans", "items"],
                )

        return docs.mapInArrow(run, _SCAN)

    if blocks == 1:
        return search(0).drop("row")
    parts = None
    for block in range(blocks):
        one = materialize(search(block), "passages")
        parts = one if parts is None else parts.union(one)
    merged = parts.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.array().cast("array<array<int>>")
    join = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= s[0]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1])))),
    ).otherwise(F.concat(acc, F.array(s)))
    return merged.drop("row").withColumn("spans", F.aggregate("spans", start, join))


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))
