"""Removes passages that repeat across documents.

A text is read as words between ASCII white space. A word goes if it lies in a window of ``PASSAGE`` + 1 neighbouring
words that a document with a smaller id holds too, contiguously and in that order; the document with the smallest id
keeps its copy. So no run of over ``PASSAGE`` words that an earlier document has stays, and nothing else goes. White
space between words may differ. Text without white space has no words and stays.

Texts are cut into content-defined chunks: a gear hash rolls over the bytes of the words, and a chunk ends at each word
whose hash is the least of some ``reach`` neighbouring word ends. Ends depend on their neighbourhood alone, so an
insertion changes the chunks around it only, and no chunk has over ``reach`` words. A passage that two texts share holds
runs of RUN whole chunks, the same in both; so the digests of such runs find all texts that may share it. Of the runs in
the middle of a window of words the one with the least digest stands for it. A window is looked at only if its run stands
in another document, and goes if its own hash does in an earlier one: that settles the edges word by word and proves that
the passage stands there as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import SpanHasher, mix, raw, slices, stream, words_of

PASSAGE = 50
GEAR = stream(256, 21)
GEAR_BYTES = 8  # the gear hash knows the last eight bytes, so at most the last GEAR_WORDS words
GEAR_WORDS = 4
RUN = 3  # neighbouring chunks that are looked up as one


def reach_of(size: int) -> int:
    """Neighbours among which a chunk's end has the least hash, for windows of ``size`` words.

    In a shared window the hashes agree behind the first GEAR_WORDS words, ends agree where all neighbours up to reach - 1
    words away lie there too, and each stretch of reach words has an end. RUN + 1 times that many words are left in the
    middle, so RUN whole chunks stand there.
    """
    return max(1, (size - GEAR_WORDS) // (RUN + 3))


def gear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash at the last byte of every word, over words with one space between them."""
    sizes = ends - starts + 1
    at = np.cumsum(sizes)
    body = np.full(int(at[-1]) if len(at) else 0, 32, np.uint8)
    inner = np.ones(len(body), bool)
    inner[at - 1] = False
    body[inner] = data[np.repeat(starts - (at - sizes), sizes - 1) + np.flatnonzero(inner)]
    h = GEAR[body]
    with np.errstate(over="ignore"):
        # h[i] = sum over the last eight bytes of value << 8 * distance, by doubling
        for span in (1, 2, 4):
            h[span:] += h[:-span] << np.uint64(8 * span)
    return mix(h[at - 2]) if len(at) else h


def least(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbours."""
    step = 1
    while 2 * step <= span:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = span - step
    return np.minimum(x[: len(x) - rest], x[rest:])


class Chunker:
    """Chunks of the texts in a buffer, and windows of ``size`` of their words."""

    def __init__(self, size: int = PASSAGE + 1) -> None:
        self.hasher, self.size, self.reach = SpanHasher(), size, reach_of(size)

    def __call__(self, strings: pa.Array) -> None:
        data, at = raw(strings)
        _, starts, ends, first = words_of(data, at)
        self.data, self.at, self.starts, self.first = data, at, starts, first
        n = len(starts)
        self.text = np.repeat(np.arange(len(strings)), np.diff(first))
        # a chunk's last word has the least hash of some ``reach`` neighbours in its text, or ends the text
        last = np.zeros(n, bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        if n >= self.reach:
            h, r = gear(data, starts, ends), self.reach
            low = least(h, r)
            low[self.text[: n - r + 1] != self.text[r - 1 :]] = 0
            edge = np.zeros(r - 1, np.uint64)
            last |= ~least(~np.concatenate([edge, low, edge]), r) == h
        self.chunk_end = np.flatnonzero(last) + 1
        self.chunk_start = np.concatenate([[0], self.chunk_end[:-1]]) if len(self.chunk_end) else self.chunk_end
        self.hasher._grow(len(data) + 1)
        words = self.hasher(data, starts, ends) if n else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(words * self.hasher.powers[:n], out=self.total[1:])
        self.digests = self._sums(self.chunk_start, self.chunk_end)
        self.chunk_text = self.text[self.chunk_start]

    def _sums(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words."""
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.hasher.inverse[start] + (end - start).astype(np.uint64)).view(np.int64)

    def chunk_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start and end in the buffer, with the white space behind them."""
        ends = np.append(self.starts, 0)[self.chunk_end % max(1, len(self.starts))] if len(self.starts) else self.chunk_end
        closes = np.append(self.chunk_text[1:] != self.chunk_text[:-1], True) if len(self.chunk_end) else np.zeros(0, bool)
        ends = np.where(closes, self.at[self.chunk_text + 1], ends)
        begins = np.where(np.concatenate([[True], closes[:-1]]), self.at[self.chunk_text], self.starts[self.chunk_start]) if len(ends) else ends
        return begins, ends

    def names(self) -> np.ndarray:
        """For the window at each word the least digest among the runs of RUN chunks in its middle."""
        n, size = len(self.starts), self.size
        if n < size or len(self.chunk_start) < RUN:
            return np.zeros(max(0, n - size + 1), np.int64)
        opened, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        opened[self.chunk_start + 1] = closed[self.chunk_end] = 1
        at = np.arange(n - size + 1)
        a = np.cumsum(opened)[at + GEAR_WORDS + self.reach]  # chunks that start before the middle
        b = np.cumsum(closed)[at + size - self.reach] - RUN + 1  # runs that end by its end
        out = np.zeros(len(at), np.int64)
        span, level, width = b - a, self._sums(self.chunk_start[: len(self.chunk_start) - RUN + 1], self.chunk_end[RUN - 1 :]), 1
        while width <= span.max():
            # the least of each ``width`` neighbours covers spans up to twice that by two looks
            mine = np.flatnonzero((span >= width) & (span < 2 * width))
            out[mine] = np.minimum(level[a[mine]], level[b[mine] - width])
            level, width = np.minimum(level[: max(0, len(level) - width)], level[width:]), 2 * width
        return out

    def inside(self) -> np.ndarray:
        """Whether the window at each word lies in one text."""
        n = len(self.starts)
        return self.text[: n - self.size + 1] == self.text[self.size - 1 :] if n >= self.size else np.zeros(0, bool)

    def hashes(self, begin: np.ndarray) -> np.ndarray:
        """Hashes of the windows at the given words."""
        return self._sums(begin, begin + self.size)


def _once(digests: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """(digest, doc_id) without repeats."""
    for order in (slice(None), None):
        order = np.lexsort((digests, docs)) if order is None else order
        digests, docs = digests[order], docs[order]
        new = np.ones(len(digests), bool)
        new[1:] = (digests[1:] != digests[:-1]) | (docs[1:] != docs[:-1])
        digests, docs = digests[new], docs[new]
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(docs, pa.int64())], names=["digest", "doc_id"])


def chunk_digests(docs: DataFrame, size: int) -> DataFrame:
    """(digest, doc_id): the runs of chunks of every text that stand for a window, once a document."""

    def run(batches):
        cut = Chunker(size)
        for part, strings in slices(batches, "text"):
            cut(strings)
            at = np.flatnonzero(cut.inside())
            yield _once(cut.names()[at], part.column(0).to_numpy()[cut.text[at]])

    return docs.select("doc_id", "text").mapInArrow(run, "digest long, doc_id long")


def shared_windows(joined: DataFrame, size: int) -> DataFrame:
    """(digest, doc_id): hashes of the windows whose run of chunks is one of the row's ``__digests``."""

    def run(batches):
        cut = Chunker(size)
        for part, strings in slices(batches, "text"):
            lists = part.column(part.schema.get_field_index("__digests"))
            some = lists.is_valid()
            if not some.true_count:
                continue
            lists, ids = lists.filter(some), part.column(part.schema.get_field_index("doc_id")).filter(some).to_numpy()
            cut(strings.filter(some))
            names, hit = cut.names(), cut.inside()
            for k in range(len(ids)):
                mine = slice(cut.first[k], cut.first[k + 1])
                hit[mine] &= np.isin(names[mine], lists[k].values.to_numpy())
            begin = np.flatnonzero(hit)
            yield _once(cut.hashes(begin), ids[cut.text[begin]])

    return joined.mapInArrow(run, "digest long, doc_id long")


def repeats(pairs: DataFrame, later: bool) -> DataFrame:
    """(__doc, __digests): for each document its digests that another document has, or with ``later`` one with a smaller id."""
    first = pairs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    found = pairs.join(first.select("digest", "first"), "digest")
    if later:
        found = found.where("doc_id > first")
    # dealt first: lists made before the shuffle would hold one digest each and only take room
    found = found.select(F.col("doc_id").alias("__doc"), "digest").repartition("__doc")
    return found.groupBy("__doc").agg(F.collect_list("digest").alias("__digests"))


def _covered(hit: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of the words that lie in windows that are hits; hit has the window at each word that begins one."""
    depth = np.zeros(len(hit) + size + 1, np.int64)
    depth[: len(hit)] += hit
    depth[size : size + len(hit)] -= hit
    edge = np.diff(np.concatenate([[0], np.cumsum(depth) > 0, [0]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """All columns of docs, with ``text`` without repeated passages, and spans: array of (start, end) in bytes of the old text.

    Needs columns doc_id and text. A text without repeats comes back as it was (null stays null); one that repeats
    wholly becomes empty. Rows without doc_id, and a repeat inside one document alone, are left alone. Of rows that
    share a doc_id each is cut alike. An input column ``spans`` is replaced. An empty table gives no rows.

    Both steps shuffle (digest, doc_id) behind a map-side aggregate, and in a join, which Spark splits where a digest is
    in very many documents. Chunks have about four words; window hashes are only made where a window's run of chunks repeats. Both joins of texts with their lists use the same columns, so that the texts are dealt once.
    """
    keyed, size = docs.drop("spans"), passage + 1
    columns = keyed.columns
    rest = [c for c in columns if c != "text"]
    own = keyed.where("doc_id is not null")
    listed = lambda found: keyed.join(found, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    chunked = listed(repeats(chunk_digests(own, size), later=False))
    joined = listed(repeats(shared_windows(chunked, size), later=True))

    def run(batches):
        cut = Chunker(size)
        for part, strings in slices(batches, "text"):
            lists, old = part.column(part.schema.get_field_index("__digests")), part.column(part.schema.get_field_index("text"))
            texts, spans = [], []
            cut(strings)
            data, at, starts, first = cut.data, cut.at, cut.starts, cut.first
            begin = np.flatnonzero(cut.inside())
            hashes, edge = cut.hashes(begin), np.searchsorted(begin, first)
            for k in range(part.num_rows):
                lo, mine, ranges = first[k], slice(edge[k], edge[k + 1]), []
                if lists[k].is_valid and edge[k + 1] > edge[k]:
                    hit = np.zeros(first[k + 1] - lo, bool)
                    hit[begin[mine] - lo] = np.isin(hashes[mine], lists[k].values.to_numpy())
                    ranges = _covered(hit, size)
                if not ranges:
                    texts.append(old[k].as_py())
                    spans.append([])
                    continue
                # a passage takes the white space behind it along, at the beginning of a text also that before it
                edges = np.append(starts[lo : first[k + 1]], at[k + 1]) - at[k]
                edges[0] = 0
                spots = [(int(edges[a]), int(edges[b])) for a, b in ranges]
                body, keep, p = data[at[k] : at[k + 1]].tobytes(), [], 0
                for a, b in spots:
                    keep.append(body[p:a])
                    p = b
                texts.append((b"".join(keep) + body[p:]).decode())
                spans.append([{"start": a, "end": b} for a, b in spots])
            kept = {c: part.column(part.schema.get_field_index(c)) for c in rest}
            kept["text"] = pa.array(texts, pa.string())
            kept["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([kept[c] for c in (*columns, "spans")], names=[*columns, "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return joined.mapInArrow(run, f"{kinds}, spans array<struct<start: long, end: long>>")


