"""Encodes whole texts with a public tokenizer by way of their words.

In both kinds of vocabulary used here no token crosses a single space between two other characters that are not white
space: the byte-level pattern begins a new pre-token at such a space, and the word-level one drops it. So texts are cut
at those spaces, each different unit is encoded once by the library (special strings inside a unit are treated as the
library does by default), and the encodings are joined. Runs of white space stay inside a unit. Cutting, finding equal
units and joining work on whole slices of text at once. The cache of units has a bounded size and only saves time.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from itertools import filterfalse

import numpy as np
import pyarrow as pa

from .rawtext import mix, raw

CACHE = 200_000
SLICE = 1 << 20

#: Bytes beside a space at which a text may be cut: visible ASCII, and behind the space the first byte of a character
#: that is surely no white space. In front of it a character of several bytes is told by its last two.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_NEXT = _VISIBLE.copy()
_NEXT[0xC3:] = True
_NEXT[[0xE1, 0xE2, 0xE3]] = False
_BLANK_TAIL = np.zeros(256, bool)
_BLANK_TAIL[[0xC2, 0x80, 0x81, 0x9A]] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes, behind 0xC3, of the Latin letters with marks from U+00C0 to U+00FF.
_MARKED = np.zeros(256, bool)
_MARKED[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class Cutter:
    """Cuts a slice of texts into units and finds the different ones. ``special``: strings that must not be cut."""

    def __init__(self, spaces_count: bool, special: list[str]) -> None:
        self.spaces_count, self.special = spaces_count, [x.encode() for x in special]

    def __call__(self, strings: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different units, the number of each unit of the texts in order, and each text's first unit."""
        data, at = raw(strings)
        if not len(data):
            return [], np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        space = np.flatnonzero(data == 32)
        space = space[~edge[space] & ~edge[space + 1]]
        before, after = data[space - 1], data[space + 1]
        front = _VISIBLE[before] | (before >= 0x80) & ~_BLANK_TAIL[data[space - 2]]
        space = space[front & _NEXT[after]]
        first = np.zeros(len(data) + 1, bool)
        first[at[:-1]] = True
        first[-1] = False
        first[space] = True
        body = data.tobytes()
        if not any(x in body for x in self.special):
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & _MARKED[data[1:]]
            first[1:-1] |= letter[:-1] & (_VISIBLE & ~_LETTER)[data[1:]]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        owner = np.searchsorted(starts, at)
        if not self.spaces_count:
            starts = starts + ((data[starts] == 32) & ~edge[starts])
        eight = eights(data)
        which = self.number(eight, starts, ends)
        sample = np.empty(int(which.max()) + 1, np.int64)
        sample[which] = np.arange(len(which))
        if not self.same(eight, starts, ends, sample[which]):  # two units share a hash: tell them apart by their bytes
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(body[s:e], len(seen)) for s, e in zip(starts, ends, strict=True)])
            return list(seen), which, owner
        return [body[s:e] for s, e in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)], which, owner

    @staticmethod
    def number(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same number for units of equal bytes; nearly always another one for others."""
        h = mix((ends - starts).astype(np.uint64))
        for todo, (v,) in _loads(eight, ends - starts, starts):
            h[todo] = mix(h[todo] * np.uint64(0x9E3779B97F4A7C15) + v)
        return np.unique(h, return_inverse=True)[1]

    @staticmethod
    def same(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
        """Whether every unit has the bytes of the unit it is taken for."""
        size = ends - starts
        return bool((size == size[like]).all()) and all((v == w).all() for _, (v, w) in _loads(eight, size, starts, starts[like]))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros behind the end."""
    out = data.astype(np.uint64)
    for k in (1, 2, 4):
        out[:-k] |= out[k:] << np.uint64(8 * k)
    return out


def _loads(eight: np.ndarray, size: np.ndarray, *starts: np.ndarray):
    """Eight bytes of each span at a time, from one or more lists of starts: (spans not at their end, values)."""
    todo, done = np.arange(len(size)), 0
    while len(todo):
        left = size[todo] - done
        mask = _MASK[np.minimum(left, 8)]
        yield todo, [eight[s[todo] + done] & mask for s in starts]
        todo, done = todo[left > 8], done + 8


class UnitCache:
    """Maps units to values; ``make`` gets a list of new units. Two generations bound its size."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = CACHE) -> None:
        self.make, self.limit, self.now, self.old = make, limit, {}, {}

    def need(self, lists: list[list[str]]) -> dict:
        """A dictionary that has the units of all lists."""
        if len(self.now) > self.limit:
            self.old, self.now = self.now, {}
        new: set[str] = set()
        for one in lists:
            new.update(filterfalse(self.now.__contains__, one))
        if self.old:
            kept = {u: v for u in new if (v := self.old.get(u)) is not None}
            self.now.update(kept)
            new.difference_update(kept)
        if new:
            order = list(new)
            self.now.update(zip(order, self.make(order), strict=True))
        return self.now


_LOADED: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, loaded once in a worker."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


LETTERS = byte_letters()


def letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(LETTERS)


def merges_only(path: str):
    """The library's BPE model of a file without a cache, which is of no use for words that are new each time."""
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        d = json.load(f)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["merges"]]
    names = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return models.BPE(vocab=d["vocab"], merges=pairs, cache_capacity=0, **{k: d[k] for k in names if d.get(k) is not None})


def special_strings(tok) -> list[str]:
    return [x.content for x in tok.get_added_tokens_decoder().values()]


class Encoder:
    """Slices of texts to their ids. A new word goes to the library's merges directly, any other unit through all of it."""

    def __init__(self, path: str, spaces_count: bool, kind: str) -> None:
        tok, merge = library(path), merges_only(path).tokenize
        self.kind, self.cut = np.dtype(kind), Cutter(spaces_count, special_strings(tok))
        code = {2: "H", 4: "I"}[self.kind.itemsize]
        lead = b" " if spaces_count else None

        def encode(new: list[bytes]) -> list[bytes]:
            words = [_WORD.fullmatch(u, u[:1] == lead) for u in new]
            other = iter(tok.encode_batch_fast([u.decode() for u, w in zip(new, words, strict=True) if not w], add_special_tokens=False))
            out = []
            for u, w in zip(new, words, strict=True):
                if w:
                    if not spaces_count:
                        u = u.lower() if u.isascii() else u.decode().lower().encode()
                    ids = [t.id for t in merge(u.decode("latin-1").translate(LETTERS))]
                else:
                    ids = next(other).ids
                out.append(struct.pack(f"<{len(ids)}{code}", *ids))
            return out

        self.units = UnitCache(encode)

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the place where each text's ids begin (one more than texts)."""
        different, which, owner = self.cut(strings)
        held = self.units.need([different])
        values = [held[u] for u in different]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        flat, begin = np.frombuffer(b"".join(values), self.kind), np.cumsum(sizes) - sizes
        size = sizes[which]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(begin[which] - total[:-1], size) + np.arange(total[-1])
        return flat[place], total[owner]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id behind each text's."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow array with each text's ids as bytes."""
    offsets = (at * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, spaces_count: bool, kind: str = "<u4") -> Encoder:
    """One per worker process, kept between tasks."""
    key = (path, spaces_count, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
