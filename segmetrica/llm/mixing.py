"""Scores of texts by online logistic context mixing, learned from a whole corpus.

A text is the sequence of its lower-cased words, each followed by a space, and one end mark. Every byte is sent as the bits
of a prefix code of its previous byte (256 small codes, from counts of byte pairs over the corpus), so frequent bytes
need few decisions. Each bit has a predictor for each of four contexts: the last two, three and four bytes, and the word so
far. A predictor knows how often the bit was 0 and 1 after its hashed context in the training texts. The predictions are
added on the logistic scale with weights picked by a gate (how often the two longest contexts have been seen). A second
layer with a weight a gate, and an adaptive map from confidence to the share of right predictions, refine every decision: both
follow each text, block by block. The product over all bits is the probability of the text.

The weights a text begins with are fitted on every byte of all training texts: each byte is predicted from the counts of the
corpus without itself, slices add up gradient and curvature of the loss a gate, and one Newton step from plain weights is
taken. Sums don't depend on how the texts are dealt to slices.

Context counts grow with the corpus and are never held in one place. Texts stand in slices of about SLICE bytes. A slice
asks for the contexts it holds, once each, with its own counts; requests are grouped by a hash of the context into
buckets, whose number follows the corpus; a bucket adds the counts up and answers each slice. Frequent contexts are asked
for once a slice, so no bucket gets more rows for one context than there are slices.
"""

from __future__ import annotations

import ctypes
import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rawtext import BYTE_VALUES, mix, raw, text_of, words_of
from .shared import shuffles_removed, written

SLICE = 24 << 20  # bytes of text that share requests
PART = 1 << 20  # bytes of text worked on at once
MERGED = 1 << 20  # distinct bytes of parts that wait to be merged, at least
PIECE = 4 << 20  # a longer text is scored in pieces of whole words, each from the fitted weights on
BUCKET = 16 << 20  # bytes of corpus for each bucket of contexts
BLOCK = 256  # bytes between two updates of a text's weights
CHUNK = 1 << 16  # bytes whose inputs are laid out at once
SPACE, END = 32, 10
ORDERS = (2, 3, 4)
INPUTS = len(ORDERS) + 2  # contexts, the word so far, a constant
CLASSES = 4  # of how often a context was seen: never, once, up to 8 times, more
GATES = CLASSES * CLASSES
STEPS = 17  # of confidence, half a unit of the logistic scale each
REFINED, CERTAIN = 32, np.float32(1e4)  # no code is longer than the 32 bits of a number, so every decision is refined
FEW = 2048  # bytes whose decisions are taken all at once
DOUBT = 0.3  # added to both counts of a bit
RATE, MAP_RATE = 0.002, 0.01  # of a text's weights and of its shares
DRAG = 20.0  # of the plain weights on the fitted ones, in units of curvature
EXACT, FINE = 127, 8  # counts up to the first are told apart one by one, larger ones in so many steps an octave

_HASH_MULT = np.uint64(0x9E3779B97F4A7C15)


# --- texts as bytes -----------------------------------------------------------------------

@dataclass
class Stream:
    """Symbols of some texts: bytes, start of each text (one more than texts), texts' words, and starts of words so far."""

    body: np.ndarray
    at: np.ndarray
    words: np.ndarray


def stream(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> Stream:
    """Words and spaces of each text; an end mark behind those for which ``ends`` is set."""
    low, starts, stops, first = words_of(data, at)
    sizes = stops - starts + 1
    words = np.diff(first)
    whole = np.concatenate([[0], np.cumsum(sizes)])[first]
    text_at = whole + np.concatenate([[0], np.cumsum(ends.astype(np.int64))])
    body = np.empty(int(text_at[-1]), np.uint8)
    inner = np.ones(len(body), bool)
    shift = np.repeat(text_at[:-1] - whole[:-1], words)
    spaces = np.cumsum(sizes) - 1 + shift
    marks = text_at[1:][ends] - 1
    inner[spaces] = inner[marks] = False
    body[spaces], body[marks] = SPACE, END
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    body[inner] = low[~gap[low]]
    return Stream(body, text_at, words)


def before(s: Stream, k: int) -> np.ndarray:
    """The byte k places back, an end mark before a text's start."""
    n = len(s.body)
    out = np.full(n, END, np.uint8)
    out[k:] = s.body[: max(0, n - k)]
    for j in range(k):
        p = s.at[:-1] + j
        out[p[p < n]] = END
    return out


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse modulo 2**64, kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = (_HASH_MULT, np.uint64(pow(int(_HASH_MULT), -1, 1 << 64)))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m)])) for m in both]
    return _POWERS[0], _POWERS[1]


def word_contexts(s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """46-bit hashes of the word so far at every byte, and its length."""
    n = len(s.body)
    start = np.zeros(n, np.int64)
    opens = np.flatnonzero(s.body[:-1] == SPACE) + 1
    start[opens] = opens
    first = s.at[:-1][s.at[:-1] < n]
    start[first] = first
    np.maximum.accumulate(start, out=start)
    age = np.arange(n) - start
    with np.errstate(over="ignore"):
        # differences of a running sum of weighted bytes, brought back to the word's start
        forth, back = powers(n)
        total = np.zeros(n, np.uint64)
        np.cumsum((BYTE_VALUES[s.body] * forth[:n])[:-1], out=total[1:])
        value = (total - total[start]) * back[start]
        return mix(value + age.astype(np.uint64)) >> np.uint64(18), age


def pieces(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all strings, cut points between pieces of at most about PIECE bytes, and each piece's string."""
    data, at = raw(strings)
    cuts, owner = [0], []
    for k in range(len(at) - 1):
        lo, hi = int(at[k]), int(at[k + 1])
        while hi - lo > PIECE:
            gap = np.flatnonzero(np.isin(data[lo + PIECE : hi], (9, 10, 11, 12, 13, 32))[: hi - lo - PIECE])
            if not len(gap):
                break
            lo += PIECE + int(gap[0])
            cuts.append(lo)
            owner.append(k)
        cuts.append(hi)
        owner.append(k)
    return data, np.array(cuts, np.int64), np.array(owner, np.int64)


def parts(strings: pa.Array):
    """(first, stop) of consecutive pieces of about PART bytes, with their stream and owners."""
    data, at, owner = pieces(strings)
    k, n = 0, len(owner)
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    while k < n:
        stop = int(np.searchsorted(at, at[k] + PART, side="right")) - 1
        stop = min(n, max(k + 1, stop))
        yield stream(data[at[k] : at[stop]], at[k : stop + 1] - at[k], last[k:stop]), owner[k:stop]
        k = stop


# --- codes of bytes -----------------------------------------------------------------------

@dataclass
class Codes:
    """For each previous byte: place of every byte in code order, and length and bits of the code at each place."""

    place: np.ndarray
    length: np.ndarray
    bits: np.ndarray


def code_lengths(counts: np.ndarray) -> list[int]:
    least = int(counts.sum()) >> 14
    heap = [(max(int(c), least) + 1, k, (k,)) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    out, made = [0] * len(counts), len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in (*a[2], *b[2]):
            out[k] += 1
        made += 1
        heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
    return out


def codes_of(pairs: np.ndarray) -> Codes:
    """Canonical codes, shorter ones first, from counts of (previous byte, byte)."""
    found = Codes(np.zeros((256, 256), np.uint8), np.zeros((256, 256), np.uint8), np.zeros((256, 256), np.uint32))
    default = code_lengths(pairs.sum(axis=0))
    for b in range(256):
        sizes = code_lengths(pairs[b]) if pairs[b].any() else default
        order = sorted(range(256), key=lambda k: (sizes[k], k))
        code, size = 0, sizes[order[0]]
        for p, k in enumerate(order):
            code <<= sizes[k] - size
            size = sizes[k]
            found.place[b, k], found.length[b, p], found.bits[b, p] = p, size, code
            code += 1
    return found


# --- contexts -----------------------------------------------------------------------------

#: Bit 62 marks keys of the word so far: a hash of 46 bits, its last byte, a place. Others hold the order in bits 40 to 43
#: above up to four bytes and a place.
_WORD = np.uint64(1 << 62)


def keys_of(s: Stream, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context, place of the byte) of the longest order and of the word so far, and the length of the latter."""
    last = before(s, 1)
    place = codes.place.ravel()[last.astype(np.int32) << 8 | s.body].astype(np.uint64)
    place |= last.astype(np.uint64) << np.uint64(8)
    further = np.zeros(len(last), np.uint32)
    for k in range(2, max(ORDERS) + 1):
        further |= before(s, k).astype(np.uint32) << np.uint32(8 * (k - 2))
    gram = further.astype(np.uint64) << np.uint64(16)
    gram |= place
    gram |= np.uint64(max(ORDERS) << 40)
    hashes, age = word_contexts(s)
    return gram, _WORD | hashes << np.uint64(16) | place, age


def shorter(gram: np.ndarray, order: int) -> np.ndarray:
    """Keys of a shorter order."""
    return gram & np.uint64((1 << 8 * (order + 1)) - 1) | np.uint64(order) << np.uint64(40)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[edge], np.add.reduceat(counts[order], edge)


def distinct(strings: pa.Array, train: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bytes in their contexts: keys of the longest order, of the word so far, and counts in the training texts.

    Up to the fourth byte of a word the longest order knows the whole word so far, behind it the word so far knows the
    longest order: one key names both.
    """
    held, waiting, whole = [], 0, 0  # whole: entries of the first list, in which names have come together already
    for s, owner in parts(strings):
        gram, word, age = keys_of(s, codes)
        name = np.where(age < max(ORDERS), gram, word)
        held.append(together(name, gram, word, np.repeat(train[owner], np.diff(s.at)).astype(np.uint8)))
        waiting += len(held[-1][0])
        if waiting > max(MERGED, whole):
            held = [together(*joined(held))]
            waiting, whole = 0, len(held[0][0])
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    name, gram, word, n = joined(held)
    if not len(name):
        return gram, word, n.astype(np.int64)
    order = np.argsort(name)
    name = name[order]
    edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    first = order[edge]
    return gram[first], word[first], np.add.reduceat(n[order], edge, dtype=np.int64)


def joined(lists: list[tuple]) -> list[np.ndarray]:
    """Lists of columns end to end. Empties the list, so that a column goes as soon as it is copied."""
    columns = [list(c) for c in zip(*lists)]
    lists.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def together(name: np.ndarray, gram: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of equal names as one, with the sum of n. Names come together by a hash with the place below; names that share a
    hash may alternate and then stay apart."""
    if not len(name):
        return name, gram, word, n.astype(np.uint32)
    bits = np.uint64(len(name).bit_length())
    order = name * _HASH_MULT
    order >>= bits
    order <<= bits
    order |= np.arange(len(name), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    name = name[order]
    edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    first = order[edge]
    return name[edge], gram[first], word[first], np.add.reduceat(n[order], edge, dtype=np.uint32)


def numbered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``tally``, and the order of the keys and the place of each one's key among the distinct ones."""
    if not len(keys):
        return keys, counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    edge, place = np.flatnonzero(new), np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[edge], np.add.reduceat(counts[order], edge), order, place


def contexts_of(gram: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all contexts of distinct bytes, in order, and their counts; the bytes' order by the word so far, and
    the places of both keys of each."""
    longest, m, _, gram_at = numbered(gram, n)
    words, w, order, word_at = numbered(word, n)
    # longer orders have higher keys, words the highest: the whole is in order
    found = [tally(shorter(longest, k), m) for k in ORDERS[:-1]]
    below = sum(len(k) for k, _ in found)
    keys, counts = (np.concatenate(x) for x in zip(*found, (longest, m), (words, w)))
    return keys, counts, order, gram_at + below, word_at + below + len(longest)


def requests(strings: pa.Array, train: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all contexts of the texts, in order, and their counts in the training ones."""
    return contexts_of(*distinct(strings, train, codes))[:2]


def previous_byte(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8) & np.uint64(255)).astype(np.uint8)


@dataclass
class Predictions:
    """For keys in order: how often the context was seen (in steps), end of its predictions, predictions on the logistic scale
    in steps of 1/16."""

    seen: np.ndarray
    at: np.ndarray
    bits: np.ndarray


def steps_of(seen: np.ndarray) -> np.ndarray:
    """Counts as single bytes: exact up to EXACT."""
    above = EXACT + np.rint(FINE * np.log2(np.maximum(seen, EXACT) / EXACT))
    return np.where(seen <= EXACT, seen, np.minimum(above, 255)).astype(np.uint8)


def counts_of(steps: np.ndarray) -> np.ndarray:
    return np.where(steps <= EXACT, steps, EXACT * np.exp2((steps.astype(np.float32) - EXACT) / FINE)).astype(np.float32)


def class_of(seen: np.ndarray) -> np.ndarray:
    """Class of a context that was seen so often; steps may stand for counts."""
    return np.digitize(seen, (1, 2, 9)).astype(np.uint8)


def predictions(keys: np.ndarray, counts: np.ndarray, codes: Codes) -> Predictions:
    """What each context says about the bits of each of its keys.

    keys are distinct and in order, so the bytes of a context stand in code order, and the bytes below a node of the code
    stand together: counts of both branches are differences of running sums.
    """
    n, prev = len(keys), previous_byte(keys)
    place = (keys & np.uint64(255)).astype(np.int64)
    context = keys >> np.uint64(8)
    edge = np.concatenate([[True], context[1:] != context[:-1]]) if n else np.zeros(0, bool)
    group = np.cumsum(edge) - 1
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], n)
    total = np.concatenate([[0], np.cumsum(counts)])
    seen = (total[stop] - total[start])[group] if n else np.zeros(0, np.int64)
    length = np.where(seen > 0, codes.length[prev, place], 0).astype(np.int64)
    code = codes.bits[prev, place].astype(np.int64)
    size = codes.length[prev, place].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(at[-1]), np.int8)
    lo, hi = (start[group], stop[group]) if n else (place, place)
    live = np.flatnonzero(length > 0)
    depth = 0
    while len(live):
        bit = np.zeros(n, np.int64)
        more = size > depth
        bit[more] = code[more] >> (size[more] - 1 - depth) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - bit)])
        a, b = lo[live], hi[live]
        mid = a + zeros[b] - zeros[a]
        n0, n1 = total[mid] - total[a], total[b] - total[mid]
        out[at[live] + depth] = np.clip(np.rint(16 * np.log((n1 + DOUBT) / (n0 + DOUBT))), -127, 127)
        one = bit[live] == 1
        lo[live], hi[live] = np.where(one, mid, a), np.where(one, b, mid)
        depth += 1
        live = live[length[live] > depth]
    return Predictions(steps_of(seen), at, out)


def is_word(keys: np.ndarray, codes: Codes) -> np.ndarray:
    """Keys of a whole word: a space behind the word so far, which isn't empty (no word holds a space or an end mark)."""
    prev = previous_byte(keys)
    return (keys >= _WORD) & ((keys & np.uint64(255)) == codes.place[prev, SPACE]) & (prev != SPACE) & (prev != END)


class Places:
    """Where keys stand in a list of distinct keys: a table of open addresses, filled and asked for many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several the last one stays
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], slot[~won] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _HASH_MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero(self.keys[slot] != keys)
        wrong = wrong[out[wrong] >= 0]
        while len(wrong):
            slot_w = slot[wrong] + 1 & (1 << self.bits) - 1
            slot[wrong] = slot_w
            out[wrong] = self.at[slot_w]
            wrong = wrong[(self.keys[slot_w] != keys[wrong]) & (out[wrong] >= 0)]
        return out


@dataclass
class Answers:
    """What a slice got back: distinct keys in order, how often each context was seen (in steps), predictions end to end, counts of words."""

    keys: np.ndarray
    seen: np.ndarray
    bits: np.ndarray
    words: np.ndarray


class Lookup:
    """Predictions of all contexts of a slice's texts."""

    def __init__(self, found: Answers, codes: Codes) -> None:
        self.codes, self.found = codes, found
        prev = previous_byte(found.keys)
        self.kind = class_of(found.seen)
        self.size = codes.length[prev, found.keys & np.uint64(255)].astype(np.int32)
        self.code = codes.bits[prev, found.keys & np.uint64(255)]
        held = np.where(self.kind > 0, self.size, 0)
        # contexts never seen share the zeros behind all predictions
        self.begin = np.where(self.kind > 0, np.cumsum(held) - held, len(found.bits))
        self.bits = np.concatenate([found.bits, np.zeros(int(self.size.max(initial=0)), np.int8)])
        # keys of the longest order stand together; each knows where those of the shorter ones are
        self.first, stop = (int(np.searchsorted(found.keys, k)) for k in (np.uint64(max(ORDERS) << 40), _WORD))
        longest = found.keys[self.first : stop]
        self.below = [np.searchsorted(found.keys, shorter(longest, k)) for k in ORDERS[:-1]]

    @property
    def at(self) -> np.ndarray:
        """Where each key's predictions begin, and the end of all."""
        return np.concatenate([[0], np.cumsum(np.where(self.kind > 0, self.size, 0))])

    @cached_property
    def places(self) -> Places:
        return Places(self.found.keys)

    @cached_property
    def count(self) -> np.ndarray:
        """How often each key's word came, for keys of whole words."""
        out = np.zeros(len(self.found.keys), np.int64)
        out[is_word(self.found.keys, self.codes)] = self.found.words
        return out

    def inputs(self, gram: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For keys of single bytes: inputs of every bit, end to end; the gate; and the class of the word's context."""
        x, gate, last = self.inputs_at(self.places(gram), self.places(word), self.bits, self.kind)
        return x.T, gate, last

    def inputs_at(self, gram: np.ndarray, word: np.ndarray, bits: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from places of keys, predictions and classes; a row of inputs for each predictor."""
        ids = [b[gram - self.first] for b in self.below] + [gram, word]
        size = self.size[word]
        ends = np.cumsum(size)
        inner = np.arange(int(ends[-1]) if len(ends) else 0)
        x = np.empty((INPUTS, len(inner)), np.float32)
        for c, i in enumerate(ids):
            at = np.repeat(self.begin[i] - (ends - size), size)
            at += inner
            np.multiply(bits[at], np.float32(1 / 16), out=x[c])
        x[-1] = 0.3
        last = kind[word].astype(np.int64)
        return x, kind[gram].astype(np.int64) * CLASSES + last, last

    def left_out(self) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of all keys and classes of their contexts, had the key's byte come once less.

        Counts are read back from the predictions: a context's count gives those of the first bit, the bit that came
        those of the next. Keys that no training text holds have none to leave out; theirs mean nothing.
        """
        seen = counts_of(self.found.seen)
        bits = np.zeros_like(self.bits)
        live, n, depth = np.flatnonzero(self.kind > 0), seen.copy(), 0
        while len(live):
            at = self.begin[live] + depth
            sign = np.where(self.code[live] >> (self.size[live] - 1 - depth).astype(np.uint32) & 1 == 1, np.float32(1), np.float32(-1))
            total = n[live]
            share = logistic(sign * self.bits[at] * np.float32(1 / 16))
            same = np.clip(np.rint((total + np.float32(2 * DOUBT)) * share - np.float32(DOUBT)), 0, total)
            odds = np.log((np.maximum(same - 1, 0) + np.float32(DOUBT)) / (total - same + np.float32(DOUBT)))
            bits[at] = np.clip(np.rint(16 * sign * odds), -127, 127)
            n[live] = same
            depth += 1
            live = live[self.size[live] > depth]
        return bits, np.where(self.kind > 0, class_of(seen - 1), 0)

    def value_of(self, entry: np.ndarray) -> np.ndarray:
        """Bits of the codes of single bytes, end to end, as -1 and 1."""
        size = self.size[entry]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        bit = np.repeat(self.code[entry], size) >> (np.repeat(size, size) - 1 - inner).astype(np.uint32) & 1
        return bit.astype(np.float32) * 2 - 1


# --- mixing -------------------------------------------------------------------------------

@dataclass
class Start:
    """Weights (gate, input), and the share of right predictions by (class, confidence), a text begins with."""

    weights: np.ndarray
    right: np.ndarray


def plain_start() -> Start:
    weights = np.full((GATES, INPUTS), 0.4, np.float32)
    weights[:, -1] = 0
    middle = (np.arange(STEPS) + 0.5) / 2
    return Start(weights, np.tile(1 / (1 + np.exp(-middle)), (CLASSES, 1)).astype(np.float32))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit_sums(lookup: Lookup, gram: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(gate, inputs, 1 + inputs): gradient and curvature of the loss of the plain weights over training bytes.

    Places of the keys of distinct bytes, and how often each came. A byte is predicted from all counts but its own.
    """
    bits, kind = lookup.left_out()
    weights, out = plain_start().weights, np.zeros((GATES, INPUTS, 1 + INPUTS))
    order = np.argsort(kind[gram] * np.uint8(CLASSES) + kind[word], kind="stable")
    for a in range(0, len(order), CHUNK):
        at = order[a : a + CHUNK]
        x, gate, _ = lookup.inputs_at(gram[at], word[at], bits, kind)
        size = lookup.size[word[at]]
        times = np.repeat(n[at], size).astype(np.float32)
        came = (lookup.value_of(word[at]) + 1) / 2
        # bytes stand by gate, so those of a gate are one block
        edges = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(gate, np.arange(GATES + 1))]
        for g, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo == hi:
                continue
            rows, t = x[:, lo:hi], times[lo:hi]
            p = logistic(np.clip(weights[g] @ rows, -30, 30))
            out[g, :, 0] += rows @ (t * (came[lo:hi] - p))
            out[g, :, 1:] += rows @ (rows * (t * p * (1 - p))).T
    return out


def fitted_start(sums: np.ndarray) -> Start:
    """One Newton step from the plain weights."""
    start = plain_start()
    move = np.linalg.solve(sums[:, :, 1:] + DRAG * np.eye(INPUTS), sums[:, :, :1])[:, :, 0]
    return Start((start.weights + move).astype(np.float32), start.right)


class Mixer:
    """Scores the texts of a slice.

    The first layer adds the predictors with the starting weights; it gives the same for the same contexts, so it is
    computed once for each distinct byte in its context: up to the fourth byte of a word the longest order knows the whole
    word so far, behind it the word so far knows the longest order, and one key names both. The second layer follows each
    text: a weight for each gate, and the shares of right predictions, both moved after every block of BLOCK bytes. It
    refines all decisions of each byte.
    """

    def __init__(self, lookup: Lookup, start: Start) -> None:
        self.lookup, self.start = lookup, start
        n = len(lookup.size)
        # logistic scale, from the side of the bit that came: the decisions of a byte stand together
        # a byte's record is one number, so that one look finds it: where its decisions begin, how many there are, the gate
        self.bits, self.ready = np.zeros(int(lookup.size.sum()), np.float32), np.zeros(n, bool)
        self.records = (np.cumsum(lookup.size, dtype=np.int64) - lookup.size) << 16 | lookup.size << 8

    @property
    def z(self) -> list[np.ndarray]:
        """The first, second, ... decision of every byte; one that a short code lacks is certain."""
        out = [np.full(len(self.ready), CERTAIN, np.float32) for _ in range(REFINED)]
        for k, column in enumerate(out):
            has = self.lookup.size > k
            column[has] = self.bits[(self.records[has] >> 16) + k]
        return out

    @property
    def rest(self) -> np.ndarray:
        """Logarithm of the probability of decisions that are not refined: there are none."""
        return np.zeros(len(self.ready))

    def first_layer(self, gram: np.ndarray, word: np.ndarray, entry: np.ndarray) -> None:
        new = np.flatnonzero(~self.ready[entry])
        if not len(new):
            return
        if len(new) > len(self.ready) // 8:
            pick = np.full(len(self.ready), -1, np.int32)
            pick[entry[new]] = new
            new = pick[pick >= 0]
        else:
            new = new[np.unique(entry[new], return_index=True)[1]]
        for a in range(0, len(new), CHUNK):
            at = new[a : a + CHUNK]
            e = entry[at]
            # one of both keys names the byte, so its place is known
            g, w, long = e.copy(), e.copy(), self.lookup.found.keys[e] >= _WORD
            g[long], w[~long] = self.lookup.places(gram[at[long]]), self.lookup.places(word[at[~long]])
            x, gate, _ = self.lookup.inputs_at(g, w, self.lookup.bits, self.lookup.kind)
            size = self.lookup.size[e]
            weights = self.start.weights.T[:, gate]
            z = np.zeros(x.shape[1], np.float32)
            for row, weight in zip(x, weights):
                row *= np.repeat(weight, size)
                z += row
            z[z == 0] = 1e-5  # so that the other bit is on the other side
            z = np.clip(z, -8, 8) * self.lookup.value_of(e)
            self.bits[np.repeat((self.records[e] >> 16) - (np.cumsum(size) - size), size) + np.arange(len(z))] = z
            self.records[e] |= gate
            self.ready[e] = True

    def __call__(self, s: Stream) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithm of the probability of every text, and the count of every word."""
        texts = len(s.at) - 1
        gram, word, age = keys_of(s, self.lookup.codes)
        short = age < max(ORDERS)
        entry = self.lookup.places(np.where(short, gram, word))
        ends = np.flatnonzero(s.body == SPACE)
        whole = entry[ends]  # a long word's key names its count, a short one has to be looked up
        whole[short[ends]] = self.lookup.places(word[ends[short[ends]]])
        counts = self.lookup.count[whole]
        self.first_layer(gram, word, entry)
        # lanes are texts by falling length, so the lanes of a round are the first ones
        blocks = -(-np.diff(s.at) // BLOCK)
        lanes = np.argsort(-blocks, kind="stable")
        blocks = blocks[lanes]
        self.logs = np.zeros(texts)
        self.scale = np.ones((texts, GATES), np.float32)
        self.right = np.tile(self.start.right, (texts, 1, 1))
        lane = np.repeat(np.arange(texts), blocks)
        number = np.arange(len(lane)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        order = np.argsort(number, kind="stable")
        lane, number = lane[order], number[order]
        lo = s.at[lanes[lane]] + number * BLOCK
        hi = np.minimum(lo + BLOCK, s.at[lanes[lane] + 1])
        rounds = np.searchsorted(number, np.arange(int(blocks.max(initial=0)) + 1))
        for a, b in zip(rounds[:-1], rounds[1:]):
            width = hi[a:b] - lo[a:b]
            edges = np.concatenate([[0], np.cumsum(width)])
            pos = np.repeat(lo[a:b] - edges[:-1], width) + np.arange(edges[-1])
            self._round(entry[pos], np.repeat(lane[a:b], width), edges)
        out = np.empty(texts)
        out[lanes] = self.logs
        return out, counts

    def _round(self, entry: np.ndarray, owner: np.ndarray, edges: np.ndarray) -> None:
        """Predicts the bytes of a round, whose lanes are cut at ``edges``, then moves their weights and shares."""
        lanes, cells = len(edges) - 1, 2 * STEPS
        scale, right = self.scale[:lanes].reshape(-1), self.right[:lanes]
        record = self.records.take(entry)
        # bytes by falling length of their codes, so those that have a further decision are the first ones
        size = (record >> 8 & 255).astype(np.uint8)
        order = np.argsort(255 - size, kind="stable")
        record, owner, size = record.take(order), owner.take(order), size.take(order)
        gate, at = record & 255, record >> 16
        row = owner * GATES + gate
        weight = scale.take(row)
        base = (owner * CLASSES + gate % CLASSES) * cells  # the gate's last part is the class of the word so far
        # shares by signed confidence: that the bit came which the sign speaks for or against
        signed = np.concatenate([1 - right[:, :, ::-1], right], axis=2)
        flat = signed.reshape(-1)
        seen = np.zeros(len(flat), np.int64)

        def decide(x: np.ndarray, weight: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Twice the probabilities of some decisions, and the slopes of their logarithms."""
            z = x * weight
            p = np.exp(-z)
            p += 1
            np.reciprocal(p, out=p)
            z *= 2
            z += STEPS
            np.clip(z, 0, cells - 1, out=z)
            cell = z.astype(np.int64)
            cell += base
            np.add(seen, np.bincount(cell, minlength=len(flat)), out=seen)
            q = flat.take(cell)
            q += p
            np.subtract(1, p, out=p)
            p *= x
            return q, p

        live = len(size) - np.cumsum(np.bincount(size))[:-1]  # bytes that have a first, a second decision and so on
        logs, slope = -np.log(2) * size, np.zeros(len(size), np.float32)  # the mean of both
        product = np.ones(len(size), np.float32)
        for k, m in enumerate(live):
            if m < FEW:  # all further decisions at once
                left = size[:m] - np.int64(k)
                first = np.cumsum(left) - left
                byte = np.repeat(np.arange(m), left)
                q, p = decide(self.bits.take((at[:m] + k - first).take(byte) + np.arange(len(byte))), weight.take(byte), base.take(byte))
                logs[:m] += np.add.reduceat(np.log(q), first)
                slope[:m] += np.add.reduceat(p, first)
                break
            q, p = decide(self.bits.take(at[:m] + k), weight[:m], base[:m])
            slope[:m] += p
            product[:m] *= q
            if k % 3 == 2:  # no three are too small a number
                logs += np.log(product)
                product[:] = 1
        logs += np.log(product)
        self.logs[:lanes] += np.bincount(owner, logs, lanes)
        scale += (RATE * np.bincount(row, slope, len(scale))).astype(np.float32)
        np.clip(scale, 0.2, 3, out=scale)
        seen = seen.reshape(signed.shape)
        hit, miss = seen[:, :, STEPS:], seen[:, :, STEPS - 1 :: -1]
        right += ((hit - (hit + miss) * right) * MAP_RATE / (1 + MAP_RATE * (hit + miss))).astype(np.float32)


def answer(keys: np.ndarray, counts: np.ndarray, codes: Codes) -> Answers:
    """Answers to all keys from the counts of the very same keys."""
    found = predictions(keys, counts, codes)
    return Answers(keys, found.seen, found.bits, counts[is_word(keys, codes)])


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes (all lowest ones first), compressed: sorted keys as differences shrink to half."""
    flat = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(flat, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = pa.Codec("zstd").decompress(data[8:], n * size)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def released() -> None:
    """Gives freed memory back to the system: a Python worker lives on, and the allocators would keep what one slice took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # the GNU library's
        trim(0)


def giving_back(f, *tables: pa.Table) -> pa.Table:
    """f of tables, with memory given back before and after. Before, as the worker may have served other steps."""
    released()
    try:
        return f(*tables)
    finally:
        released()


# --- the corpus ---------------------------------------------------------------------------

def statistics(docs: DataFrame, train: Column) -> dict[str, np.ndarray | int]:
    """Words and texts of the training texts, bytes of all, and counts of byte pairs (at most 65,536), which set the codes.

    Pairs are those of the plain texts, white space as spaces: a code need not be the best one.
    """
    def run(batches):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        lower[[9, 10, 11, 12, 13]] = SPACE
        pairs, words, texts, size = np.zeros(1 << 16, np.int64), 0, 0, 0
        for batch in batches:
            flags = np.asarray(batch.column(1).fill_null(False))
            strings = text_of(batch, "text")
            size += int(raw(strings)[1][-1])
            texts += int(flags.sum())
            learned = strings.filter(pa.array(flags))
            for at in range(0, len(learned), 256):
                data, edges = raw(learned.slice(at, 256))
                body = np.full(len(data) + len(edges), SPACE, np.uint8)
                inner = np.ones(len(body), bool)
                inner[edges + np.arange(len(edges))] = False  # a space before each text and behind the last
                body[inner] = lower[data]
                blank = body == SPACE
                words += int(np.count_nonzero(blank[:-1] & ~blank[1:]))
                pairs += np.bincount(body[:-1].astype(np.uint16) << 8 | body[1:], minlength=1 << 16)
        at = np.flatnonzero(pairs)
        names, sums = np.concatenate([at, [-1, -2, -3]]), np.concatenate([pairs[at], [words, texts, size]])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(sums, pa.int64())], names=["name", "n"])

    rows = docs.select("text", train.alias("train")).mapInArrow(run, "name int, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
    found = {r["name"]: int(r["n"]) for r in rows}
    pairs = np.zeros(1 << 16, np.int64)
    for k, v in found.items():
        if k >= 0:
            pairs[k] = v
    return {"pairs": pairs.reshape(256, 256), "words": found.get(-1, 0), "texts": found.get(-2, 0), "bytes": found.get(-3, 0)}


def sliced(docs: DataFrame, train: Column, key: str) -> DataFrame:
    """(slice, rows): consecutive rows (key, text, train) of about SLICE bytes share a slice, packed by some PIECE bytes. Written,
    so every reader sees the same."""
    def run(batches):
        task, made, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            at = raw(text_of(batch, "text"))[1]
            first, held = 0, 0
            for k, n in enumerate(np.diff(at).tolist()):
                full = size and size + n > SLICE
                if full or held and held + n > PIECE:
                    yield pack(batch.slice(first, k - first), (task << 32) + made)
                    first, held = k, 0
                if full:
                    made, size = made + 1, 0
                size += n + 32
                held += n
            if first < batch.num_rows:
                yield pack(batch.slice(first), (task << 32) + made)

    def pack(rows, number):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_batch(rows)
        packed_rows = pa.array([sink.getvalue().to_pybytes()] if rows.num_rows else [], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number] * len(packed_rows), pa.int64()), packed_rows], names=["slice", "rows"])

    rows = docs.select(F.col(key).alias("key"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    return written(rows.mapInArrow(run, "slice long, rows binary"), "slices")


def rows_of(table: pa.Table) -> pa.Table:
    """The rows of a slice."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("rows").to_pylist()])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key's context. Words so far, hashes already, are dealt by ranges: their keys stay dense, and pack well."""
    word = keys >= _WORD
    spread = mix(keys >> np.uint64(8))
    spread[word] = keys[word] << np.uint64(2)  # the hash is at the top
    return ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def asked(slices: DataFrame, codes: Codes, buckets: int) -> DataFrame:
    """(bucket, slice, keys, counts, times): a slice's distinct keys, packed by bucket of their context.

    One more row a slice, in a bucket of its own below 0, lists its distinct training bytes: places of their keys of the
    longest order and of the word so far among the slice's keys in order, and how often each came.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = table.column("slice")[0].as_py()
        rows = rows_of(table)
        gram, word, n = distinct(texts_of(rows), np.asarray(rows.column("train").combine_chunks()), codes)
        keys, counts, learned, gram_at, word_at = contexts_of(gram, word, n)
        learned = learned[n[learned] > 0]
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, counts = bucket[order], keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]) if len(bucket) else [])
        return pa.table({
            "bucket": np.append(bucket[at[:-1]], -1 - number), "slice": np.full(max(len(at), 1), number),
            "keys": pa.array([*[packed_keys(keys[a:b]) for a, b in zip(at, at[1:])], packed(gram_at[learned].astype(np.uint32))], pa.binary()),
            "counts": pa.array([*[packed(counts[a:b].astype(np.uint32)) for a, b in zip(at, at[1:])], packed_keys(word_at[learned].astype(np.uint64))], pa.binary()),
            "times": pa.array([None] * max(len(at) - 1, 0) + [packed(n[learned].astype(np.uint32))], pa.binary()),
        })

    return slices.groupBy("slice").applyInArrow(lambda table: giving_back(run, table), "bucket long, slice long, keys binary, counts binary, times binary")


def texts_of(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return (column.cast(pa.string()) if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks).cast(pa.string())).fill_null("")


def answered(requests_: DataFrame, codes: Codes) -> DataFrame:
    """(slice, keys, seen, bits, words, new, times): each slice's keys with what all training texts say, and words it is the first to
    ask for. Lists of training bytes go through: places in keys and seen, and times, which is null elsewhere."""
    schema = "slice long, keys binary, seen binary, bits binary, words binary, new long, times binary"

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table({"slice": table.column("slice"), "keys": table.column("keys"), "seen": table.column("counts"), "bits": none,
                             "words": none, "new": pa.array([0] * table.num_rows, pa.int64()), "times": table.column("times")})
        slices = table.column("slice").to_numpy()
        keys = [unpacked_keys(b) for b in table.column("keys").to_pylist()]
        counts = [unpacked(b, np.uint32).astype(np.int64) for b in table.column("counts").to_pylist()]
        every, total, _, place = numbered(np.concatenate(keys), np.concatenate(counts))
        place = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        found = predictions(every, total, codes)
        size = np.diff(found.at)
        word = is_word(every, codes)
        new = word & (total > 0)
        out = {n: [] for n in ("slice", "keys", "seen", "bits", "words", "new", "times")}
        for k in np.argsort(slices, kind="stable"):
            at = place[k]
            where = spread(found.at[at], size[at])
            out["slice"].append(int(slices[k]))
            out["keys"].append(packed_keys(keys[k]))
            out["seen"].append(packed(found.seen[at]))
            out["bits"].append(packed(found.bits[where]))
            out["words"].append(packed(total[at[word[at]]]))
            mine = at[(counts[k] > 0) & new[at]]
            out["new"].append(len(mine))
            out["times"].append(None)
            new[mine] = False  # a training word counts once, with the first slice that holds it
        kinds = {"slice": pa.int64(), "new": pa.int64()}
        return pa.table(out, schema=pa.schema([(n, kinds.get(n, pa.binary())) for n in out]))

    return requests_.groupBy("bucket").applyInArrow(lambda table: giving_back(run, table), schema)


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``at``, end to end."""
    out = np.repeat(at - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def gather(rows: pa.Table, codes: Codes) -> Answers:
    """A slice's answers from all buckets as one list in order of keys."""
    def joined(name, kind):
        return np.concatenate([np.zeros(0, kind), *[unpacked(b, kind) for b in rows.column(name).to_pylist()]])

    keys = np.concatenate([np.zeros(0, np.uint64), *[unpacked_keys(b) for b in rows.column("keys").to_pylist()]])
    seen, bits, words = joined("seen", np.uint8), joined("bits", np.int8), joined("words", np.int64)
    size = np.where(seen > 0, codes.length[previous_byte(keys), keys & np.uint64(255)], 0).astype(np.int64)
    at = np.cumsum(size) - size
    order = np.argsort(keys)
    sorted_bits = np.concatenate([np.zeros(0, np.int8), *[bits[spread(at[k], size[k])] for k in np.split(order, range(CHUNK, len(order), CHUNK))]])
    count = np.zeros(len(keys), np.int64)
    count[is_word(keys, codes)] = words
    keys = keys[order]
    return Answers(keys, seen[order], sorted_bits, count[order][is_word(keys, codes)])


def fitted(replies: DataFrame, codes: Codes) -> Start:
    """Starting weights from every training byte: sums of all slices (a few hundred numbers each), one step on the driver."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(table.column("times").is_valid())
        lookup = Lookup(gather(table.filter(table.column("times").is_null()), codes), codes)
        sums = np.zeros((GATES, INPUTS, 1 + INPUTS))
        for gram, word, n in zip(*(own.column(c).to_pylist() for c in ("keys", "seen", "times"))):
            sums += fit_sums(lookup, unpacked(gram, np.uint32).astype(np.int64), unpacked_keys(word).astype(np.int64), unpacked(n, np.uint32))
        at = np.flatnonzero(sums)
        return pa.table({"cell": at, "value": sums.ravel()[at]})

    rows = replies.groupBy("slice").applyInArrow(lambda table: giving_back(run, table), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((GATES, INPUTS, 1 + INPUTS))
    for r in rows:
        sums.ravel()[r["cell"]] = r["value"]
    return fitted_start(sums)


def score(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """Scores of all texts by a model of those for which ``train`` is true (null: false).

    Returns a row for each row of docs: key, n_tokens (words and an end), n_known (tokens that training texts hold),
    train_tokens, base_score (log10 of add-one unigrams), score (log10 of the model's probability), bits_per_byte
    (score over the text's bytes as words, spaces and end). A null or empty text has its end only. Rows that repeat a
    key, or have none, are rows of their own. Without training texts every count is 0. A text beyond PIECE bytes is
    scored in pieces cut at white space, each from the starting weights on. Extra columns are not read. Starting weights
    and all counts come from all training texts. Words are told apart by 46 bits of hash and their last byte.
    """
    with shuffles_removed(docs.sparkSession):
        return _score(docs, train, key)


def _score(docs: DataFrame, train: Column, key: str) -> DataFrame:
    stats = statistics(docs, train)
    codes = codes_of(stats["pairs"])
    slices = sliced(docs, train, key)
    buckets = max(1, -(-stats["bytes"] // BUCKET))
    replies = written(answered(asked(slices, codes, buckets), codes), "replies")
    start = fitted(replies, codes) if stats["texts"] else plain_start()
    replies = replies.where("times IS NULL").drop("times")
    end_log = float(np.log10(stats["texts"] + 1))
    ends_known = int(stats["texts"] > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = rows_of(left)
        strings = texts_of(left)
        lookup = Lookup(gather(right, codes), codes)
        n = len(strings)
        logs, base, tokens, known, size = np.zeros(n), np.full(n, end_log), np.ones(n, np.int64), np.full(n, ends_known), np.zeros(n, np.int64)
        mixer = Mixer(lookup, start)
        for s, owner in parts(strings):
            found, counts = mixer(s)
            np.add.at(logs, owner, found / np.log(10))
            who = owner[np.repeat(np.arange(len(s.words)), s.words)]
            base += np.bincount(who, np.log10(counts + 1.0), n)
            known += np.bincount(who, counts > 0, n).astype(np.int64)
            tokens += np.bincount(owner, s.words, n).astype(np.int64)
            size += np.bincount(owner, np.diff(s.at), n).astype(np.int64)
        new = np.zeros(n, np.int64)
        if n:
            new[0] = sum(right.column("new").to_pylist())
        return pa.table({"key": left.column("key"), "n_tokens": tokens, "n_known": known, "logs": base, "score": logs, "size": size, "new": new})

    kind = docs.schema[key].dataType.simpleString()
    scored = slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(
        lambda left, right: giving_back(run, left, right), f"key {kind}, n_tokens long, n_known long, logs double, score double, size long, new long"
    )
    scored = written(scored, "scores")
    total = stats["words"] + stats["texts"]
    distinct = int(scored.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]) + ends_known
    return scored.select(
        F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("size")).alias("bits_per_byte"),
    )
