"""Language identification of whole, possibly mixed, texts.

The script of a word (from Unicode ranges) leaves only languages that use this script. Each word gets a score for every
candidate from counts of its character n-grams; Viterbi decoding over the words, with a penalty for switching, labels
spans of one language. A text's language is the one that most of its letters are labelled with.

Counts come from all labelled rows. N-grams are hashed into ``BUCKETS`` places, so the model has languages x BUCKETS
numbers whatever the corpus size, and can be sent to tasks.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawtext import mix, slices

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SWITCH = 6.0
UNKNOWN = "und"
MAX_LANGUAGES = 500  # labels are few and typed by people; more is taken for a wrong column

#: First code points of script ranges, from the Unicode block list (fixed values), and a number for each script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE20, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_RANGE_STARTS = np.array([a for a, _ in SCRIPTS])
_RANGE_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (any L category)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


class Words:
    """The words (runs of letters) of a batch of texts, with hashed n-grams."""

    def __init__(self, texts: list[str]) -> None:
        body = " ".join(t.lower() for t in texts) + " "
        code = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        is_letter = letters()[code]
        edge = np.diff(np.concatenate([[0], is_letter.astype(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, at)
        self.at, self.sizes = at, self.ends - self.starts
        n = len(self.starts)
        # each word as its letters between two marks; words stand one after another
        size = self.sizes + 2
        self.edges = np.concatenate([[0], np.cumsum(size)])
        chars = np.zeros(self.edges[-1], np.uint64)
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        inner = np.ones(len(chars), bool)
        inner[self.edges[:-1]] = inner[self.edges[1:] - 1] = False
        chars[inner] = code[is_letter]
        self.owner, self.chars = owner, chars
        scripts = _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, code[self.starts], side="right") - 1] if n else np.zeros(0, np.int64)
        self.scripts = scripts

    def grams(self):
        """For each order: the places where an n-gram starts, and its bucket."""
        with np.errstate(over="ignore"):
            h = self.chars + np.uint64(1)
            key = np.zeros(len(h), np.uint64)
            for order in range(1, max(ORDERS) + 1):
                m = len(h) - order + 1
                if m <= 0:
                    return
                key = key[:m] * np.uint64(0x100000001B3) + h[order - 1 :]
                if order not in ORDERS:
                    continue
                ok = self.owner[:m] == self.owner[order - 1 :]
                if order == 1:
                    ok = ok & (self.chars[:m] > 0)
                yield order, np.flatnonzero(ok), (mix(key[ok] + np.uint64(order)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages): log probability, less the mean over languages
    scripts: np.ndarray  # (scripts, languages): whether a language uses a script

    @property
    def known(self) -> bool:
        return len(self.languages) > 0


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams of all rows with text and lang. No row gives a model that knows no language.

    Each task adds up its own counts before anything is shuffled; a task's counts have at most BUCKETS places a language.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        used: dict[str, np.ndarray] = {}
        for part, strings in slices(batches, "text"):
            labels = np.array(part.column(1).to_pylist(), object)
            texts = strings.to_pylist()
            for name in set(labels):
                w = Words([t for t, l in zip(texts, labels, strict=True) if l == name])
                if name not in sums:
                    sums[name], used[name] = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
                for _, _, bucket in w.grams():
                    sums[name] += np.bincount(bucket, minlength=BUCKETS)
                used[name] += np.bincount(w.scripts, minlength=len(SCRIPT_NAMES))
        for name, total in sums.items():
            both = np.concatenate([total, used[name]])
            full = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(both[full])], names=["lang", "place", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    per = sums.groupBy("place").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # at most one entry a language
    languages: list[str] = []
    found = per.toArrow()
    place, by = found["place"].to_numpy(), found["by"].combine_chunks()
    counts = np.diff(by.offsets.to_numpy())
    names, n = by.values.field("lang").to_pylist(), by.values.field("n").to_numpy()
    languages = sorted(set(names))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} different labels; more than {MAX_LANGUAGES} languages are not supported")
    number = {x: k for k, x in enumerate(languages)}
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    table[np.repeat(place, counts), [number[x] for x in names]] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    weights = share - share.mean(axis=1, keepdims=True)
    uses = scripts >= np.maximum(1, 0.001 * scripts.sum(axis=0))
    return Model(languages, weights.astype(np.float32), uses)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words, languages): the mean of each order's scores, added up; -inf where the script rules a language out.

    A word whose script no learned language uses scores 0 for all.
    """
    n, m = len(words.starts), len(model.languages)
    out = np.zeros((n, m), np.float64)
    if not n:
        return out
    for _, place, bucket in words.grams():
        owner = words.owner[place]
        have = np.bincount(owner, minlength=n)
        values = model.weights[bucket]
        for k in range(m):
            out[:, k] += np.bincount(owner, values[:, k], minlength=n) / np.maximum(have, 1)
    allowed = model.scripts[words.scripts]
    none = ~allowed.any(axis=1)
    out[none] = 0
    out[~allowed & ~none[:, None]] = -1e3
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; text k has words first[k] to first[k + 1]. All texts step together, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], first[:-1][order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more words than this step
    m = scores.shape[1]
    back = np.zeros(scores.shape, np.int16)
    out = np.zeros(len(scores), np.int64)
    if not steps:
        return out
    same = np.arange(m, dtype=np.int16)
    best = scores[begin[: alive[0]]]
    for t in range(1, steps):
        b = best[: alive[t]]
        top = b.argmax(axis=1)
        jump = b.max(axis=1) - switch
        stay = b >= jump[:, None]
        here = begin[: alive[t]] + t
        back[here] = np.where(stay, same, top[:, None])
        best[: alive[t]] = np.where(stay, b, jump[:, None]) + scores[here]
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        here = begin[: alive[t]] + t
        out[here] = label[: alive[t]]
        label[: alive[t]] = back[here, label[: alive[t]]]
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans) of every row, from its whole text alone.

    spans: array of (start, end, lang) in characters of the lower-cased text, from the first letter of a span to its
    last. score is the share of the text's letters labelled with lang_pred. A text that is null, empty or without
    letters, and any text if the model knows no language, is ``und`` with score 0 and no spans. Ties go to the first
    language in sorted order. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        m = len(model.languages)
        for part, strings in slices(batches):
            words = Words(strings.to_pylist())
            n = part.num_rows
            names, share, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if m and len(words.starts):
                label = viterbi(word_scores(words, model), words.first, switch)
                doc = np.repeat(np.arange(n), np.diff(words.first))
                weight = np.bincount(doc * m + label, words.sizes, minlength=n * m).reshape(n, m)
                total, best = weight.sum(axis=1), weight.argmax(axis=1)
                share = weight[np.arange(n), best] / np.maximum(total, 1)
                names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(doc)) - 1
                for d, a, b, l in zip(
                    doc[heads].tolist(), (words.starts[heads] - words.at[doc[heads]]).tolist(), (words.ends[tails] - words.at[doc[heads]]).tolist(), label[heads].tolist(), strict=True
                ):
                    spans[d].append({"start": a, "end": b, "lang": model.languages[l]})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)], names=["id", "lang_pred", "score", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    ).withColumnRenamed("id", key)
