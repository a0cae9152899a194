"""Context mixing, whitening and the Merkle manifest against plain versions, on small and odd tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmetrica.llm import merkle, mixing, whitening

ODD = [None, "", "   ", "...", "one", "One two", "word " * 3_000, "\n\n", "é" * 500, "x" * 20_000, "Ab\x0bCd ef"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, slice long, key string, bucket int, score double, lo int"


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def some_texts(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(200)]
    return [" ".join(rng.choices(vocab, k=rng.randint(0, 120))) for _ in range(n)] + ODD


def docs(spark, texts, ids=None):
    rng = random.Random(3)
    rows = [(k if ids is None else ids[k], t, rng.choice(["en", "en", "en", "de", None, ""]), None if k % 5 == 0 else f"s{k}", None if t is None else len(t), 7, "x", 3, 0.5, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


# --- context mixing -----------------------------------------------------------------------

def symbols(text):
    return [c for w in words_of(text) for c in (*w, 32)] + [10]


def test_streams_and_contexts():
    texts = some_texts(30)
    for s, owner in mixing.parts(pa.array(texts)):
        for k, o in enumerate(owner):
            assert list(s.body[s.at[k] : s.at[k + 1]]) == symbols(texts[o])
            assert s.words[k] == len(words_of(texts[o]))
        for k in range(1, 5):
            back = mixing.before(s, k)
            for a, b in zip(s.at, s.at[1:]):
                assert list(back[a:b]) == [10] * min(k, b - a) + list(s.body[a : max(a, b - k)])


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 50)
    texts = ["ab cd ef " * 40, "y" * 400, "", None, "a b"]
    found = collections.defaultdict(list)
    for s, owner in mixing.parts(pa.array(texts)):
        for k, o in enumerate(owner):
            found[o] += list(s.body[s.at[k] : s.at[k + 1]])
    assert [found[k] for k in range(5)] == [symbols(t) for t in texts]


def test_codes_are_prefix_codes():
    rng = np.random.default_rng(2)
    pairs = np.zeros((256, 256), np.int64)
    pairs[:100] = rng.integers(0, 1000, (100, 256)) ** 3
    codes = mixing.codes_of(pairs)
    for b in (0, 50, 200):
        size, bits = codes.length[b].astype(int), codes.bits[b].astype(int)
        assert sum(2.0**-n for n in size) == 1.0
        left = [c / 2**n for c, n in zip(bits, size)]
        assert left == sorted(left) and len(set(left)) == 256 and sorted(codes.place[b]) == list(range(256))


def corpus(texts, train):
    """Plain counts of (context name, context, byte) over training texts."""
    counts = collections.defaultdict(collections.Counter)
    for t, f in zip(texts, train):
        if f:
            for name, context, sym in steps(t):
                counts[name, context][sym] += 1
    return counts


def steps(text):
    body = symbols(text)
    word = ()
    for k, sym in enumerate(body):
        past = ([10] * 4 + body[:k])[-4:]
        for order in mixing.ORDERS:
            yield order, tuple(past[-order:]), sym
        yield "word", (word, past[-1]), sym  # the empty word at a text's start is a context of its own
        word = () if sym in (32, 10) else (*word, sym)


def stage(texts, train):
    strings = pa.array(texts).fill_null("")
    pairs = np.zeros((256, 256), np.int64)
    for s, owner in mixing.parts(strings):
        np.add.at(pairs, (mixing.before(s, 1), s.body), 1)
    codes = mixing.codes_of(pairs)
    keys, counts = mixing.requests(strings, np.array(train), codes)
    assert np.all(keys[1:] > keys[:-1])
    return strings, codes, mixing.Lookup(mixing.answer(keys, counts, codes), codes)


def bits_of(codes, prev, sym):
    p = codes.place[prev, sym]
    n = int(codes.length[prev, p])
    return [int(codes.bits[prev, p]) >> (n - 1 - j) & 1 for j in range(n)]


def test_mixing_is_the_plain_model():
    texts = some_texts(40, seed=5)
    train = [k % 4 != 1 for k in range(len(texts))]
    strings, codes, lookup = stage(texts, train)
    counts = corpus(texts, train)
    rng = np.random.default_rng(1)
    start = mixing.plain_start()
    start.weights[:] = rng.random(start.weights.shape) * 0.6
    mixer = mixing.Mixer(lookup, start)
    got = np.zeros(len(texts))
    for s, owner in mixing.parts(strings):
        np.add.at(got, owner, mixer(s)[0])

    def kind(c):
        n = sum(c.values())
        return 0 if n == 0 else 1 if n == 1 else 2 if n <= 8 else 3

    def plain(text):
        scale, right, logs = np.ones(mixing.GATES), start.right.astype(float).copy(), 0.0
        body, moves = symbols(text), []
        found = list(steps(text))
        per = len(mixing.ORDERS) + 1
        for k, sym in enumerate(body):
            if k % mixing.BLOCK == 0 and k:
                move(scale, right, moves)
                moves = []
            prev = body[k - 1] if k else 10
            contexts = [counts[name, context] for name, context, _ in found[k * per : (k + 1) * per]]
            below = {c: bits_of(codes, prev, c) for ctx in contexts for c in ctx}
            gate, cls = kind(contexts[-2]) * mixing.CLASSES + kind(contexts[-1]), kind(contexts[-1])
            mine = bits_of(codes, prev, sym)
            for j, bit in enumerate(mine):
                x = []
                for ctx in contexts:
                    n = [sum(v for c, v in ctx.items() if below[c][:j] == mine[:j] and len(below[c]) > j and below[c][j] == b) for b in (0, 1)]
                    x.append(np.clip(round(16 * math.log((n[1] + mixing.DOUBT) / (n[0] + mixing.DOUBT))), -127, 127) / 16 if ctx else 0.0)
                z = np.clip(np.dot([*x, 0.3], start.weights[gate]), -8, 8) * (2 * bit - 1)
                if j >= mixing.REFINED:
                    logs -= math.log1p(math.exp(-z))
                    continue
                w = z * scale[gate]
                p = 1 / (1 + math.exp(-w))
                cell = min(int(abs(w) * 2), mixing.STEPS - 1)
                hit = w > 0 or (w == 0 and bit == 1)
                share = right[cls, cell]
                logs += math.log((p + (share if hit else 1 - share)) / 2)
                moves.append((gate, z * (1 - p), cls, cell, hit))
        return logs

    def move(scale, right, moves):
        for g, slope, *_ in moves:
            scale[g] += mixing.RATE * slope
        np.clip(scale, 0.2, 3, out=scale)
        seen = collections.Counter(m[2:4] for m in moves)
        hits = collections.Counter(m[2:4] for m in moves if m[4])
        for at, n in seen.items():
            right[at] += (hits[at] - n * right[at]) * mixing.MAP_RATE / (1 + mixing.MAP_RATE * n)

    for k in [*range(12), 44, 45, 48]:
        assert got[k] == pytest.approx(plain(texts[k]), rel=2e-4), k


def test_every_decision_of_a_byte_is_refined():
    """With shares of one half every decision counts as the mean of its probability and a half, however long the code."""
    texts = [t for t in some_texts(40, seed=6) if t and len(t) < 100]
    strings, codes, lookup = stage(texts, [k % 3 != 1 for k in range(len(texts))])
    start = mixing.plain_start()
    start.right[:] = 0.5
    s, owner = next(mixing.parts(strings))
    got = mixing.Mixer(lookup, start)(s)[0]
    assert np.diff(s.at).max() < mixing.BLOCK  # nothing has moved yet
    gram, word, _ = mixing.keys_of(s, codes)
    x, gate, _ = lookup.inputs(gram, word)
    at = lookup.places(word)
    size = lookup.size[at]
    assert size.max() > 4
    z = np.clip(np.einsum("ij,ij->i", x, np.repeat(start.weights[gate], size, axis=0)), -8, 8) * lookup.value_of(at)
    logs = np.log((1 / (1 + np.exp(-z.astype(float))) + 0.5) / 2)
    ends = np.concatenate([[0], np.cumsum(size)])[s.at]
    assert got == pytest.approx(np.add.reduceat(logs, ends[:-1]), rel=1e-4)


def test_a_texts_score_does_not_depend_on_others():
    texts = some_texts(30, seed=8)
    train = [True] * len(texts)
    strings, _, lookup = stage(texts, train)
    start = mixing.plain_start()
    whole = np.zeros(len(texts))
    mixer = mixing.Mixer(lookup, start)
    for s, owner in mixing.parts(strings):
        np.add.at(whole, owner, mixer(s)[0])
    for k in (0, 7, 20, 36):
        alone = sum(mixing.Mixer(lookup, start)(s)[0].sum() for s, _ in mixing.parts(strings.slice(k, 1)))
        assert alone == pytest.approx(whole[k], rel=1e-6)


def test_the_bits_of_a_byte_make_a_distribution():
    """Every possible next byte has a probability, and they add up to one."""
    texts = ["ab ac ab ad", "abc"]
    strings, codes, lookup = stage(texts + ["ab a" + chr(c) for c in range(33, 127)], [True, True] + [False] * 94)
    inputs = []
    for c in [*range(33, 65), *range(91, 127)]:  # capital letters would count twice
        s = next(mixing.parts(pa.array(["ab a" + chr(c)])))[0]
        gram, word, age = mixing.keys_of(s, codes)
        mixer = mixing.Mixer(lookup, mixing.plain_start())
        entry = lookup.places(np.where(age < 4, gram, word))
        mixer.first_layer(gram, word, entry)
        e = entry[4]
        inputs.append(np.prod(1 / (1 + np.exp(-np.array([float(z[e]) for z in mixer.z])))) * math.exp(mixer.rest[e]))
    assert 0.5 < sum(inputs) < 1.0


@pytest.fixture(scope="module")
def scored(spark):
    texts = some_texts(150, seed=11)
    ids = [None if k in (3, 4) else 7 if k in (8, 9) else k for k in range(len(texts))]
    df = docs(spark, texts, ids)
    seventh = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = mixing.score(df, ~seventh).toPandas()
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k in ids]
    return texts, ids, held, out


def test_base_scores_and_counts(scored):
    texts, ids, held, out = scored
    assert len(out) == len(texts)
    count = collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            count.update(words_of(t))
    ends = held.count(False)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    want = collections.Counter()
    for k, t in zip(ids, texts):
        w = words_of(t)
        base = math.fsum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(count[x] for x in w), ends])
        want[None if k is None else k, len(w) + 1, 1 + sum(count[x] > 0 for x in w), round(base, 6)] += 1
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out.itertuples())
    assert got == want and set(out.train_tokens) == {total}
    assert (out.score < 0).all() and np.isfinite(out.score).all()


def test_slices_and_buckets_change_nothing(spark, scored, monkeypatch):
    texts, ids, _, out = scored
    monkeypatch.setattr(mixing, "SLICE", 3_000)
    monkeypatch.setattr(mixing, "BUCKET", 20_000)
    monkeypatch.setattr(mixing, "PART", 1_000)
    seventh = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    again = mixing.score(docs(spark, texts, ids), ~seventh).toPandas()
    a, b = (d.sort_values(["n_tokens", "base_score", "score"]) for d in (out, again))
    assert np.allclose(a.base_score, b.base_score) and np.allclose(a.score, b.score, rtol=1e-3)


def test_held_out_texts_score_better_than_without_training(spark):
    texts = [t for t in some_texts(120, seed=21)[:120] if t]
    df = docs(spark, texts)
    held = F.col("doc_id") % 4 == 0
    learned = mixing.score(df, ~held).where("doc_id % 4 = 0").agg(F.sum("score")).first()[0]
    blank = mixing.score(df, F.lit(False)).where("doc_id % 4 = 0").agg(F.sum("score"), F.max("n_known"), F.max("train_tokens")).first()
    assert learned > blank[0] * 0.8 and blank[1:] == (0, 0)


def test_a_byte_left_out_is_not_counted():
    texts = some_texts(12, seed=31)
    strings, codes, lookup = stage(texts, [True] * len(texts))
    keys, counts = mixing.requests(strings, np.ones(len(texts), bool), codes)
    bits, kind = lookup.left_out()
    for k in range(0, len(keys), 7):
        less = counts.copy()
        less[k] -= 1
        want = mixing.predictions(keys, less, codes)
        assert kind[k] == mixing.class_of(want.seen[k])
        if kind[k]:
            got, right = (b.astype(int) for b in (bits[lookup.at[k] : lookup.at[k + 1]], want.bits[want.at[k] : want.at[k + 1]]))
            # larger counts are read back from predictions in steps of 1/16, so they may be off by a little
            assert np.abs(got - right).max(initial=0) <= (0 if want.seen[k] < 16 else 4), k


def test_starting_weights_come_from_every_training_text(spark, monkeypatch):
    """Texts longer than 16,384 bytes, and those behind the first 1,024, have a part in the weights."""
    def starts(texts, train):
        df = docs(spark, texts)
        stats = mixing.statistics(df, train)
        codes = mixing.codes_of(stats["pairs"])
        return mixing.fitted(mixing.answered(mixing.asked(mixing.sliced(df, train, "doc_id"), codes, 3), codes), codes).weights

    long = [" ".join(t for t in some_texts(40, seed=k) if t) + " x" * 9_000 for k in range(4)]
    assert min(len(t) for t in long) > 16_384
    plain = mixing.plain_start().weights
    assert np.abs(starts(long, F.lit(True)) - plain).max() > 0.05
    short = [f"item {k % 50} of list {k % 7}" for k in range(1_200)]
    one = starts(short, F.lit(True))
    assert not np.array_equal(one, starts([*short[:-1], "a wholly different ending " * 20], F.lit(True)))
    monkeypatch.setattr(mixing, "SLICE", 2_000)
    assert np.allclose(starts(short, F.lit(True)), one, atol=1e-3)


def test_distinct_bytes_are_merged_as_parts_come(monkeypatch):
    """Memory follows the distinct contexts, not the number of parts that hold them again, and nothing is lost."""
    monkeypatch.setattr(mixing, "PART", 1 << 14)
    codes = mixing.codes_of(np.ones((256, 256), np.int64))
    text = " ".join(f"w{k * k % 3001}" for k in range(2_000))
    flags = np.arange(240) % 3 > 0

    def peak(copies, merged):
        monkeypatch.setattr(mixing, "MERGED", merged, raising=False)
        strings = pa.array([text] * copies)
        tracemalloc.start()
        found = mixing.distinct(strings, flags[:copies], codes)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, found

    peak(2, 1 << 14)
    (few, _), (many, found), (_, want) = peak(24, 1 << 14), peak(240, 1 << 14), peak(240, 1 << 30)
    assert many < 1.5 * few, (few, many)
    for a, b in zip(mixing.contexts_of(*found)[:2], mixing.contexts_of(*want)[:2]):
        assert np.array_equal(a, b)
    assert found[2].sum() == flags.sum() * (len(text) + 2)


def test_a_context_has_one_bucket_and_words_lie_in_ranges():
    texts = some_texts(40, seed=5)
    _, _, lookup = stage(texts, [True] * len(texts))
    keys = lookup.found.keys
    bucket = mixing.bucket_of(keys, 7)
    assert set(bucket.tolist()) == set(range(7))
    same = keys[1:] >> np.uint64(8) == keys[:-1] >> np.uint64(8)
    assert np.all(bucket[1:][same] == bucket[:-1][same])
    assert np.all(np.diff(bucket[keys >= 1 << 62]) >= 0)


def test_no_texts(spark):
    assert mixing.score(docs(spark, ["a"]).limit(0), F.lit(True)).count() == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert np.array_equal(mixing.unpacked_keys(mixing.packed_keys(keys)), keys)
    assert len(mixing.unpacked(mixing.packed(np.zeros(0, np.int8)), np.int8)) == 0
    n = rng.integers(-100, 100, 77)
    assert np.array_equal(mixing.unpacked(mixing.packed(n), np.int64), n)


# --- whitening ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, n long, whitened double"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 0.5) for k, v in rows], VECTORS).repartition(3)


def plain_whitening(x, k):
    n, total = len(x), [sum(c) for c in zip(*x)]
    d = len(total)
    cov = np.array([[sum((n * r[i] - total[i]) * (n * r[j] - total[j]) for r in x) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    w = (np.array(x, float) - np.array(total) / n) @ u[:, :k] / np.sqrt(e[:k])
    return w, e / e.sum(), [sum((n * a - t) ** 2 for a, t in zip(r, total)) for r in x]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = [(k, np.float32(rng.standard_normal(12) * np.arange(1, 13) / 5)) for k in range(300)]
    good += [(5, good[5][1]), (None, good[6][1]), (900, np.float32([0] * 12))]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 11 + [float("inf")]), (1004, []), (1005, [1.0] * 5)]
    out = whitening.whiten(vectors(spark, good + bad), 8).toPandas()
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in good]
    w, share, dev = plain_whitening(x, 8)
    assert len(out) == 8 * len(good) and set(out.n) == {len(good)} and not set(out.vec_id) & {1000, 1001, 1002, 1003, 1004, 1005}
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    for k in (0, 7, 299, 900):
        mine = out[out.vec_id == k].sort_values("component")
        at = [i for i, _ in good].index(k)
        assert np.allclose(np.abs(mine.whitened), np.abs(w[at]), atol=1e-9) and np.allclose(mine.explained, share[:8], rtol=1e-9)
        assert [int(v) for v in mine.deviation] == [dev[at]] * 8
    twice = out[out.vec_id == 5].sort_values(["component", "whitened"])
    assert len(twice) == 16 and twice.whitened.iloc[0] == twice.whitened.iloc[1]


def test_cross_products_are_exact_for_wide_ranges():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 1 << 62, (70, 3), dtype=np.uint64)
    y[:, 1] >>= np.uint64(50)
    y[:, 2] = 0
    bits = np.array([int(c).bit_length() for c in y.max(axis=0)])
    p = whitening.Products(bits)
    p.add(whitening.planes(y[:33], bits))
    p.add(whitening.planes(y[33:], bits))
    exact = [[int(v) for v in c] for c in y.T]
    for i in range(3):
        assert p.total(i) == sum(exact[i])
        for j in range(i, 3):
            assert p.pair(i, j) == sum(a * b for a, b in zip(exact[i], exact[j]))


def test_flat_and_huge_vectors(spark):
    out = whitening.whiten(vectors(spark, [(1, [3, 5]), (2, [3, 5])]), 8).toPandas()
    assert len(out) == 4 and out.whitened.isna().all() and out.explained.isna().all() and set(out.deviation) == {0}
    out = whitening.whiten(vectors(spark, [(1, [1e30, 0]), (2, [-1e30, 1]), (3, [0, 2])]), 8).toPandas()
    assert len(out) == 6 and out[out.component == 1].whitened.notna().all()
    assert whitening.whiten(vectors(spark, [(1, None)]), 8).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [2])]), 8).toPandas().whitened.isna().all()


# --- manifest -----------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def put(v):
        s = None if v is None else str(v)
        return "-" if s is None else f"{len(s.encode())}:{s}"

    def leaf(r, text):
        return sha(*[put(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])

    def prove(digests):
        """Root, and for each leaf the siblings of every level with the place of its own."""
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for k, p in enumerate(paths):
                run = at[k] // 8 * 8
                group = digests[run : run + 8]
                p.append((group[: at[k] - run], group[at[k] - run + 1 :]))
                at[k] //= 8
            digests = [sha(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
        return digests[0], paths

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.lang].append((r.doc_id is not None, r.doc_id, leaf(r, r.text), r))
    if not trees:
        return []
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    proofs = {t: prove([x[2] for x in trees[t]]) for t in order}
    root, tops = prove([proofs[t][0] for t in order])
    out = []
    for t, top in zip(order, tops):
        for (_, _, h, r), path in zip(trees[t], proofs[t][1]):
            third = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            text = r.text.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if third and r.text is not None else r.text
            f = leaf(r, text)
            for a, b in path + top:
                f = sha(*a, f, *b)
            out.append((r.doc_id, h, proofs[t][0], root, sha(*[x for a, b in path + top for x in a + b]), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 300])
def test_manifest(spark, n):
    texts = (some_texts(n, seed=n) if n > 20 else ["Aa", "bb", None, "", "x Y", "e", "f", "G", "h"][:n])
    ids = [None if k == 3 else 5 if k in (6, 7) else k * 7 for k in range(len(texts))]
    df = docs(spark, texts, ids)
    if n > 20:
        df = df.unionByName(df.where("doc_id = 70")).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("l"), F.col("doc_id") % 23)).otherwise(F.col("lang")))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(df, tampered=third)
    cols = ["doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof"), "folded_root", "verified"]
    got = sorted([tuple(r) for r in found.select(*cols).collect()], key=str)
    assert got == plain_manifest(df.collect()) and len(got) == df.count()
    assert sum(not r[-1] for r in got) == sum(
        r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and bool(re.search("[A-Z]", r.text or "")) for r in df.collect())
