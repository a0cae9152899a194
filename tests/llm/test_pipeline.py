"""The pipeline stage by stage against brute force over a small table."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F
from test_text_operators import ODD, brute_components, brute_passages, brute_repeats, made, phrases
from tokenizers import Tokenizer

import corpus_pipeline
from segmetrica.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark, folder, labels=True):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("stuvwxyz", k=5)) for _ in range(80)]
    items = [(k, " ".join(rng.choices(vocab, k=14))) for k in range(6)]
    texts = made(11, 72, words=110)[0]
    texts += [f"{texts[k]} and {items[k % 6][1].upper()} then" for k in (4, 10, 16)] + ODD + [None, texts[0]]
    rows = [(k, t, "en" if labels else None, f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows.append((None, "a row without id", "en", None, 3))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(enumerate(texts)), items


def test_stages(spark, tmp_path):
    texts, items = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, ids = dict(texts), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        got = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "language":
            kept = {d: t for d, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            order = sorted(kept)
            found = brute_components([kept[d] for d in order])
            kept = {d: kept[d] for i, d in enumerate(order) if found[i][1] == i}
        elif name == "repeats":
            assert set(got) == set(kept)
            assert all(len(got[d]) <= len(kept[d]) and set(got[d].split()) <= set(kept[d].split()) for d in kept)
            assert sum(len(t) for t in got.values()) < sum(len(t) for t in kept.values())
            seen = set()
            for d in sorted(got):
                w = got[d].split()
                runs = {tuple(w[i : i + 70]) for i in range(len(w) - 69)} if len(set(w)) > 1 else set()
                assert not runs & seen
                seen |= runs
            assert {r.doc_id: r.n_chars for r in docs.collect()} == {d: len(t) for d, t in got.items()}
            kept = got
        else:
            order = sorted(kept)
            found = brute_passages([kept[d] for d in order], items)
            kept = {d: kept[d] for i, d in enumerate(order) if found[i][1] == 0}
            assert len(kept) < len(order)
        assert got == kept, name
    tok, parts = Tokenizer.from_file(WORD_BPE), collections.defaultdict(list)
    for r in docs.collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in parts.items()} == {
        d: tok.encode(t, add_special_tokens=False).ids + [1] for d, t in kept.items()
    }
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = F.xxhash64(*whole.columns)
    assert sorted(r[0] for r in whole.select(key).collect()) == sorted(r[0] for r in docs.select(key).collect())


def test_repeats_against_brute_force(spark, tmp_path):
    texts = phrases(12, 60) + made(13, 40, words=110)[0] + ODD
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    seen, want = set(), brute_repeats(texts)
    assert {k: (r.text or "").encode().split() for k, r in got.items()} == {k: [x.encode() for x in w] for k, w in want.items()}
    for k, t in enumerate(texts):
        old = (t or "").encode().split()
        runs = {tuple(old[i : i + 51]) for i in range(len(old) - 50)}
        left = (got[k].text or "").encode().split()
        if runs & seen:
            assert len(left) < len(old)
        else:
            assert (got[k].text, got[k].n_chars) == (t, rows[k][4])
        seen |= runs


def test_no_labels_and_no_rows(spark, tmp_path):
    texts, _ = fixture(spark, str(tmp_path), labels=False)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
    assert sorted(r.doc_id for r in first.collect()) == [d for d, t in texts.items() if t and any(c.isalpha() for c in t)]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
