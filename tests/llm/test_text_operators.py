"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segmetrica.llm import chunks, curve_packing, fm_index, language, licences, minhash, neighbours, pages, rawtext, records, token_counts, units
from segmetrica.llm.queries import BYTE_BPE, WORD_BPE
from segmetrica.llm.shared import components

PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "ß", "'s", "'re", "1", "²", "!", "<|endoftext|>", "　", "\x1c", "中", "\r\n", "Σ", "ﬁ", " the", "_"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, spans string, part string, bucket string, key string"


def made(seed, n=60, words=80):
    """Documents with copies, near copies and a passage that many share."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocab, k=70))
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and texts:
            t = rng.choice(texts)
        elif kind == 2 and texts:
            w = rng.choice(texts).split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(rng.choices(vocab, k=rng.randint(20, words)))
        if kind == 3:
            w = t.split()
            at = rng.randrange(len(w))
            t = " ".join([*w[:at], passage, *w[at:]])
        texts.append(t)
    return texts, passage


def table(spark, texts, lang="en"):
    rows = [(k, t, lang, None if t is None else len(t), "x", "x", "x", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   ", "...", "one", "One two", "word " * 30_000, "\n\n", "é" * 500, "x" * 100_000]


# --- shared helpers -----------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in up if find(k) != k}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_hashes():
    texts = ["Hello WORLD  a\nb", "", "  ", "x", "é ü\t\nQ", "ends here", "starts"]
    data, at = rawtext.raw(pa.array(texts))
    low, starts, ends, first = rawtext.words_of(data, at)
    for k, t in enumerate(texts):
        assert [bytes(low[a:b]) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])] == t.encode().lower().split()
    words = [bytes(low[a:b]) for a, b in zip(starts, ends)]
    hashes = rawtext.SpanHasher()(low, starts, ends)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_slices_are_bounded():
    batch = pa.record_batch({"text": pa.array(["ab" * 10, None, "x" * 90, "", "y"] * 20)})
    parts = list(rawtext.slices([batch], limit=50))
    assert sum(p.num_rows for p, _ in parts) == 100
    assert all(p.num_rows == 1 or sum(len(t) for t in s.to_pylist()) <= 50 for p, s in parts)


@pytest.mark.parametrize("path, spaces", [(BYTE_BPE, True), (WORD_BPE, False)])
def test_units_give_the_library_ids(path, spaces):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(4000)]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    enc = units.Encoder(path, spaces, "<u4")
    for k in range(0, 4000, 500):
        ids, at = enc(pa.array(texts[k : k + 500]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in want[k : k + 500]]


def test_units_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(units.Cutter, "number", staticmethod(lambda eight, starts, ends: np.zeros(len(starts), np.int64)))
    found, which, owner = units.Cutter(True, [])(pa.array(["a b a", "", "b c"]))
    assert [[found[k] for k in which[a:b]] for a, b in zip(owner, owner[1:])] == [[b"a", b" b", b" a"], [], [b"b", b" c"]]


def test_a_full_unit_cache_only_costs_time():
    calls = []
    cache = units.UnitCache(lambda new: calls.extend(new) or [u.upper() for u in new], limit=3)
    for k in range(50):
        held = cache.need([[f"u{k % 7}", f"u{k % 3}"]])
        assert held[f"u{k % 7}"] == f"U{k % 7}"
    assert len(cache.now) + len(cache.old) < 12


# --- 1 ------------------------------------------------------------------------------------

def test_language_spans(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "fr": ["eau", "oi", "ment", "que", "é"], "ru": ["пре", "ост", "ени", "ка"]}
    text = lambda l, n: " ".join("".join(rng.choices(parts[l], k=rng.randint(1, 3))) for _ in range(n))
    train = [(k, text(l, 40), l) for k, l in enumerate(["en", "fr", "ru"] * 30)] + [(900, None, "en"), (901, "x", None)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    tests = [(k, text(l, 12), l) for k, l in enumerate(["en", "fr", "ru"] * 20)]
    mixed = text("en", 60) + " " + text("fr", 40) + " " + text("ru", 20)
    rows = tests + [(100, mixed, "en"), (101, None, None), (102, "123 !?", None), (103, "", None), (104, "中文", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(got[k].lang_pred == l and 0 < got[k].score <= 1 for k, _, l in tests)
    assert [s.lang for s in got[100].spans] == ["en", "fr", "ru"] and got[100].lang_pred == "en" and got[100].score < 1
    assert mixed[got[100].spans[2].start : got[100].spans[2].end] in mixed and got[100].spans[2].end == len(mixed)
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (101, 102, 103))
    assert got[104].lang_pred in model.languages


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(40):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 6, 4))])
        scores = rng.integers(-4, 5, (first[-1], 3)).astype(float)
        got = language.viterbi(scores, first, 2.0)
        cost = lambda path, s: sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                best = max(cost(p, scores[a:b]) for p in np.ndindex(*[3] * (b - a)))
                assert cost(tuple(got[a:b]), scores[a:b]) == best


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(empty)
    assert not model.known and language.identify(empty, model).count() == 0
    assert language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


# --- 2 ------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, as you know. Accept, please.</p></div>
<div id=content><h2>Title &amp; more</h2><p>First para, with <b>some</b>
 words. Good &lt;x&gt;.<p>Second,<br>after a break. Yes.</p><ul><li>one<li>two</ul><!-- no --><script>var a = "<p>";</script>
<div class=comments><p>Reader: nice, very nice. Yes, yes.</p></div></div><aside><p>Other, long, text. Here, too.</p></aside>
<form><p>Sign up, now.</p></form><footer>c, 2020.</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p>", "x"), (5, "u", "a < b", "x"), (6, "u", "<nav>x</nav>", "x"), (None, "u", PAGE, "x"), (1, "u", PAGE, "x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "Title & more\n\nFirst para, with some words. Good <x>.\n\nSecond, after a break. Yes.\n\none\n\ntwo"
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert by[1] == [want, want] and by[None] == [want] and by[2] == by[3] == by[4] == by[6] == [""] and by[5] == ["a < b"]
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    deep = "<div>" * 3000 + "text, here. " * 100
    assert pages.main_text(deep).startswith("text, here.")


LONG = "This is a long sentence of the article, with commas, and it goes on; so it counts. " * 3


def test_pages_with_tags_left_open():
    body = f"<p>{LONG}</p><p>{LONG}second</p>"
    want = f"{LONG.strip()}\n\n{LONG}second"
    for head in ("<head><title>t</title>", "<head><meta charset=utf-8><style>p {}</style><title>t</title>\n", "<head><title>t</title><noscript>x</noscript></head>"):
        assert pages.main_text(f"<html>{head}<body>{body}</body></html>") == want
        assert pages.main_text(f"<html>{head}{body}") == want
    for tag in ("select", "object", "iframe", "video", "audio", "canvas", "svg", "template", "noscript"):
        for inside in ("<option>one<option>two", "text", ""):
            assert pages.main_text(f"<body><p>{LONG}</p><{tag}>{inside}<p>{LONG}second</p>") == want, tag
            assert pages.main_text(f"<body><p>{LONG}</p><{tag}>{inside}<p>no</p></div></{tag}><p>{LONG}second</p>") == want, tag
    assert pages.main_text(f"<body><p>{LONG}</p><select><option>a<p>{LONG}second</p><select><option>b</select>") == want


def test_names_are_only_hints():
    body = f"<h2 id='related-work'>Related work</h2><p>{LONG}</p><h3 id='search-algorithms' class='share'>Search</h3><p>{LONG}second</p>"
    want = f"Related work\n\n{LONG.strip()}\n\nSearch\n\n{LONG}second"
    side = "<div class='sidebar'><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div><div id='comments'><p>Nice, thanks.</p></div>"
    for name in ("site has-sidebar", "no-sidebar", "content ad-free", "x"):
        for tag in ("div", "section"):
            assert pages.main_text(f"<body><{tag} class='{name}'>{body}{side}</{tag}></body>") == want, name
            assert pages.main_text(f"<body>{side}<div id='page-search'><{tag} class='{name}'><div>{body}</div>{side}</{tag}></div></body>") == want, name
    part = f"<section id='related-work'><h2>Related</h2><p>{LONG}third</p><p>{LONG}fourth</p></section>"
    assert pages.main_text(f"<article>{body}{part}<div id='related-posts'><a href=x>Other</a><a href=y>More</a></div></article>") == f"{want}\n\nRelated\n\n{LONG}third\n\n{LONG}fourth"
    assert pages.main_text(f"<article>{body}<div class='comments'><p>{LONG}</p></div></article>") == want


# --- 3 ------------------------------------------------------------------------------------

def test_records_round_trip(spark, tmp_path):
    texts = made(1, 40)[0] + ODD
    docs = table(spark, texts)
    files, folder = records.export(docs, BYTE_BPE, end_id=2, folder=str(tmp_path / "r"))
    tok, at = Tokenizer.from_file(BYTE_BPE), 0
    got = {r.doc_id: r for r in records.token_layout(files, folder).collect()}
    ids = {}
    for k, t in enumerate(texts):
        ids[k] = tok.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes()))
        at += len(ids[k])
    shuffled = records.read_records(files, folder, shuffle_seed=4).collect()
    assert {r.doc_id: np.frombuffer(r.ids, f"<u{r.width}").tolist() for r in shuffled} == ids
    assert [r.position for r in shuffled] != sorted(r.position for r in shuffled)
    empty, there = records.export(docs.limit(0), BYTE_BPE, end_id=2, folder=str(tmp_path / "e"))
    assert records.token_layout(empty, there).count() == 0


def test_damage_is_found():
    body = records.frame(b"abc") + records.frame(b"")
    payload, at = records.unframe(body)
    assert bytes(payload) == b"abc" and records.unframe(body, at)[1] == len(body)
    for k in range(at):
        bad = bytearray(body)
        bad[k] ^= 1
        with pytest.raises(records.DamagedRecord):
            records.unframe(bytes(bad[:at]))
    with pytest.raises(records.DamagedRecord):
        records.unframe(body[: at - 1])
    assert records.masked(b"") == 0xA282EAD8 and struct.calcsize("<QI") == 12


# --- 4 ------------------------------------------------------------------------------------

def test_hilbert_neighbours_differ_by_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(np.ndindex(*[1 << bits] * dims)))
        order = np.argsort(curve_packing.hilbert(points, bits))
        assert sorted(curve_packing.hilbert(points, bits)) == list(range(len(points)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    texts = made(2, 60)[0] + ODD + ["same text here"] * 40
    pieces = curve_packing.pack(table(spark, texts), WORD_BPE, end_id=1, size=64)
    tok = Tokenizer.from_file(WORD_BPE)
    parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces.collect():
        parts[r.doc_id].append((r.start, r.length, np.frombuffer(r.ids, "<u2").tolist(), r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for p in sorted(parts[k]) for x in p[2]] == ids and {p[3] for p in parts[k]} == {len(ids)}
    full = []
    for _, ps in sorted(seqs.items()):
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        full.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and set(full[:-1]) == {64} and full[-1] <= 64
    whole = curve_packing.sequences(pieces).collect()
    assert sum(r.length for r in whole) == sum(full) and all(len(r.ids) == 2 * r.length for r in whole)
    assert curve_packing.pack(table(spark, texts).limit(0), WORD_BPE, end_id=1).count() == 0


# --- 5 ------------------------------------------------------------------------------------

def brute_neighbours(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q in queries:
            s = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, -c) for c, i in s]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 8))
    rows = [(k, (centres[k % 30] + 0.3 * rng.standard_normal(8)).tolist()) for k in range(3000)]
    rows += [(3000 + k, [1.0] * 8) for k in range(900)]
    rows += [(4000, None), (4050, [0.0] * 8), (4100, [float("nan")] * 8), (4150, [None] * 8), (4200, [1.0] * 3), (4250, []), (4300, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x"))
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows, set(range(0, 5000, 50)), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[3000]] == [3001, 3002, 3003, 3004, 3005]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in neighbours.search(few, few.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert neighbours.search(few.limit(0), few.limit(0)).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    x = neighbours.unit(np.repeat(rng.standard_normal((8, 6)), 40, axis=0) + 0.05 * rng.standard_normal((320, 6)))
    a, b = neighbours.neighbour_graph(x, 10)
    part = neighbours.balanced_parts(a, b, 320, 4, rng)
    assert np.bincount(part).tolist() == [80] * 4 and (part[a] != part[b]).mean() < 0.1


# --- 6 ------------------------------------------------------------------------------------

def test_licences(spark):
    mit = (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.\n"
    )
    texts = [
        "Some text. Released under the MIT License. More text.", mit, None, "", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n",
        "this is not released under the mit license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", *ODD,
    ]
    got = {r.doc_id: (list(r.identifiers), list(r.licences)) for r in licences.scan(table(spark, texts)).collect()}
    assert got[0] == (["mit-notice"], ["MIT"])
    assert got[1] == (["mit-title", "mit-grant", "mit-condition"], ["MIT"])
    assert got[4] == (["cc-by-nc-4-notice", "reserved"], ["CC-BY-NC-4.0", "all-rights-reserved"])
    assert got[5] == (["apache2-header", "apache2-use", "apache2-copy"], ["Apache-2.0"])
    assert got[7] == (["bsd-grant"], [])
    assert all(got[k] == ([], []) for k in (2, 3, 6, *range(8, len(texts))))
    plan = licences.scan(table(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL3_TEXT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
GPL2_TEXT = GPL3_TEXT.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


def test_wrapped_licences(spark):
    cases = [
        (MIT_TEXT, "mit-title mit-grant mit-condition mit-warranty", "MIT"), (ISC_TEXT, "isc-grant", "ISC"),
        *[(BSD_TEXT.format(*marks), "bsd-grant bsd-source bsd-binary bsd-names", "BSD-3-Clause") for marks in (("1.", "2.", "3."), "***", ("(1)", "(2)", "(3)"), ("a)", "b)", "c)"))],
        (GPL3_TEXT, "gpl3-plus-header gpl-warranty", "GPL-3.0-or-later"), (GPL2_TEXT, "gpl2-plus-header gpl-warranty", "GPL-2.0-or-later"),
        ("| a | table\nLicensed under CC BY-NC 4.0.", "cc-by-nc-4-notice", "CC-BY-NC-4.0"), ("This project is licensed\nunder the MIT License\nand more", "mit-notice", "MIT"),
        ("Released under the\n\nMIT license", "mit-title", None), ("Released. Under the MIT license", "", None),
    ]
    texts, want = [], []
    for text, ids, name in cases:
        for width in (10_000, 80, 72, 40):
            for mark in ("", "# ", " * ", "// ", "dnl "):
                lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width, break_on_hyphens=False) or [""]]
                texts.append("\n".join(mark + line for line in lines))
                want.append((ids.split(), [name] if name else []))
    texts += ["." * 200_000 + "x", ":\n" * 100_000, "中" * 300_000, "\n" * 300_000, "; " * 100_000, " | ~" * 50_000]
    got = {r.doc_id: (list(r.identifiers), list(r.licences)) for r in licences.scan(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (want[k] if k < len(want) else ([], [])), t[:300]


# --- 7 ------------------------------------------------------------------------------------

def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def chain(rng, n):
    """Each text is near the next only: components that no single document sees."""
    w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    out = []
    for k in range(n):
        out.append(" ".join(w))
        for _ in range(1):
            w[(k * 7) % 60] = f"w{rng.randrange(10**6)}"
    return out


def test_minhash(spark):
    rng = random.Random(5)
    texts = made(3, 70)[0] + ODD + ODD + chain(rng, 25) + ["a b c d e f g"] * 3 + ["One  TWO"]
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    want = brute_components(texts)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash.near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_buckets_that_stay_open_are_searched_whole(spark):
    """Members that link with neither the smallest nor the largest of their bucket."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, minhash.HASHES), dtype=np.uint8)
    rows, labels = [], {}
    for k in range(900):
        sig = base[k % 3].copy()
        sig[rng.choice(minhash.HASHES, 20, replace=False)] ^= 1
        rows.append((k, bytearray(sig.tobytes())))
        labels[k] = k % 3 if k < 600 else k
    sigs = spark.createDataFrame(rows, "doc_id long, sig binary")
    members = spark.createDataFrame([(1, k, labels[k]) for k in labels], "key long, doc_id long, root long")
    edges = minhash._whole_buckets(members, sigs)
    assert edges.count() < 20 * len(labels)
    got = {r.node: r.root for r in components(edges).collect()}
    value = {k: np.frombuffer(bytes(s), np.uint8) for k, s in rows}
    near = [(a, b) for a in labels for b in labels if a < b and labels[a] != labels[b] and (value[a] == value[b]).mean() >= minhash.SURE_BELOW]
    assert len(near) > 50_000 and all(got.get(a, a) == got.get(b, b) for a, b in near)
    assert len(set(got.values())) == 3


def test_links_inside_clusters(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(700):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 5])):
            w[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    clusters = spark.createDataFrame([(0, k, k) for k in range(len(texts))], "cluster long, doc_id long, root long")
    edges = minhash._links_in_clusters(clusters, table(spark, texts), 75)
    got = {r.node: r.root for r in components(edges).collect()}
    want = {k: root for k, (_, root) in brute_components(texts).items()}
    assert {k: got.get(k, k) for k in want} == want
    assert edges.count() < 20 * len(texts)


# --- 8 ------------------------------------------------------------------------------------

def test_repeated_passages_go(spark):
    texts, passage = made(4, 60, words=120)
    texts = texts + ODD + [None, passage, "éé " + passage + " ßß"]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in chunks.remove_repeats(docs).collect()}
    assert len(got) == len(texts) and chunks.remove_repeats(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    holders = [k for k, t in enumerate(texts) if t and passage in t]
    assert sum(passage in (got[k].text or "") for k in holders) == 1
    for k, t in enumerate(texts):
        cut, at, kept = (t or "").encode(), 0, b""
        for s in got[k].spans:
            kept += cut[at : s.start]
            at = s.end
        assert (kept + cut[at:]).decode() == (got[k].text or "") and (got[k].text is None) == (t is None)
    alone = [k for k, t in enumerate(texts) if t and k % 6 in (0, 4, 5) and k < 60 and sum(t == u or len(set(zip(*[t.split()[i:] for i in range(9)])) & set(zip(*[u.split()[i:] for i in range(9)]))) > 0 for u in texts[:60] if u) == 1]
    assert alone and all(got[k].text == texts[k] for k in alone)
    assert chunks.remove_repeats(docs.limit(0)).count() == 0


def brute_repeats(texts, size=51):
    """Of each text the words that lie in no window of ``size`` words of an earlier text."""
    seen, out = set(), {}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        own = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        gone = {j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in seen for j in range(i, i + size)}
        out[k] = [x.decode() for j, x in enumerate(w) if j not in gone]
        seen |= own
    return out


def phrases(seed, n=40):
    """Texts of common phrases in any order, some with a passage of 49 to 53 words of an earlier text, one word, or a long repeat."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(200)]
    common = [" ".join(rng.choices(vocab, k=rng.randint(3, 12))) for _ in range(25)]
    texts = []
    for k in range(n):
        w = " ".join(rng.choices(common, k=rng.randint(4, 25))).split()
        if k % 3 == 2:
            v = rng.choice(texts).split()
            at, size = rng.randrange(max(1, len(v) - 53)), rng.randint(49, 53)
            w[(i := rng.randrange(len(w))) : i] = v[at : at + size]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return [*texts, "word " * 50, "word " * 51, "word " * 200, "word\n" * 60 + "end", texts[0], " " + texts[1] + "\n"]


def test_only_runs_of_one_earlier_text_go(spark):
    texts = phrases(8) + made(5, 60, words=120)[0] + ODD
    got = {r.doc_id: r for r in chunks.remove_repeats(table(spark, texts).repartition(5)).collect()}
    want = brute_repeats(texts)
    assert {k: (r.text or "").split() for k, r in got.items()} == {k: " ".join(w).split() for k, w in want.items()}
    same = [k for k, t in enumerate(texts) if want[k] == [x.decode() for x in (t or "").encode().split()]]
    assert 20 < len(same) < len(texts) - 10 and all(got[k].text == texts[k] and not got[k].spans for k in same)


def test_chunks_resist_insertions():
    """Only the chunks around an insertion change, and chunks are whole words in order."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    c = chunks.Chunker()

    def spans(text):
        c(pa.array([text]))
        return [c.data[a:b].tobytes().decode() for a, b in zip(*c.chunk_bytes())]

    plain = spans(" ".join(words))
    assert "".join(plain) == " ".join(words) and len(plain) > 350 and max(len(x.split()) for x in plain) <= 2 * c.reach
    for at in (0, 60, 999, 2000):
        other = spans(" ".join([*words[:at], "INSERTED", "WORDS", *words[at:]]))
        assert len(set(plain) - set(other)) <= 5
    c(pa.array(["", "é" * 1000, " \n", None, "a  b\tc", ""]).fill_null(""))
    assert [c.data[a:b].tobytes().decode() for a, b in zip(*c.chunk_bytes())] == ["é" * 1000, *(x for x in ["a  b\tc"])] or len(c.digests) >= 2


def test_a_shared_passage_shares_its_middle_chunks():
    """Whatever stands around a run of 51 words, the chunks in its middle are the same, and there are some."""
    rng = random.Random(9)
    for round_ in range(200):
        vocab = ["".join(rng.choices("abcd", k=rng.randint(1, 3 if round_ % 2 else 9))) for _ in range(rng.choice([2, 5, 500]))]
        run = rng.choices(vocab, k=51)
        c, found = chunks.Chunker(), []
        for _ in range(2):
            pre, post = (rng.choices(vocab, k=rng.randint(0, 30)) for _ in range(2))
            c(pa.array([" ".join([*pre, *run, *post])]))
            lo, hi = len(pre) + chunks.GEAR_WORDS + c.reach, len(pre) + 51 - c.reach
            inside = (c.chunk_start >= lo) & (c.chunk_end <= hi)
            found.append(list(zip(c.chunk_start[inside] - len(pre), c.digests[inside])))
        assert found[0] == found[1] and len(found[0]) >= chunks.RUN


# --- 9 ------------------------------------------------------------------------------------

def test_token_counts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(800)] + ODD
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table(spark, texts), BYTE_BPE, public_tokenizers.PATTERN).collect()}
    tok = Tokenizer.from_file(BYTE_BPE)
    assert got == {k: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_every_whole_token_is_proved():
    tok, whole = Tokenizer.from_file(BYTE_BPE), token_counts.whole_tokens(BYTE_BPE)
    assert 50_000 < len(whole) <= tok.get_vocab_size()
    assert all(len(tok.model.tokenize(w)) == 1 for w in list(whole)[::500])


# --- 10 -----------------------------------------------------------------------------------

def brute_passages(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    own = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            own[tuple(w[k : k + window])].add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in own}:
            for k in range(len(w) - n + 1):
                if own.get(tuple(w[k : k + n])):
                    found |= own[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_benchmark_passages(spark, block):
    rng = random.Random(8)
    vocab = ["one", "two", "Three", "vier", "cinq", "é", "x1"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 10, 12, 14])))) for k in range(25)] + [(90, None), (91, "..."), (None, "one two"), (92, "Zz-yy"), (93, "zz yy")]
    texts = [" ".join(rng.choices(vocab + ["other"], k=200)) for _ in range(15)] + [f"a, {items[k][1].upper()}! b {items[k][1]}" for k in range(10)] + ODD + ["ZZ  yy", "zz y y"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = fm_index.find_passages(table(spark, texts), bench, block_bytes=block).withColumn("hit", fm_index.hit_words()).collect()
    want = brute_passages(texts, [i for i in items if i[0] is not None])
    assert {r.doc_id: (r.n_words, r.hit, r["items"]) for r in got} == want
    assert all(a[1] < b[0] for r in got for a, b in zip(r.spans, r.spans[1:]))
    none = fm_index.find_passages(table(spark, texts), bench.limit(0))
    assert none.where("size(spans) > 0 or size(items) > 0").count() == 0 and none.count() == len(texts)
    assert fm_index.find_passages(table(spark, texts).limit(0), bench).count() == 0


def test_every_row_has_its_own_passages(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(8)]
    rows = [(1, items[0][1]), (1, f"a {items[1][1]}"), (None, items[2][1]), (None, "plain"), (None, None), (1, items[0][1]), (2, f"{items[3][1]} {items[7][1]}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((d, len((t or "").split()), [str(i) for i, x in items if x in (t or "")])) for d, t in rows)
    for block in (1 << 24, 100):
        got = fm_index.find_passages(docs, bench, block_bytes=block)
        assert got.columns == ["doc_id", "n_words", "spans", "items"]
        assert sorted(str((r.doc_id, r.n_words, list(r["items"]))) for r in got.collect()) == want


def test_fm_index():
    rng = np.random.default_rng(0)
    for it in range(100):
        top, n = int(rng.integers(1, 6)), int(rng.integers(1, 80))
        seq = rng.integers(0, top + 1, n)
        assert fm_index.suffix_array(np.append(seq + 1, 0)).tolist() == sorted(range(n + 1), key=lambda i: np.append(seq + 1, 0)[i:].tolist())
        index = fm_index.FMIndex(seq, top, 3)
        phrases, lengths = rng.integers(1, top + 1, (10, 4)), rng.integers(1, 5, 10)
        lo, hi = index.search(phrases, lengths)
        for k in range(10):
            p = phrases[k, 4 - lengths[k] :].tolist()
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == [j for j in range(n) if seq[j : j + lengths[k]].tolist() == p]


@pytest.mark.parametrize("piece", ['<a "', "<a '\">", "<div>x", "<b>x", "<svg>x", "<script ", "<div class=ad>x, y. ", "<blockquote>x", "</i>x", "<!--", "<td>x", "<li><dt>x"])
def test_hostile_pages_take_time_in_proportion(piece):
    """400 KB of unclosed markup, which once took hours, ends within seconds."""
    import time

    small, large = (piece * (n // len(piece)) for n in (40_000, 400_000))
    begin = time.perf_counter()
    pages.main_text("<p>An article, with words.</p>" + small)
    middle = time.perf_counter()
    pages.main_text("<p>An article, with words.</p>" + large)
    assert time.perf_counter() - middle < 40 * (middle - begin) + 0.5


def test_path_ratios_are_the_plain_sums():
    rng = random.Random(4)
    leaves = [("".join(rng.choices("ab ,.;é", k=rng.randint(0, 30))), rng.randint(1, 6), 0) for _ in range(80)]
    size, marks, n = collections.Counter(), collections.Counter(), collections.Counter()
    for text, path, _ in leaves:
        size[path] += len(text.strip())
        marks[path] += sum(c in ".,;" for c in text)
        n[path] += bool(text.strip())
    want = []
    for k in range(len(leaves)):
        near = [leaves[min(max(k + d, 0), len(leaves) - 1)][1] for d in range(-2, 3)]
        one, two = (sum(w * of[p] / max(n[p], 1) for w, p in zip((0.25, 0.5, 1.0, 0.5, 0.25), near)) / 2.5 for of in (size, marks))
        want.append((one * two) ** 0.5)
    assert pages.path_scores(leaves) == pytest.approx(want)
