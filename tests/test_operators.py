"""Golden cases and brute-force checks of operators that SQL cannot say or that are iterative."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmetrica.functions import algebra as A
from segmetrica.functions import labels as LB
from segmetrica.functions import windows as N
from segmetrica.functions.hashing import hash_text
from segmetrica.operators import grid as GR
from segmetrica.operators import intervals as I
from segmetrica.operators import pooling as P
from segmetrica.operators import sampling as SP
from segmetrica.operators import scorers as S
from segmetrica.operators import signal as SI
from segmetrica.plans import models as MD
from segmetrica.sources import models as SM
from segmetrica.sources.probe import header_facts

SR = 16000


def test_window_grid_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (5000, 64000, 64001, 150000, 6400000)], "n long")
    got = [r.c for r in rows.select(F.size(N.capped_sliding_starts(F.col("n"))).alias("c")).collect()]
    assert got == [1, 1, 2, 4, 150]


def _targets(spark, comps, starts, is_view=False, mask=False, kind="partial", file_fake=0):
    c = spark.createDataFrame([(1, int(a), int(b), k, f) for a, b, k, f in comps], "file_id long, start long, end long, kind string, fake int")
    w = spark.createDataFrame([(1, i, int(s), int(s) + 64000) for i, s in enumerate(starts)], "file_id long, win_idx int, start long, end long")
    it = spark.createDataFrame([(1, is_view, mask, kind, file_fake)], "file_id long, is_view boolean, mask_music boolean, kind_name string, file_fake int")
    return [tuple(r)[2:] for r in I.window_targets(w, c, it).orderBy("win_idx").collect()]


def test_window_targets_golden(spark):
    speech = [(0, 3 * SR, "speech", 0), (3 * SR, 5 * SR, "speech", 1), (5 * SR, 12 * SR, "speech", 0)]
    inside, outside, slight = _targets(spark, speech, [0, 8 * SR, 4.8 * SR])
    assert inside == (1, 1, None, 1, 0) and outside == (0, 0, None, 1, 0) and slight[:3] == (None, None, None)
    first, second = _targets(spark, [(0, 6 * SR, "speech", 0), (6 * SR, 12 * SR, "music", 1)], [0, 8 * SR], kind="seq_rv")
    assert first == (0, 0, None, 1, 0) and second == (1, None, 1, 0, 1)
    (view,) = _targets(spark, [(0, 5 * SR, "speech", 0)], [0], True, True, "view", None)
    assert view[0] is None and view[1] == 0 and view[2] is None and view[4] is None


def test_overlap_join_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = [(int(f), int(s), int(s + w)) for f, s, w in zip(rng.integers(0, 3, 60), rng.integers(0, 500000, 60), rng.integers(1, 300000, 60))]
    b = [(int(f), int(s), int(s + w)) for f, s, w in zip(rng.integers(0, 3, 60), rng.integers(0, 500000, 60), rng.integers(1, 300000, 60))]
    left = spark.createDataFrame([(*x, i) for i, x in enumerate(a)], "file_id int, start long, end long, i int")
    right = spark.createDataFrame([(*x, i) for i, x in enumerate(b)], "file_id int, start long, end long, j int")
    got = sorted((r.i, r.j, r.overlap) for r in I.overlap_join(left, right, "file_id").collect())
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b)
                  if x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1]))
    assert got == want


def test_smooth_max_random_and_order_free(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(z), float(w)) for f in range(50) for z, w in zip(rng.normal(0, 3, rng.integers(1, 30)), rng.random(30) + 0.01)]
    df = spark.createDataFrame(rows, "f int, z double, w double")
    one = P.pool_smooth_max(df, ["f"], "z", F.col("w"), (0.5, 4.0)).toPandas().set_index("f").sort_index()
    two = P.pool_smooth_max(df.orderBy(F.desc("z")).repartition(5), ["f"], "z", F.col("w"), (0.5, 4.0)).toPandas().set_index("f").sort_index()
    pdf = pd.DataFrame(rows, columns=["f", "z", "w"])
    for f, g in pdf.groupby("f"):
        w = g.w / g.w.sum()
        for i, tau in enumerate((0.5, 4.0)):
            want = tau * np.log((w * np.exp((g.z - g.z.max()) / tau)).sum()) + g.z.max()
            assert one.loc[f, f"lse_{i}"] == pytest.approx(want, abs=1e-12)
    assert np.allclose(one, two, atol=1e-12)


def test_topk_ends(spark):
    df = spark.createDataFrame([(1, x) for x in (0.1, 0.4, 0.9)], "f int, score double")
    r = P.pool(df, ["f"], poolings={"a": ("topk", 1), "b": ("topk", 9), "max": ("max", 0), "mean": ("mean", 0)}).first()
    assert r.p_a == r.p_max and r.p_b == pytest.approx(r.p_mean)


def test_nulls_stay_null_in_score_algebra(spark):
    df = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5)], "a double, b double")
    r = df.select(A.combine(F.col("a"), F.col("b"), "max").alias("m"), A.logit(F.col("a")).alias("l"), A.is_probability(F.col("a")).alias("ok"),
                  A.component_floor(F.lit(0.2), F.col("a"), F.col("b"), F.col("b"), F.col("b")).alias("f")).collect()
    assert r[0].m is None and [x.l for x in r] == [None, None] and not any(x.ok for x in r) and [x.f for x in r] == [0.2, 0.2]


def _round_robin(rows, budget, key_hash):
    """Plain loop: families in order, each takes its best free paired group."""
    groups = {}
    for r in rows:
        groups.setdefault(r["grp"], set()).add(r["label"])
    paired = {g for g, s in groups.items() if s == {0, 1}}
    pools = {}
    for r in rows:
        if r["label"] == 1 and r["grp"] in paired:
            pools.setdefault(r["family"], []).append((key_hash[r["id"]], r["id"], r["grp"]))
    taken, out = set(), []
    budget = min(budget, len(paired))
    while len(out) < budget:
        moved = False
        for fam in sorted(pools):
            free = [x for x in sorted(pools[fam]) if x[2] not in taken]
            if not free:
                continue
            taken.add(free[0][2])
            out.append((free[0][2], fam, free[0][1]))
            moved = True
            if len(out) == budget:
                break
        if not moved:
            break
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_generator_round_robin(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [dict(id=i, grp=int(rng.integers(0, 12)), label=int(rng.random() < 0.7), family=f"f{rng.integers(0, 4)}") for i in range(80)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    hashes = {r.id: r.h for r in df.select("id", hash_text(seed, F.col("id")).alias("h")).collect()}
    got = sorted((r.grp, r.family, r.fake_id) for r in SP.generator_round_robin(df, "id", "grp", "label", "family", 9, seed).collect())
    assert got == _round_robin(rows, 9, hashes)


def test_connected_groups(spark):
    rng = np.random.default_rng(3)
    edges = [(int(i), f"t{t}") for i, t in zip(rng.integers(0, 120, 130), rng.integers(0, 110, 130))]
    edges += [(200 + i, f"c{i}") for i in range(30)] + [(201 + i, f"c{i}") for i in range(30)]  # a long chain
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t in edges:
        parent[find(("t", t))] = find(("i", i))
    want = {}
    for i in {e[0] for e in edges}:
        want.setdefault(find(("i", i)), set()).add(i)
    got = {}
    for r in SP.connected_groups(spark.createDataFrame(edges, "item long, token string"), "item", "token").collect():
        got.setdefault(r.component, set()).add(r.item)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_trees_match_a_plain_walk(spark):
    model = MD.tree_model(17, 1)
    rng = np.random.default_rng(4)
    from segmetrica.functions.features import SCORE_FIELDS, feature_set

    pdf = pd.DataFrame(rng.random((40, 13)), columns=list(SCORE_FIELDS))
    pdf.loc[0, "nii"] = 1.5
    df = spark.createDataFrame(pdf)
    x = df.select(*[c.alias(n) for n, c in feature_set("file17")]).toPandas().to_numpy(np.float64).astype(np.float32).astype(float)
    got = S.tree_score(df, "file17", model, "s").toPandas()["s"].to_numpy()
    assert np.isnan(got[0])
    for row, g in list(zip(x, got))[1:]:
        z = model["initial_log_odds"]
        for t in model["trees"]:
            n = 0
            while t["children_left"][n] != -1:
                n = t["children_left"][n] if row[t["feature"][n]] <= t["threshold"][n] else t["children_right"][n]
            z += model["learning_rate"] * t["value"][n]
        assert g == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-14)


def test_spectrum_and_fakeprint(spark):
    rng = np.random.default_rng(5)
    frames = rng.normal(0, 0.2, (7, 64))
    df = spark.createDataFrame([(1, i, [float(v) for v in f]) for i, f in enumerate(frames)], "file_id long, frame int, samples array<double>")
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    power = (np.abs(np.fft.rfft(frames * win)) ** 2).mean(0)[1:]
    hz = np.arange(1, 33) * 250.0
    r = SI.spectral_measures(SI.frame_power(df, 64), 64).first()
    assert r.highband_power_fraction == pytest.approx(power[hz >= 4000].sum() / power.sum())
    assert r.rolloff95_nyquist == hz[np.searchsorted(np.cumsum(power), 0.95 * power.sum())] / 8000
    assert r.spectral_flatness == pytest.approx(np.exp(np.log(power).mean()) / power.mean())
    db = (10 * np.log10(np.clip(np.abs(np.fft.rfft(frames * win)) ** 2, 1e-10, 1e6))).mean(0)
    band = db[4:33]
    padded = np.pad(band, (5, 4), mode="edge")
    hull = np.array([padded[i:i + 10].min() for i in range(len(band))])
    res = np.clip(band - np.clip(hull, -45, None), 0, 5)
    got = SI.fakeprint(SI.frame_power(df, 64, db=True), 64).orderBy("bin").toPandas()["value"].to_numpy()
    assert np.allclose(got, res / (res.max() + 1e-6))


def test_affine_fits_against_newton(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(3):
        x = rng.normal(0, 2, 200)
        y = (rng.random(200) < 1 / (1 + np.exp(-(0.6 * x - 0.3 * k)))).astype(int)
        rows += [(k, float(a), int(b)) for a, b in zip(x, y)]
        t = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-(t[0] * x + t[1])))
            g = 100 * np.array([((p - y) * x).sum(), (p - y).sum()]) + [t[0], 0]
            w = p * (1 - p)
            h = 100 * np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + [[1, 0], [0, 0]]
            t = t - np.linalg.solve(h, g)
        want[k] = t
    got = GR.affine_fits(spark.createDataFrame(rows, "k int, x double, label int"), ["k"]).collect()
    for r in got:
        assert (r.a, r.b) == pytest.approx(tuple(want[r.k]), abs=1e-8)


def test_header_facts():
    wav = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 64000) + bytes(64000)
    assert header_facts(wav) == ("wav", 8000, 2, 256, 2.0)
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # layer III, 128 kbit/s, 44.1 kHz, stereo
    assert header_facts(head + bytes(15996))[:4] == ("mp3", 44100, 2, 128)
    assert header_facts(head + bytes(15996))[4] == 1.0
    xing = head + bytes(32) + b"Xing" + struct.pack(">II", 1, 100) + bytes(200)
    assert header_facts(xing)[4] == 100 * 1152 / 44100
    assert header_facts(b"") == header_facts(b"\xff") == header_facts(b"hello" * 50)


def test_model_json_is_strict():
    assert SM.parse_model('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            SM.parse_model(bad)


def test_licence_and_slug(spark):
    df = spark.createDataFrame([("Attribution-NoDerivatives", "http://creativecommons.org/licenses/by-nd/4.0/"), ("Café del Mar", "https://x"), ("", "")], "t string, u string")
    r = df.select(LB.licence(F.col("t"), F.col("u")).alias("l"), LB.slug(LB.fold_accents(F.col("t"))).alias("s")).collect()
    assert r[0].l.license_id == "CC-BY-ND-4.0" and not r[0].l.derivatives_allowed
    assert r[1].s == "cafe-del-mar" and r[2].l.license_id is None


def test_grid_has_anchors_first_and_no_repeats():
    g = GR.build_grid()
    assert [f["anchor"] for f in g[:4]] == ["sub01", "sub03", "sub04", "sub06"]
    keys = [f["formula_key"] for f in g]
    assert len(set(keys)) == len(keys) - 1  # two anchors share one formula by design
    assert len(g) == 4 + 7 * 3 * 4 * 5 - 2


def test_audio_listing(spark, tmp_path):
    from segmetrica.sources.manifests import audio_files

    for n in ("a.WAV", "b.mp3", "b.flac", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    files, bad = audio_files(spark, str(tmp_path))
    assert sorted(r.file_id for r in files.collect()) == ["a", "b", "b"] and bad.count() == 1
