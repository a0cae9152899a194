"""EER, AUC, leave-one-family-out and bootstrap against small NumPy re-derivations."""

import numpy as np
import pandas as pd
import pytest

from segmetrica.operators import metrics as M


def eer_np(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    points = [(0.0, 1.0)]
    for t in sorted(set(s), reverse=True):
        fp, tp = ((s >= t) & (y == 0)).sum(), ((s >= t) & (y == 1)).sum()
        points.append((fp / (y == 0).sum(), 1.0 - tp / (y == 1).sum()))
    f, n = np.array(points).T
    i = int(np.argmin(np.abs(f - n)))
    return (f[i] + n[i]) / 2.0


def auc_np(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def one(df):
    return df.collect()[0]


def test_perfect_eer(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, score double")
    row = one(M.summarize(df))
    assert row.eer == 0.0 and row.roc_auc == 1.0 and row.tie_rate == 0.0


def test_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "label int, score double")
    row = one(M.summarize(df))
    assert row.eer is None and row.roc_auc is None and row.note == "single-class subset"


def random_table(seed, n=4000, cases=60):
    rng = np.random.default_rng(seed)
    case = rng.integers(0, cases, n)
    levels = rng.integers(2, 40, cases)[case]
    return pd.DataFrame(
        dict(
            case=case,
            label=rng.integers(0, 2, n),
            score=np.round(rng.random(n) * levels) / levels,
            family=[f"f{i}" for i in rng.integers(0, 4, n)],
            grp=rng.integers(0, 40, n),
        )
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_eer_and_auc(spark, seed):
    pdf = random_table(seed)
    got = M.summarize(spark.createDataFrame(pdf).repartition(7), ["case"]).toPandas().set_index("case")
    for case, g in pdf.groupby("case"):
        r = got.loc[case]
        if g.label.nunique() < 2:
            assert np.isnan(r.eer)
            continue
        assert r.eer == eer_np(g.label, g.score)
        assert r.roc_auc == pytest.approx(auc_np(g.label, g.score), abs=1e-12)
        counts = g.score.value_counts()
        assert r.tie_rate == pytest.approx(counts[counts > 1].sum() / len(g))
        assert r.distinct_score_ratio == pytest.approx(len(counts) / len(g))


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_leave_one_family_out(spark, seed):
    pdf = random_table(seed)
    df = spark.createDataFrame(pdf)
    got = M.leave_one_family_out(df, ["case"]).toPandas().set_index(["case", "family"])
    seen = 0
    for case, g in pdf.groupby("case"):
        real = g[g.label == 0]
        for fam, f in g[g.label == 1].groupby("family"):
            part = pd.concat([real, f])
            r = got.loc[(case, fam)]
            seen += 1
            if len(real) == 0:
                assert np.isnan(r.eer)
                continue
            assert r.eer == eer_np(part.label, part.score), (case, fam)
            assert r.roc_auc == pytest.approx(auc_np(part.label, part.score), abs=1e-12)
            counts = part.score.value_counts()
            assert r.n_files == len(part)
            assert r.tie_rate == pytest.approx(counts[counts > 1].sum() / len(part))
            assert r.distinct_score_ratio == pytest.approx(len(counts) / len(part))
    assert seen == len(got)


def test_leave_one_family_out_continuous_scores(spark):
    """Untied scores: the crossing lies on real-only points most of the time."""
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame(dict(label=(rng.random(n) < 0.03).astype(int), score=rng.random(n)))
    pdf["score"] = np.clip(pdf.score + 0.3 * pdf.label, 0, 1)
    pdf["family"] = [f"f{i}" for i in rng.integers(0, 5, n)]
    got = M.leave_one_family_out(spark.createDataFrame(pdf)).toPandas().set_index("family")
    for fam, f in pdf[pdf.label == 1].groupby("family"):
        part = pd.concat([pdf[pdf.label == 0], f])
        assert got.loc[fam].eer == eer_np(part.label, part.score)


def test_bootstrap_matches_its_own_draws(spark):
    pdf = random_table(6, n=400, cases=1)
    df = spark.createDataFrame(pdf)
    r = one(M.bootstrap_eer(df, n_resamples=25, seed=7))
    times = M.resample_counts(df, "grp", 25, 7).toPandas()
    assert times.groupby("replicate").times.sum().eq(pdf.grp.nunique()).all()
    values = []
    for _, t in times.groupby("replicate"):
        m = pdf.merge(t, on="grp")
        part = m.loc[m.index.repeat(m.times)]
        values.append(eer_np(part.label, part.score))
    low, mid, high = np.percentile(values, [2.5, 50, 97.5])
    assert (r.n_effective, r.n_degenerate) == (25, 0)
    assert r.lower == pytest.approx(low) and r.median == pytest.approx(mid) and r.upper == pytest.approx(high)


def test_composite_is_one_for_perfect_predictions(spark):
    rows = [(1, 1, 0, 1, 1), (0, 0, 1, 1, 1), (1, 0, 1, 0, 1), (0, 1, 0, 1, 0), (1, 1, 1, 1, 1), (0, 0, 0, 1, 1)]
    names = ["file_fake", "voice_fake", "music_fake", "voice_present", "music_present"]
    df = spark.createDataFrame(
        [(*r, *[float(v) for v in r]) for r in rows], names + [n + "_prob" for n in names]
    )
    r = one(M.composite_score(df))
    assert (r.score, r.ads, r.cps) == (1.0, 1.0, 1.0)
