"""Operators that must not gather one key: error rates in two passes, bootstrap, hubs, round robin and smooth-max states."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmetrica.functions.hashing import hash_text
from segmetrica.operators import crossing as C
from segmetrica.operators import graph as G
from segmetrica.operators import metrics as M
from segmetrica.operators import pooling as P
from segmetrica.operators import resampling as R
from segmetrica.operators import sampling as SP
from test_metrics import auc_np, eer_np, random_table


@pytest.mark.parametrize("seed, buckets", [(1, 1024), (2, 4), (3, 1)])
def test_two_pass_eer(spark, seed, buckets):
    pdf = random_table(seed)
    df = spark.createDataFrame(pdf).repartition(5)
    got = C.eer(df, ["case"], buckets=buckets).toPandas().set_index("case").eer
    rows = C.bucketed(df, ["case"], "family", buckets=buckets)
    full = C.summaries(rows, C.bucket_counts(rows, ["case"]), ["case"]).toPandas().set_index("case")
    assert len(got) == len(full) == pdf.case.nunique()
    for case, g in pdf.groupby("case"):
        if g.label.nunique() < 2:
            assert np.isnan(got[case]) and np.isnan(full.eer[case]) and np.isnan(full.roc_auc[case])
            continue
        assert got[case] == full.eer[case] == eer_np(g.label, g.score)
        assert full.roc_auc[case] == pytest.approx(auc_np(g.label, g.score), abs=1e-12)
        counts = g.score.value_counts()
        assert full.tie_rate[case] == pytest.approx(counts[counts > 1].sum() / len(g))
        assert full.distinct_score_ratio[case] == pytest.approx(len(counts) / len(g))
    whole = C.eer(df).collect()
    assert [r.eer for r in whole] == [eer_np(pdf.label, pdf.score)]


@pytest.mark.parametrize("buckets", [256, 2])
def test_two_pass_family_eer(spark, buckets):
    pdf = random_table(4)
    df = spark.createDataFrame(pdf)
    got = C.family_eer(df, ["case"], buckets=buckets).toPandas().set_index(["case", "family"]).eer
    want = M.leave_one_family_out(df, ["case"]).toPandas().set_index(["case", "family"]).eer
    assert len(got) == len(want)
    for k in want.index:
        assert got[k] == want[k] or (np.isnan(got[k]) and np.isnan(want[k]))
    alone = C.family_eer(df).toPandas().set_index("family").eer
    for f, v in M.leave_one_family_out(df).toPandas().set_index("family").eer.items():
        assert alone[f] == v


def test_two_pass_eer_without_rows_or_classes(spark):
    none = spark.createDataFrame([], "label int, score double, k int")
    assert C.eer(none).collect()[0].eer is None and C.eer(none, ["k"]).count() == 0
    one = spark.createDataFrame([(1, 0.5, 1), (1, 0.25, 1)], none.schema)
    assert C.eer(one).collect()[0].eer is None and C.eer(one, ["k"]).collect()[0].eer is None


def hot_table(seed, n=3000):
    """One group on 40 % of the rows."""
    rng = np.random.default_rng(seed)
    grp = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    label = rng.integers(0, 2, n)
    return pd.DataFrame(dict(grp=grp, label=label, score=np.clip(rng.normal(0.45 + 0.1 * label, 0.15), 0, 1), case=rng.integers(0, 3, n)))


@pytest.mark.parametrize("salt_rows", [50_000, 20])
def test_bootstrap_by_key_with_a_hot_group(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(R, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(R, "BLOCK_GROUPS", 8)
    pdf = hot_table(3)
    df = spark.createDataFrame(pdf).repartition(6)
    got = M.bootstrap_eer(df, ["case"], n_resamples=40, seed=5).toPandas().set_index("case")
    times = M.resample_counts(df, "grp", 40, 5).toPandas()
    for case, g in pdf.groupby("case"):
        values = []
        for _, t in times.groupby("replicate"):
            m = g.merge(t, on="grp")
            part = m.loc[m.index.repeat(m.times)]
            if part.label.nunique() == 2:
                values.append(eer_np(part.label, part.score))
        low, mid, high = np.percentile(values, [2.5, 50, 97.5])
        r = got.loc[case]
        assert r.n_effective == len(values) and r.n_effective + r.n_degenerate == 40
        assert (r.lower, r["median"], r.upper) == pytest.approx((low, mid, high), abs=1e-12)


def test_bootstrap_counts_replicates_with_one_class(spark):
    pdf = pd.DataFrame(dict(grp=[0, 0, 1, 2], label=[0, 0, 1, 0], score=[0.1, 0.6, 0.5, 0.2]))
    r = M.bootstrap_eer(spark.createDataFrame(pdf), n_resamples=60, seed=1).collect()[0]
    times = M.resample_counts(spark.createDataFrame(pdf), "grp", 60, 1).toPandas()
    both = [set(pdf.merge(t, on="grp").label) == {0, 1} for _, t in times.groupby("replicate")]
    assert r.n_effective == sum(both) < 60 and r.n_degenerate == 60 - sum(both)
    alone = M.bootstrap_eer(spark.createDataFrame(pdf).where("label = 0"), n_resamples=5, seed=1).collect()[0]
    assert (alone.n_effective, alone.n_degenerate, alone.lower) == (0, 5, None)


def test_a_hub_is_dealt_to_many_salts(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 50)
    rows = [(7, k) for k in range(1000)] + [(k, k + 1) for k in range(100, 2000)]
    df = spark.createDataFrame(rows, "a long, b long")
    found = G.with_least(df, "a", "b", len(rows))
    want = pd.DataFrame(rows, columns=["a", "b"])
    want["m"] = want.groupby("a").b.transform("min")
    assert sorted(map(tuple, found.collect())) == sorted(want.itertuples(index=False, name=None))
    seen = {}
    real = F.pmod

    def spy(*args):
        seen["dealt"] = real(*args)
        return seen["dealt"]

    monkeypatch.setattr(F, "pmod", spy)
    G.with_least(df, "a", "b", len(rows))
    salts = df.where("a = 7").withColumn("_salts", F.lit(20)).select(seen["dealt"].alias("s")).groupBy("s").count().toPandas()["count"]
    assert len(salts) == 20 and salts.max() <= 2 * 50


def test_components_with_a_token_on_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 40)
    rng = np.random.default_rng(2)
    edges = [(int(i), "hot") for i in range(0, 900, 3)] + [(int(i), f"t{t}") for i, t in zip(rng.integers(0, 900, 600), rng.integers(0, 500, 600))]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    first = {}
    for i, t in edges:
        a, b = find(i), find(first.setdefault(t, i))
        up[max(a, b)] = min(a, b)
    got = {r.item: r.component for r in SP.connected_groups(spark.createDataFrame(edges, "item long, token string"), "item", "token").collect()}
    assert got == {i: find(i) for i, _ in edges}


def plain_turns(rows, budget, hashes):
    """Turn by turn: the next family takes its best free group."""
    both = {g for g in {r["grp"] for r in rows} if {r["label"] for r in rows if r["grp"] == g} == {0, 1}}
    best = {}
    for r in rows:
        if r["label"] == 1 and r["grp"] in both:
            k = (r["family"], r["grp"])
            best[k] = min(best.get(k, ("~", 0)), (hashes[r["id"]], r["id"]))
    names, taken, out, turn = sorted({f for f, _ in best}), set(), [], 0
    budget = min(budget, len(both))
    while len(out) < budget:
        before = len(out)
        for f in names:
            free = sorted((c, g) for (h, g), c in best.items() if h == f and g not in taken)
            if free and len(out) < budget:
                (_, i), g = free[0]
                taken.add(g)
                out.append((g, f, i, turn))
        if len(out) == before:
            return None
        turn += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_round_robin_in_blocks_is_the_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [dict(id=i, grp=int(rng.integers(0, 40)), label=int(rng.random() < 0.7), family=f"f{int(rng.integers(0, 5) ** 2 // 5)}") for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    hashes = {r.id: r.h for r in df.select("id", hash_text(seed, F.col("id")).alias("h")).collect()}
    budget = 12 + seed
    want = plain_turns(rows, budget, hashes)
    if want is None:
        with pytest.raises(ValueError):
            SP.generator_round_robin(df, "id", "grp", "label", "family", budget, seed, candidates=16)
        return
    got = SP.generator_round_robin(df, "id", "grp", "label", "family", budget, seed, candidates=16 if seed % 2 else 1_000_000)
    assert sorted((r.grp, r.family, r.fake_id, r["round"]) for r in got.collect()) == want


@pytest.mark.parametrize("open_rows", [200_000, 50])
def test_smooth_max_states(spark, monkeypatch, open_rows):
    monkeypatch.setattr(P, "OPEN_ROWS", open_rows)
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame(dict(a=np.where(rng.random(n) < 0.4, 0, rng.integers(1, 90, n)), b=[None if k % 7 == 0 else f"s{k % 3}" for k in range(n)], z=rng.normal(0, 3, n), w=rng.random(n)))
    pdf.loc[pdf.a == 0, "z"] = 1.25  # one long file of equal logits
    df = spark.createDataFrame(pdf).repartition(6)
    taus = (0.25, 1.0, 1000.0)
    got = P.smooth_max_pools(df, ["a", "b"], [(F.col("z"), None), (F.col("z") * 2, F.col("w"))], taus).toPandas()
    groups = pdf.groupby(["a", pdf.b.fillna("")])
    assert len(got) == groups.ngroups
    for r in got.itertuples():
        g = groups.get_group((r.a, r.b or ""))
        for i, (z, w) in enumerate(((g.z, np.ones(len(g))), (g.z * 2, g.w))):
            for k, t in enumerate(taus):
                want = t * np.log((w * np.exp((z - z.max()) / t)).sum() / w.sum()) + z.max()
                assert getattr(r, f"x_{i}_{k}") == pytest.approx(want, abs=1e-9)


def test_smooth_max_without_logits(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "k int, z double")
    got = {r.k: r.x_0_0 for r in P.smooth_max_pools(df, ["k"], [(F.col("z"), None)]).collect()}
    assert got == {1: pytest.approx(2.0 + np.log(0.5)), 2: None}
    assert P.smooth_max_pools(df.limit(0), ["k"], [(F.col("z"), None)]).count() == 0
