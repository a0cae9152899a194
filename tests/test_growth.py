"""Steps whose cost must not grow with more than the input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from segmetrica.operators import scorers as S
from segmetrica.plans import models as MD


def test_a_tree_models_plan_does_not_grow_with_its_trees(spark):
    from segmetrica.functions.features import SCORE_FIELDS

    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame(rng.random((20, 13)), columns=list(SCORE_FIELDS)))
    plan = lambda n: len(S.tree_score(df, "file17", MD.tree_model(17, 1, n), "s")._jdf.queryExecution().optimizedPlan().toString())
    assert plan(512) < 1.1 * plan(2)


def test_all_fits_of_a_grid_share_their_passes(spark, monkeypatch):
    """Fits of every fold and C take a few passes together, and are those of Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from segmetrica.operators import fits

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.2] + [0, 10, -1]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=600) > 2.5).astype(int)
    df = spark.createDataFrame(pd.DataFrame(dict(a=x[:, 0], b=x[:, 1], c=x[:, 2], label=y, grp=np.arange(600) // 3)))
    passes, slopes = [], fits._slopes
    monkeypatch.setattr(fits, "_slopes", lambda *a: passes.append(1) or slopes(*a))
    model, search = fits.fit_grouped(df, ["a", "b", "c"], "label", "grp")
    assert len(passes) <= 15
    assert [r["n_files"] for r in search.collect()] == [600] * 3 and model["parity"] < 1e-9
    n, pos = 600, int(y.sum())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = spark.createDataFrame(pd.DataFrame(dict(a=z[:, 0], b=z[:, 1], c=z[:, 2], label=y, w=np.where(y == 1, n / 2 / pos, n / 2 / (n - pos)))))
    lr = LogisticRegression(featuresCol="v", weightCol="w", regParam=1 / (model["C"] * n), standardization=False, maxIter=1000, tol=1e-12)
    ml = lr.fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(rows))
    np.testing.assert_allclose(model["coef"], ml.coefficients.toArray(), atol=1e-5)
    assert abs(model["intercept"] - ml.intercept) < 1e-5


def test_only_texts_with_accents_go_to_python(spark):
    import unicodedata

    from segmetrica.functions import labels as LB

    texts = ["plain", None, "", "Žluťoučký kůň ﬁ ½ Ⅷ", "éậ", "漢字 x", "\x7f\x80"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", LB.fold_accents(F.col("t")).alias("f"))
    for r in out.collect():
        assert r.f == (None if r.t is None else unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode())
    assert "_folded(CASE WHEN RLIKE(t" in out._jdf.queryExecution().analyzed().toString()


def test_parts_of_a_linear_sum_add_up(spark):
    rng = np.random.default_rng(2)
    x, m, s, c = rng.normal(size=9), rng.normal(size=9), rng.random(9) + 0.5, rng.normal(size=9)
    lit = lambda v: F.array(*[F.lit(float(k)) for k in v])
    df = spark.createDataFrame([(x.tolist(), x[:4].tolist(), x[4:].tolist())], "x array<double>, a array<double>, b array<double>")
    parts = S.linear_sum_array("a", lit(m[:4]), lit(s[:4]), lit(c[:4])) + S.linear_sum_array("b", lit(m[4:]), lit(s[4:]), lit(c[4:]))
    r = S.linear_score_array(df, "x", lit(m), lit(s), lit(c), 0.25, "score").select("score", (parts + 0.25).alias("z")).first()
    z = ((x - m) / s) @ c + 0.25
    assert abs(r.z - z) < 1e-12 and abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12


def test_the_vectors_of_a_linear_score_are_summed_before_the_join(spark):
    from segmetrica.plans import load_all

    plan = load_all()[0]["linear_score_embedding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "transform(" not in above and "aggregate(" not in above


def test_pooling_of_many_rows_has_more_tasks_not_larger_ones(spark):
    from segmetrica.operators import pooling as P

    rows = [(f, s, v / 8) for f in range(30) for s in "ab" for v in range(f % 5 + 1)]
    df = spark.createDataFrame([*rows, (None, "a", 0.5), (3, None, None)], "f long, s string, score double")
    key = lambda r: str(tuple(r))
    plain, dealt = P.pool(df, ["f", "s"]), P.pool(df, ["f", "s"], rows=5 * P.TASK_ROWS + 1)
    assert sorted(map(key, plain.collect())) == sorted(map(key, dealt.collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(f" in plan and ", 6), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_smooth_max_sums_span_any_logits(spark):
    from segmetrica.streaming import incremental as R

    groups = {1: [0.5, 0.25, 3.0], 2: [-2000.0, 2000.0, 1999.5], 3: [None, -5.0], 4: [None], 5: [31.9, 32.1, -0.1], 6: [-1e5, -1e5 - 40]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, z double")
    for tau in (1.0, 4.0):
        sums = R.running_smooth_max(df, "k", "z", tau)
        assert "Python" not in sums._jdf.queryExecution().executedPlan().toString()
        for r in R.smooth_max(sums, "k", tau).collect():
            z = np.array([v for v in groups[r.k] if v is not None])
            assert r.n == len(groups[r.k])
            if not len(z):
                assert r.pooled is None
                continue
            want = tau * np.log(np.exp((z - z.max()) / tau).mean()) + z.max()
            assert abs(r.pooled - want) < 1e-9 * max(1, abs(want))
