"""Many score columns of the same rows: counts and ranges against the plain operators over exploded rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmetrica.operators import crossing as C
from segmetrica.operators import grid as GR
from segmetrica.operators import metrics as M
from segmetrica.operators import resampling as R
from segmetrica.operators import wide as W


def files_table(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(dict(file_id=np.arange(n), grp=rng.integers(0, 70, n), label=rng.integers(0, 2, n), voice_present=rng.integers(0, 9, n) / 8.0, music_present=rng.random(n)))
    pdf["family"] = [None if k % 11 == 0 else f"f{k % 4}" for k in range(n)]
    for s in ("voice", "music", "mixture"):
        for p in GR.POOLINGS:
            pdf[f"{s}_{GR.column_name(p)}"] = np.round(rng.random(n), 2)
    return pdf


GRID = GR.build_grid(poolings=("max", "mean"), weights=(0.0, 0.25))


def test_buckets_keep_the_order():
    s = np.sort(np.concatenate([np.random.default_rng(0).random(5000), [-np.inf, -1.0, 0.0, 1e-30, 0.5, np.nextafter(0.5, 0), 1.0, 1.5]]))
    for steps in (8, 64):
        b = W.bucket(s, steps)
        assert (np.diff(b) >= 0).all() and b.min() >= 0 and b.max() < W.n_buckets(steps) and len(np.unique(b)) > 4 * steps


def test_rounding_is_that_of_spark(spark):
    x = [0.5212890625, 0.2571796875, 1 / 3, 0.1234567885, 0.0, 1.0, 0.99999999949999]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).alias("r")).collect()]
    assert W.rounded(np.array(x), 9).tolist() == want


@pytest.mark.parametrize("range_rows", [250_000, 100])
def test_sweep_columns_are_the_exploded_grid(spark, monkeypatch, range_rows):
    monkeypatch.setattr(W, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(W, "CHUNK_ROWS", 300)
    monkeypatch.setattr(W, "CELL_LIMIT", 30_000)
    df = spark.createDataFrame(files_table()).repartition(3)
    long = GR.score_grid(df, GRID, ["family", "label"]).withColumn("score", F.round("score", 9))
    want = M.summarize(long, ["formula_id"]).toPandas().set_index("formula_id")
    summary, families, _ = W.ranked(df, "family", GR.grid_columns(GRID), len(GRID), places=9)
    got = summary.toPandas().set_index("col")
    assert len(got) == len(want) == len(GRID)
    for c in ("n_files", "n_real", "n_fake", "eer", "tie_rate", "distinct_score_ratio"):
        assert (got[c] == want[c].reindex(got.index)).all(), c
    assert np.allclose(got.roc_auc, want.roc_auc.reindex(got.index), atol=1e-12)
    lofo = {(r.formula_id, r.family): r.eer for r in C.family_eer(long, ["formula_id"]).collect()}
    assert {(r.col, r.family): r.eer for r in families.collect()} == lofo
    means = GR.grid_means(df, GRID).toPandas().set_index("formula_id")
    raw = GR.score_grid(df, GRID, []).groupBy("formula_id").agg(F.count("*").alias("n"), F.avg("score").alias("a"), F.max("score").alias("m")).toPandas().set_index("formula_id").loc[means.index]
    assert (means.n == raw.n).all() and (means.max_score == raw.m).all() and np.allclose(means.mean_score, raw.a)


def test_scores_move_in_passes_of_a_few_columns(spark, monkeypatch):
    df = spark.createDataFrame(files_table(400)).repartition(3)
    whole = [d.toPandas() for d in W.ranked(df, "family", GR.grid_columns(GRID), len(GRID), places=9)]
    moved, deal = [], W._dealt

    def counted(*args, **more):
        out = deal(*args, **more)
        # at least a score and a byte for the family of each file and column
        moved.append(out.agg(F.countDistinct("col"), F.sum(F.length("scores") + F.length("who"))).first())
        return out

    monkeypatch.setattr(W, "PASS_COLUMNS", 5)
    monkeypatch.setattr(W, "PASS_BYTES", 1)
    monkeypatch.setattr(W, "_dealt", counted)
    parts = [d.toPandas() for d in W.ranked(df, "family", GR.grid_columns(GRID), len(GRID), places=9)]
    assert max(n for n, _ in moved) == 5 and sum(n for n, _ in moved) == len(GRID)
    assert max(b for _, b in moved) <= 5 * 400 * 9
    for a, b in zip(whole, parts):
        keys = list(a.columns[:2])
        pd.testing.assert_frame_equal(a.sort_values(keys, ignore_index=True), b.sort_values(keys, ignore_index=True))


def test_a_pass_reads_what_its_formulas_need():
    columns = GR.grid_columns(GRID).some([0])
    f = GRID[0]
    assert set(columns.reads) == {"label", "voice_present", "music_present", *(f"{s}_{GR.column_name(f[s + '_pooling'])}" for s in ("voice", "music"))}
    rows = pa.RecordBatch.from_pandas(files_table(20)[columns.reads])
    assert [k for k, *_ in columns(rows)] == [0]


def test_files_meet_draws_once_a_pass_and_ties_are_one_row(spark, monkeypatch):
    """Files and draws are not copied for each share of columns, and a large group is dealt to several tasks."""
    grid = GRID[:5]
    pdf = files_table(500)
    pdf.loc[:299, "grp"] = 7
    df = spark.createDataFrame(pdf).repartition(3)
    _, _, bounds = W.ranked(df, "family", GR.grid_columns(grid), len(grid), edges=R.EDGES_ALL)
    plain = R.bootstrap_columns(df, GR.grid_columns(grid), len(grid), bounds, 20, 3, "grp").toPandas()
    seen, count = [], R.column_counts

    def counted(files, draws, columns, numbers, *more):
        seen.append((files.count(), files.select("_salt").distinct().count(), draws.groupBy("_salt").count().agg(F.max("count")).first()[0], len(numbers)))
        return count(files, draws, columns, numbers, *more)

    monkeypatch.setattr(R, "BLOCK_GROUPS", 16)
    monkeypatch.setattr(R, "PART_BLOCKS", 1)
    monkeypatch.setattr(R, "COLUMN_SHARE", 2)
    monkeypatch.setattr(R, "PART_FILES", 100)
    monkeypatch.setattr(R, "column_counts", counted)
    cut = R.bootstrap_columns(df, GR.grid_columns(grid), len(grid), bounds, 20, 3, "grp").toPandas()
    assert [s[3] for s in seen] == [2, 2, 1]
    for files, salts, draws, _ in seen:
        assert files == 500 and salts > 1 and draws <= -(-70 // 16)
    for a, b in zip(plain.groupby("col").eer, cut.groupby("col").eer):
        assert sorted(a[1]) == pytest.approx(sorted(b[1]), abs=1e-12)


def test_intervals_of_columns_are_those_of_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_GROUPS", 16)
    monkeypatch.setattr(R, "PART_BLOCKS", 2)
    monkeypatch.setattr(R, "COLUMN_SHARE", 3)
    monkeypatch.setattr(R, "DRAWS", 50)
    grid = GRID[:8]
    df = spark.createDataFrame(files_table(600)).repartition(3)
    long = GR.score_grid(df, grid, ["grp", "label"])
    want = M.bootstrap_eer(long, ["formula_id"], n_resamples=25, seed=3).toPandas().set_index("formula_id")
    _, _, bounds = W.ranked(df, "family", GR.grid_columns(grid), len(grid), edges=R.EDGES_ALL)
    per = R.bootstrap_columns(df, GR.grid_columns(grid), len(grid), bounds, 25, 3, "grp").toPandas()
    assert len(per) == 25 * len(grid)
    for col, g in per.groupby("col"):
        assert np.percentile(g.eer, [2.5, 97.5]) == pytest.approx([want.lower[col], want.upper[col]], abs=1e-12)


def test_draws_are_those_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_GROUPS", 8)
    monkeypatch.setattr(R, "DRAWS", 10)
    df = spark.createDataFrame([(k % 30, 0) for k in range(90)], "grp int, x int")
    numbers = {r.idx: r.grp for r in R.numbered_groups(df, "grp", 9).collect()}
    want = {(r.grp, r.replicate): r.times for r in M.resample_counts(df, "grp", 20, 9).collect()}
    got = {}
    for r in R.draw_matrix(30, 20, 9, spark).collect():
        for k, t in enumerate(np.frombuffer(r.counts, np.uint16)):
            if t:
                got[numbers[r.idx], k] = t
    assert got == want


def test_eer_of_parts_with_missing_labels(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame(dict(part=[None if k % 9 == 0 else f"p{k % 3}" for k in range(n)], label=[None if k % 7 == 0 else float(k % 2) for k in range(n)], ok=rng.integers(0, 2, n), a=rng.random(n), b=np.round(rng.random(n), 1)))
    df = spark.createDataFrame(pdf).repartition(3)
    curve = GR.weight_curve(df, {"h": ("label", lambda r, w: (1 - w) * W.floats(r, "a") + w * W.floats(r, "b"), "ok")}, ["part"], weights=(0.0, 0.5, 1.0), places=7)
    got = {(r.part, r.w): r.eer for r in curve.collect()}
    kept = df.where("ok = 1 AND label IS NOT NULL AND NOT isnan(label)")
    for w in (0.0, 0.5, 1.0):
        want = M.eer(kept.select("part", "label", F.round((1 - w) * F.col("a") + w * F.col("b"), 7).alias("score")), ["part"])
        for r in want.collect():
            assert got[r.part, w] == r.eer
    assert len(got) == 12


def test_a_fit_step_writes_no_checkpoint(spark, monkeypatch):
    from segmetrica import session

    def refuse(df):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(session, "cut_lineage", refuse)
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.4, 1), (0, 0.3, 0), (0, 0.2, 1), (1, 0.5, 1)], "k int, x double, label int")
    got = {r.k: (r.a, r.b) for r in GR.affine_fits(df, ["k"]).collect()}
    assert got[1] == (None, None) and all(np.isfinite(got[0]))


def test_sliced_equals_the_plain_summary_of_each_slice(spark, monkeypatch):
    """Ties, a slice with one class and ranges far smaller than a slice: the same as summaries of exploded rows, whose scores moved once a slice."""
    from segmetrica.operators import metrics, wide

    monkeypatch.setattr(wide, "RANGE_ROWS", 40)
    rng = np.random.default_rng(17)
    rows = [(int(rng.integers(2)) if k % 5 else 0, "abc"[k % 3], "xyz"[int(rng.integers(3))] if k % 5 else "real",
             float(rng.integers(60)) / 59, float(rng.random())) for k in range(700)]
    df = spark.createDataFrame(rows, "y int, domain string, family string, s0 double, s1 double")

    def columns(batch):
        for k in range(2):
            yield k, wide.floats(batch, f"s{k}"), batch.column("y").to_numpy().astype(np.int64), None

    part = F.from_json("code", "domain string, family string")
    slices = F.array(*[F.struct(F.lit(n).alias("slice"), v.alias("value")) for n, v in (("all", F.lit("")), ("domain", part["domain"]), ("family", part["family"]))])
    got = wide.sliced(df.withColumn("cell", F.to_json(F.struct("domain", "family"))), "cell", slices, ["slice", "value"], columns, 2, places=3)
    got = {(r["slice"], r["value"], r["col"]): r for r in got.collect()}
    seen = 0
    for slice_, value in (("all", F.lit("")), ("domain", F.col("domain")), ("family", F.col("family"))):
        for k in range(2):
            want = metrics.summarize(df.select("y", value.alias("value"), F.round(f"s{k}", 3).alias("score")), ["value"], label="y")
            for w in want.collect():
                g = got[slice_, w["value"], k]
                seen += 1
                assert (g["n_files"], g["n_real"], g["n_fake"]) == (w["n_files"], w["n_real"], w["n_fake"])
                for c in ("eer", "roc_auc"):
                    assert g[c] is None and w[c] is None or abs(g[c] - w[c]) < 1e-12, (slice_, value, k, c)
    assert seen == len(got) == 16


def test_a_fit_step_moves_no_rows_and_leaves_no_files(spark, monkeypatch, tmp_path):
    """Each pass over the features leaves a row a key and task; the features go when the search has its numbers."""
    from segmetrica import session

    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame(dict(head=[["voice", "file", None][k % 3] for k in range(n)], tau=rng.integers(1, 3, n) / 2.0, x=np.round(rng.normal(size=n) * 4, 1)))
    pdf["label"] = (pdf.x + rng.normal(size=n) * 5 > 0).astype(int)
    pdf.loc[(pdf["head"] == "file") & (pdf.tau == 1.0), "label"] = 0  # one class
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "head string, tau double, x double, label int").repartition(4)
    monkeypatch.setattr(session, "work_dir", lambda spark: str(tmp_path))
    moved, sums = [], GR._key_sums
    monkeypatch.setattr(GR, "_key_sums", lambda data, *more: moved.append(data.columns) or sums(data, *more))
    got = {(r["head"], r.tau): r for r in GR.fit_pooling(df, ["head", "tau"]).collect()}
    assert moved and all(c == ["_h", "_x", "_y"] for c in moved)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("affine")]
    eers = {(r["head"], r.tau): r.eer for r in C.eer(df.withColumn("score", 1 / (1 + F.exp(-F.col("x") / 8))), ["head", "tau"]).collect()}
    assert set(got) == set(eers) and len(got) == 6
    for k, r in got.items():
        mine = pdf[(pdf["head"].isna() if k[0] is None else pdf["head"] == k[0]) & (pdf.tau == k[1])]
        assert (r.eer is None) == (eers[k] is None) == (r.a is None) == (r.bce is None) == (k == ("file", 1.0))
        if r.a is None:
            continue
        assert r.eer == pytest.approx(eers[k], abs=1e-12)
        p = 1 / (1 + np.exp(-(r.a * mine.x + r.b)))
        assert r.bce == pytest.approx(-np.mean(np.log(np.where(mine.label == 1, p, 1 - p))), rel=1e-9)
        assert 100 * ((p - mine.label) * mine.x).sum() + r.a == pytest.approx(0, abs=1e-3) and 100 * (p - mine.label).sum() == pytest.approx(0, abs=1e-3)
