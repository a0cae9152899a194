"""Numbered CSV records over splits, ordered single files, list digests, pins and weighted draws."""

import csv
import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmetrica.operators import sampling as SP
from segmetrica.operators import scorers as S
from segmetrica.sources import lines, sinks
from segmetrica.sources import manifests as MF


def odd_csv(rng, n, bom=False):
    """Rows with quoted line ends, doubled quotes, commas, blanks; some blank lines between."""
    pieces = ["a", "b c", 'say ""hi""', "x,y", "line\nend", "two\n\nends", "é", " ", "end\n"]
    out = io.StringIO()
    out.write(("﻿" if bom else "") + "id,text,more\n")
    rows = []
    for k in range(n):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 4))).replace('""', '"')
        m = rng.choice(["", "plain", "q\nq"])
        rows.append((str(k), t, m or None))
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if k % 3 else csv.QUOTE_MINIMAL).writerow([k, t, m])
        if k % 17 == 0:
            out.write("\n")
    return out.getvalue(), rows


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_records_are_numbered_over_splits(spark, tmp_path, split):
    rng, want = random.Random(split), []
    for f in range(3):
        text, rows = odd_csv(rng, 60, bom=f == 1)
        (tmp_path / f"f{f}.csv").write_text(text, encoding="utf-8")
        want += [(k + 2, i, t.strip(), (m or "").strip()) for k, (i, t, m) in enumerate(rows)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        d = MF.read_csv(spark, str(tmp_path), row="row")
        assert d.columns == ["row", "id", "text", "more"]
        got = [(r.row, r.id, (r.text or "").strip(), (r.more or "").strip()) for r in d.collect()]
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want) and (parts > 20 or split > 64)


def test_a_file_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    assert MF.read_csv(spark, str(tmp_path)).columns == ["x", "y"] and MF.read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError):
        MF.read_csv(spark, str(tmp_path))
    assert lines.numbered_records(spark, str(tmp_path)).count() == 0


def test_one_file_in_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    pos = rng.permutation(5000)
    df = spark.createDataFrame(pd.DataFrame(dict(pos=pos, name=[f'n"{k},\n{k % 7}' for k in pos]))).repartition(9)
    path = str(tmp_path / "out" / "all.csv")
    for _ in range(2):  # a second export replaces the first
        sinks.write_ordered(df, path, ["pos"])
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    assert [int(r["pos"]) for r in rows] == list(range(5000)) and all(r["name"] == f'n"{r["pos"]},\n{int(r["pos"]) % 7}' for r in rows)
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["all.csv"]


def test_ranking_file(spark, tmp_path):
    from segmetrica.operators import grid as GR

    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(dict(file_id=range(n), grp=rng.integers(0, 30, n), family=[f"f{k % 3}" for k in range(n)], label=rng.integers(0, 2, n),
                            voice_present=rng.random(n), music_present=rng.random(n)))
    for s in ("voice", "music", "mixture"):
        for p in ("max", "mean"):
            pdf[f"{s}_p_{p}"] = rng.random(n)
    grid = GR.build_grid(("max", "mean"), ("max",), (0.0, 1.0), (0.0, 0.5), ("max",), anchors=False)
    ranked = GR.sweep(spark.createDataFrame(pdf), grid, n_resamples=30)
    path = str(tmp_path / "rank.csv")
    sinks.write_ranking(ranked, path)
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == list(sinks.RANKING_COLUMNS) and [int(r["rank"]) for r in rows] == list(range(1, len(grid) + 1))
    values = [(float(r["worst_family_eer"]), float(r["overall_eer"]), float(r["bootstrap_upper"])) for r in rows]
    assert values == sorted(values) and all(float(r["bootstrap_lower"]) <= float(r["bootstrap_upper"]) for r in rows)


def test_list_digest_tells_swaps_apart(spark):
    digest = lambda vs: S.list_digest(spark.createDataFrame([(v,) for v in vs], "g string"), "g").collect()[0].digest
    values = [f"group {k}" for k in range(300)]
    base = digest(values)
    assert base == digest(values[::-1]) == digest(values + values[:5] + [None])
    assert len({base, digest(values[1:]), digest(["group 999", *values[1:]]), digest([*values, "group 300"]), digest([])}) == 5
    # exchanged ends of values, which a sum of parts would not see
    assert digest(["a1", "b2"]) != digest(["a2", "b1"]) and digest(["ab", "c"]) != digest(["a", "bc"])


def test_pins(spark):
    files = spark.createDataFrame([("a", "AA"), ("b", "bb"), ("x", "cc")], "path string, sha256 string")
    pins = spark.createDataFrame([("a", " aa "), ("b", "b0"), ("c", "cc")], "path string, sha256 string")
    assert sorted(map(tuple, S.pin_violations(files, pins).collect())) == [("b", "sha256 differs from its pin"), ("c", "pinned file is missing")]


def test_stratified_draws_follow_weights(spark):
    rows = [(k, "hot" if k < 400 else f"s{k % 3}", k % 2, float(k % 5)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, panel string, y int, w double").repartition(4)
    n = 24_000
    got = SP.stratified_draws(df, "id", ["panel", "y"], n, 3, "w").toPandas()
    assert sorted(got.draw) == list(range(n))
    pdf = pd.DataFrame(rows, columns=["id", "panel", "y", "w"])
    strata = got.groupby(["panel", "y"]).size()
    assert len(strata) == 8 and strata.between(n / 8 * 0.93, n / 8 * 1.07).all()
    assert (pdf.set_index("id").w[got.id] > 0).all()
    hot = got[(got.panel == "hot") & (got.y == 1)].id.value_counts()
    w = pdf[(pdf.panel == "hot") & (pdf.y == 1)].set_index("id").w
    by = pd.Series(hot.values, index=w[hot.index].values).groupby(level=0).mean()
    assert by[4.0] / by[2.0] == pytest.approx(2.0, rel=0.25)
    again = SP.stratified_draws(df.repartition(2), "id", ["panel", "y"], n, 3, "w").toPandas()
    assert sorted(zip(got.draw, got.id)) == sorted(zip(again.draw, again.id))
    with pytest.raises(ValueError):
        SP.stratified_draws(df.where("w = 0"), "id", ["panel"], 5, 1, "w")
