"""Regularised logistic fit with grouped folds, selection on pooled out-of-fold EER."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..session import materialize
from . import wide as W
from .sampling import group_kfold

C_VALUES = (0.03, 0.3, 3.0)  # fixed grid
MAX_STEPS = 100  # Newton steps, halved ones included
TOLERANCE = 1e-9  # of a step, against the largest coefficient
PARITY = 1e-9  # most that an exported model's score may differ from the fitted one's
PLACES = 10  # of out-of-fold scores


def _facts(data: DataFrame, features: Sequence[str], label: str, folds: int) -> list[dict]:
    """Of the rows outside each fold, and of all rows: n, pos, population mean and scale of the features."""
    rows = data.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("pos"),
        F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.var_pop(c) for c in features]).alias("var")).collect()
    out = []
    for k in [*range(folds), None]:
        used = [r for r in rows if r["fold"] != k]
        n, pos = sum(r["n"] for r in used), sum(r["pos"] for r in used)
        if pos == 0 or pos == n:
            raise ValueError("a fit needs rows of both classes")
        mean = sum(r["n"] * np.array(r["mean"], float) for r in used) / n
        var = sum(r["n"] * (np.array(r["var"], float) + (np.array(r["mean"], float) - mean) ** 2) for r in used) / n
        scale = np.sqrt(var)
        scale[scale == 0] = 1.0
        out.append(dict(n=n, pos=pos, mean=mean, scale=scale))
    return out


def _matrix(rows: pa.RecordBatch, features: Sequence[str], whole: dict) -> np.ndarray:
    """Features by the scale of all rows, and a one behind."""
    x = np.ones((rows.num_rows, len(features) + 1))
    for i, c in enumerate(features):
        x[:, i] = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) - whole["mean"][i]) / whole["scale"][i]
    return x


def _probability(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _slopes(data: DataFrame, features: Sequence[str], label: str, splits: Sequence[int], facts: list[dict], at: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives of every model over its rows, from one pass: a row of numbers a model."""
    p, whole = len(features) + 1, facts[-1]
    outside = [facts[k] for k in splits]
    up, down = (np.array([f["n"] / (2.0 * x) for f, x in ((f, f["pos"] if y else f["n"] - f["pos"]) for f in outside)]) for y in (1, 0))
    held = np.array([k if k < len(facts) - 1 else -1 for k in splits])

    def run(batches):
        sums = np.zeros((len(splits), 1 + p + p * p))
        for rows in batches:
            x = _matrix(rows, features, whole)
            y = rows.column(rows.schema.get_field_index(label)).to_numpy(zero_copy_only=False).astype(float)
            fold = rows.column(rows.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            z = x @ at.T
            w = np.where(y[:, None] == 1, up, down) * (fold[:, None] != held)
            q = _probability(z)
            sums[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
            sums[:, 1 : 1 + p] += (w * (q - y[:, None])).T @ x
            curve = w * q * (1 - q)
            for m in range(len(splits)):
                sums[m, 1 + p :] += ((x * curve[:, m : m + 1]).T @ x).ravel()
        names = np.arange(sums.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums.ravel())], names=["at", "v"])

    out = np.zeros((len(splits), 1 + p + p * p))
    for r in data.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out.ravel()[r["at"]] = r["v"]
    return out


def _newton(data: DataFrame, features: Sequence[str], label: str, facts: list[dict], c_values: Sequence[float]) -> np.ndarray:
    """Weights (split, C, feature and constant) on the scale of all rows, of balanced fits with each fold left out and of all rows.

    All fits go along together, a pass over the rows a step; a step that raises the objective is halved. The objective is
    that of class weights n / (2 * class size) and a penalty 1 / (2 C) on the weights of the split's own standardised features.
    """
    p, whole = len(features) + 1, facts[-1]
    models = [(k, c) for k in range(len(facts)) for c in c_values]
    own = []  # maps a row on the scale of all rows to the split's own scale
    for f in facts:
        t = np.diag(np.append(whole["scale"] / f["scale"], 1.0))
        t[:-1, -1] = (whole["mean"] - f["mean"]) / f["scale"]
        own.append(t)
    best, trial = np.zeros((len(models), p)), np.zeros((len(models), p))  # on the split's own scale
    least, done = np.full(len(models), np.inf), np.zeros(len(models), bool)
    for _ in range(MAX_STEPS):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        at = np.array([own[models[m][0]].T @ trial[m] for m in open_])
        found = _slopes(data, features, label, [models[m][0] for m in open_], facts, at)
        for m, row in zip(open_, found):
            (k, c), t = models[m], own[models[m][0]]
            ridge = np.append(np.full(p - 1, 1.0 / c), 0.0)
            value = row[0] + (ridge * trial[m] ** 2).sum() / 2
            if not value <= least[m] * (1 + 1e-13):
                trial[m] = (best[m] + trial[m]) / 2
                continue
            best[m], least[m] = trial[m], value
            slope = t @ row[1 : 1 + p] + ridge * best[m]
            step = np.linalg.lstsq(t @ row[1 + p :].reshape(p, p) @ t.T + np.diag(ridge), slope, rcond=None)[0]
            trial[m] = best[m] - step
            if np.abs(step).max() <= TOLERANCE * (1 + np.abs(best[m]).max()):
                best[m], done[m] = trial[m], True
    if not done.all():
        raise ValueError(f"the fit did not converge in {MAX_STEPS} steps")
    return best.reshape(len(facts), len(c_values), p)


def fit_grouped(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 4, seed: int = 20260905,
                c_values: Sequence[float] = C_VALUES) -> tuple[dict, DataFrame]:
    """(model, search table C/eer/roc_auc). The chosen C is the best (EER, -AUC, C) over pooled folds.

    Needs at least as many groups as folds, and both classes outside each fold; a fit that doesn't converge is an error.
    All fits share their passes over the rows. The exported model must score as the fitted one does, within ``PARITY``;
    its ``parity`` says how closely.
    """
    if df.select(group).distinct().count() < folds:
        raise ValueError(f"{folds} folds need as many groups")
    features, c_values = list(features), list(c_values)
    data = materialize(group_kfold(df, group, folds, seed).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias(label), F.col("fold").cast("int").alias("fold"),
        F.lit("").alias("_code")), "fit")
    facts = _facts(data, features, label, folds)
    weights = _newton(data, features, label, facts, c_values)
    whole = facts[-1]

    def line(k: int, c: int) -> np.ndarray:
        """Weights of a fit on the scale of all rows."""
        f, w = facts[k], weights[k, c]
        return np.append(w[:-1] * whole["scale"] / f["scale"], w[-1] + (w[:-1] * (whole["mean"] - f["mean"]) / f["scale"]).sum())

    lines = np.array([[line(k, c) for c in range(len(c_values))] for k in range(folds + 1)])

    def columns(rows: pa.RecordBatch):
        """Scores by the fits that left the row's fold out, for each C."""
        x = _matrix(rows, features, whole)
        y = rows.column(rows.schema.get_field_index(label)).to_numpy(zero_copy_only=False).astype(np.int64)
        fold = rows.column(rows.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
        for c in range(len(c_values)):
            yield c, _probability((x * lines[fold, c]).sum(axis=1)), y, None

    summary = W.ranked(data, "_code", columns, len(c_values), places=PLACES)[0]
    search = materialize(summary.select(
        F.element_at(F.array(*[F.lit(float(c)) for c in c_values]), F.col("col") + 1).alias("C"), "n_files", "eer", "roc_auc"), "search")
    best = search.orderBy("eer", F.desc("roc_auc"), "C").first()
    chosen = c_values.index(best["C"])
    final = weights[folds, chosen]
    model = dict(mean=whole["mean"].tolist(), scale=whole["scale"].tolist(), coef=final[:-1].tolist(), intercept=float(final[-1]), C=best["C"])

    @F.arrow_udf("double")
    def fitted(*xs: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays(list(xs), names=features)
        return pa.array(_probability(_matrix(rows, features, whole) @ lines[folds, chosen]))

    exported = F.lit(model["intercept"])
    for name, m, s, c in zip(features, model["mean"], model["scale"], model["coef"]):
        exported = exported + (F.col(name) - F.lit(m)) / F.lit(s) * F.lit(c)
    model["parity"] = data.select(F.abs(fitted(*features) - A.sigmoid(exported)).alias("gap")).agg(F.max("gap")).first()[0]
    if model["parity"] > PARITY:
        raise ValueError(f"the exported model differs from the fitted one by {model['parity']}")
    return model, search
